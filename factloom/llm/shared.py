"""Scratch tables, bounded Arrow batches and fixed-size tables summed over all tasks."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.session import shared_dir

#: Rows of an Arrow batch at most: with texts of some 100 KB a batch stays within tens of MB.
BATCH_ROWS = 512
#: Cells of one segment of a fixed-size table, the unit in which tasks' tables are merged.
SEGMENT = 1 << 16


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new folder below the shared one; it goes when the session ends."""
    path = f"{shared_dir(spark)}/llm/{label}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def written(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends there, so a lost executor repeats only what reads it."""
    spark = df.sparkSession
    path = scratch_folder(spark, label)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def mapped(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    bounded_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def batch(schema: dict[str, pa.DataType], **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[k], t) for k, t in schema.items()], names=list(schema))


def in_batches(rows: Iterator[tuple], schema: dict[str, pa.DataType], most: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Rows gathered into batches of at most ``most``."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield batch(schema, **dict(zip(schema, zip(*held, strict=True), strict=True)))
            held = []
    if held:
        yield batch(schema, **dict(zip(schema, zip(*held, strict=True), strict=True)))


_TABLE = {"segment": pa.int32(), "cells": pa.binary()}


def _rows_of(table: np.ndarray, dtype: str) -> Iterator[pa.RecordBatch]:
    """The segments of a task's table in which anything is set, packed."""
    for at in range(0, len(table), SEGMENT):
        part = table[at:at + SEGMENT]
        if part.any():
            yield batch(_TABLE, segment=[at // SEGMENT], cells=[zlib.compress(part.astype(dtype).tobytes(), 1)])


def summed_tables(df: DataFrame, fill: Callable[[Iterator[pa.RecordBatch]], np.ndarray], cells: int, dtype: str = "<i8",
                  merge: Callable[[np.ndarray, np.ndarray], np.ndarray] = np.add) -> np.ndarray:
    """Each task fills a table of ``cells`` cells from its rows; the tables meet segment by segment in parallel tasks and the merged one comes
    to the driver. ``cells`` does not grow with the rows, so neither does what any task or the driver holds."""
    spark = df.sparkSession

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _rows_of(fill(batches), dtype)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for segment, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(blob), dtype)
                held[segment] = merge(held[segment], part) if segment in held else part
        for segment, part in held.items():
            yield batch(_TABLE, segment=[segment], cells=[zlib.compress(part.astype(dtype).tobytes(), 1)])

    segments = -(-cells // SEGMENT)
    spread = min(segments, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = mapped(mapped(df, local, "segment int, cells binary").repartition(spread, F.col("segment")), meet, "segment int, cells binary").collect()
    out = np.zeros(cells, dtype)
    for segment, blob in rows:
        part = np.frombuffer(zlib.decompress(bytes(blob)), dtype)
        out[segment * SEGMENT:segment * SEGMENT + len(part)] = part
    return out
