"""Query registry and lazy table access."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """``t.orders`` reads ``orders.parquet`` of the scale-factor folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread(self, name: str) -> DataFrame:
        """A table for work that is heavy per row, as its files are split; a session that sets ``spark.factloom.spread`` deals it out anew to so many tasks.

        Only that setting decides. Tables of one row group, as in tests and on one machine, give a single task without it.
        """
        df = getattr(self, name)
        tasks = self.spark.conf.get("spark.factloom.spread", None)
        return df.repartition(int(tasks)) if tasks else df

    def dealt(self, name: str) -> DataFrame:
        """A table of short rows each of which makes much work, dealt out to a few tasks a core: however large the work, the files of such a table are few."""
        tasks = self.spark.conf.get("spark.factloom.spread", None)
        return getattr(self, name).repartition(int(tasks) if tasks else 4 * self.spark.sparkContext.defaultParallelism)


def query(name: str, sql: str | None = None):
    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap
