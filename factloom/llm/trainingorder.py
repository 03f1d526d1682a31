"""Training-order materialisation: token sequences in a keyed random order, as fixed-stride binary shards.

Texts are tokenised and packed, an end token after each, into sequences of ``length`` tokens inside every task; the last sequence of a task is filled
up with end tokens. A sequence's number is the count of those in the tasks before plus its place in its own. A keyed Feistel network permutes the numbers:
it works on the next even number of bits, and numbers that leave the range walk on through it until they are back inside. The result is the
sequence's global slot; no list of the order exists anywhere, and both ways are arithmetic.

A shard holds a fixed run of slots as raw little-endian 16-bit tokens after a header, so the place of every slot follows from its number, and a reader can
start or resume anywhere. The shard of a slot is a division, so sequences are dealt to the tasks by it directly, a run of slots each; a task writes its shard
under a temporary name first, and writes the same bytes if it runs again. A folder without a scheme lies on the file system that the cluster's paths lie on.

Defined results: a null or empty text is its end token alone; rows that share an id are separate texts; an empty table gives no shard. Packing follows the
input's splits, so another split of the same rows numbers their sequences anew.
"""

from __future__ import annotations

import base64
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.registry import query, table
from factloom.llm.shared import mapped, scratch_folder, written

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
END = 50256
LENGTH = 2048
#: Sequences of one shard at most: 32 MB of 2,048 tokens each.
SHARD = 8192
KEY = 20240229
MAGIC = b"FLSEQ001"
#: Magic, tokens of a sequence, bytes of a token, first slot, number of slots.
HEADER = "<8sIIQQ"
HEADER_BYTES = struct.calcsize(HEADER)
ROUNDS = 4


def public_vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_loaded: dict[str, object] = {}


def tokenizer(path: str):
    if path not in _loaded:
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        _loaded[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def _round(half: np.ndarray, key: int, number: int) -> np.ndarray:
    """Keyed round function (finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = half + np.uint64((key * 0x9E3779B97F4A7C15 + number * 0xD1B54A32D192ED03) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def permuted(numbers: np.ndarray, size: int, key: int = KEY, back: bool = False) -> np.ndarray:
    """The slot of each number in ``range(size)``, or with ``back`` the number of each slot."""
    width = np.uint64(max(1, ((size - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << width) - np.uint64(1)
    out = np.array(numbers, np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> width, out[todo] & mask
        for k in range(ROUNDS):
            if back:
                left, right = right ^ (_round(left, key, ROUNDS - 1 - k) & mask), left
            else:
                left, right = right, left ^ (_round(right, key, k) & mask)
        out[todo] = left << width | right
        todo = todo[out[todo] >= size]
    return out.astype(np.int64)


_SEQUENCE = {"part": pa.int32(), "place": pa.int64(), "doc_ids": pa.list_(pa.int64()), "n_tokens": pa.int32(), "tokens": pa.binary()}


def sequences(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """Packed sequences: task and place in it, the documents with tokens in it, the number of its tokens without filling, and the tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode_ordinary
        part, place = TaskContext.get().partitionId(), 0
        rest, owners = np.zeros(0, np.uint16), []  # tokens that wait for a full sequence, and (document, tokens) of each piece of them

        def cut(tokens: np.ndarray, runs: list[tuple[int | None, int]], last: bool) -> tuple[np.ndarray, list, list]:
            nonlocal place
            rows, at, k = [], 0, 0
            while len(tokens) - at >= length or (last and at < len(tokens)):
                piece, need, ids = tokens[at:at + length], length, []
                while need and k < len(runs):
                    doc, count = runs[k]
                    ids.append(doc)
                    if count > need:
                        runs[k], need = (doc, count - need), 0
                    else:
                        need -= count
                        k += 1
                full = np.concatenate((piece, np.full(length - len(piece), END, np.uint16))) if len(piece) < length else piece
                rows.append((part, place, ids, len(piece), full.astype("<u2").tobytes()))
                place += 1
                at += length
            return tokens[at:], runs[k:], rows

        def as_batch(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SEQUENCE.values(), strict=True)], names=list(_SEQUENCE))

        for rows in batches:
            coded = [np.array([*encode(t or ""), END], np.uint16) for t in rows.column(1).to_pylist()]
            owners += list(zip(rows.column(0).to_pylist(), map(len, coded), strict=True))
            rest, owners, done = cut(np.concatenate([rest, *coded]), owners, False)
            if done:
                yield as_batch(done)
        rest, owners, done = cut(rest, owners, True)
        if done:
            yield as_batch(done)

    return mapped(docs.select(F.col("doc_id").cast("bigint"), "text"), run, "part int, place bigint, doc_ids array<bigint>, n_tokens int, tokens binary")


def located(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme and authority that Spark resolves it to, in the form that Arrow opens."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    scheme, colon, rest = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString().partition(":")
    return {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + colon + (rest if rest.startswith("//") else f"//{rest}")


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def materialised(docs: DataFrame, folder: str, path: str, key: int = KEY, length: int = LENGTH, shard_size: int | None = None) -> DataFrame:
    """Writes all shards below ``folder`` and returns their index: ``slot, shard, at`` (byte in its shard), ``doc_ids, n_tokens, crc32`` (of the record).

    ``shard_size`` is the number of slots of a shard; unset, the slots are dealt evenly to as many shards as the session has shuffle partitions, or to
    more where shards would pass ``SHARD`` slots.
    """
    spark = docs.sparkSession
    folder = located(spark, folder)
    rows = written(sequences(docs, path, length), "sequences", "zstd")  # many sequences in a row compress better than each alone
    counts = dict(rows.groupBy("part").count().collect())  # a number for each task
    before, total = {}, 0
    for part in sorted(counts):
        before[part] = total
        total += counts[part]
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = shard_size or max(1, min(SHARD, -(-total // spread)))
    shards = max(1, -(-total // size))

    @F.pandas_udf("bigint")
    def slot(part: pd.Series, place: pd.Series) -> pd.Series:
        return pd.Series(permuted(part.map(before).to_numpy(np.int64) + place.to_numpy(np.int64), total, key))

    @F.pandas_udf("binary")
    def packed(tokens: pd.Series) -> pd.Series:
        squeeze = zstandard.ZstdCompressor(level=9).compress
        return pd.Series([squeeze(t) for t in tokens], dtype=object)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        loosen = zstandard.ZstdDecompressor().decompress
        out, current, temporary = None, None, ""

        def close() -> None:
            if out is not None:
                out.close()
                store.move(temporary, f"{base}/{shard_name(current)}")

        for b in batches:
            slots, shard_of, ids, tokens, packed = (b.column(k).to_pylist() for k in range(5))
            places, checks = [], []
            for number, shard, blob in zip(slots, shard_of, packed, strict=True):
                if shard != current:
                    close()
                    current, temporary = shard, f"{base}/_{shard_name(shard)}-{uuid.uuid4().hex}"
                    out = store.open_output_stream(temporary)
                    out.write(struct.pack(HEADER, MAGIC, length, 2, shard * size, min(size, total - shard * size)))
                record = loosen(blob)
                out.write(record)
                places.append(HEADER_BYTES + (number - shard * size) * length * 2)
                checks.append(zlib.crc32(record))
            columns = [b.column(0), b.column(1), pa.array(places, pa.int64()), b.column(2), b.column(3), pa.array(checks, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["slot", "shard", "at", "doc_ids", "n_tokens", "crc32"])
        close()

    dealt = (rows.select(slot("part", "place").alias("slot"), "doc_ids", "n_tokens", packed("tokens").alias("packed")).withColumn("shard", F.expr(f"slot div {size}"))
             .select("slot", "shard", "doc_ids", "n_tokens", "packed").repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("slot"))
    return written(mapped(dealt, write, "slot bigint, shard bigint, at bigint, doc_ids array<bigint>, n_tokens int, crc32 bigint"), "shard-index")


def read_slots(folder: str, first: int, count: int, shard_size: int) -> np.ndarray:
    """Tokens of ``count`` slots from ``first`` on, a row for each; reads nothing else. ``folder`` as ``located`` gives it."""
    store, base = fs.FileSystem.from_uri(folder)
    parts = []
    while count > 0:
        shard = first // shard_size
        with store.open_input_file(f"{base}/{shard_name(shard)}") as source:
            magic, length, width, start, held = struct.unpack(HEADER, source.read(HEADER_BYTES))
            if magic != MAGIC or not start <= first < start + held:
                raise ValueError(f"no slot {first} in shard {shard}")
            some = min(count, start + held - first)
            source.seek(HEADER_BYTES + (first - start) * length * width)
            parts.append(np.frombuffer(source.read(some * length * width), "<u2").reshape(some, length))
        first, count = first + some, count - some
    return np.concatenate(parts)


@query("op5_training_order")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """All whole documents tokenised and written in training order; the index of the written shards."""
    return materialised(table(spark, folder, "documents"), scratch_folder(spark, "training-order"), public_vocabulary())
