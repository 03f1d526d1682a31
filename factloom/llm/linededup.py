"""Line deduplication with two Bloom filters.

One pass over the texts fills a filter of line keys seen once and one of keys seen again (``repeats``). A second pass sends on only keys in the
second filter, as 128-bit digests with the id of their document; these are counted exactly. Where enough documents hold a key, its lines go from
all of them but the one with the largest id. Lines that nothing repeats never leave their task.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z lower-cased; keys of fewer than ``MIN_CHARS`` code points never
count. Defined results: a null or empty text is one empty line, and its kept text is empty; a key repeated inside a document counts once there,
and all its lines stay or go together; rows that share an id are one document; a null id is one document below all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.registry import query, table
from factloom.llm.repeats import FILTER_BITS, held, places, repeat_filter
from factloom.llm.shared import bounded_batches, mapped, written

MIN_CHARS = 20
MIN_DOCS = 3
BLANK = " \t\n\x0b\x0c\r"


def line_keys(text: str | None, min_chars: int = MIN_CHARS) -> set[bytes]:
    """The distinct keys of a text that are long enough to count."""
    stripped = (line.strip(BLANK) for line in (text or "").split("\n"))
    return {line.encode("utf-8", "surrogatepass").lower() for line in stripped if len(line) >= min_chars}


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def without_lines(text: str | None, gone: set[bytes], min_chars: int = MIN_CHARS) -> tuple[str, int, int]:
    """The text without the lines whose key digests are in ``gone``, its number of lines before, and how many went."""
    lines = (text or "").split("\n")
    if not gone:
        return text or "", len(lines), 0
    kept = []
    for line in lines:
        bare = line.strip(BLANK)
        if len(bare) < min_chars or digest(bare.encode("utf-8", "surrogatepass").lower()) not in gone:
            kept.append(line)
    return "\n".join(kept), len(lines), len(lines) - len(kept)


def repeated_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS,
                   bits: int = FILTER_BITS) -> DataFrame:
    """Line digests to drop by document: ``doc_id, gone`` (array of digests), for documents that lose lines only."""
    spark = docs.sparkSession
    texts = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"))

    def hashes_of(rows: pa.RecordBatch) -> Iterator[np.ndarray]:
        for t in rows.column(0).to_pylist():
            yield np.array([xxhash.xxh3_64_intdigest(k) for k in line_keys(t, min_chars)], np.uint64)

    again = spark.sparkContext.broadcast(repeat_filter(texts.select("text"), hashes_of, bits))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            ids, found, owner = rows.column(0), [], []
            for n, t in enumerate(rows.column(1).to_pylist()):
                keys = list(line_keys(t, min_chars))
                if keys:
                    hit = held(again.value, places(np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64), bits))
                    found += [digest(k) for k, h in zip(keys, hit, strict=True) if h]
                    owner += [n] * int(hit.sum())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(owner, pa.int64())), pa.array(found, pa.binary())], names=["doc_id", "line"])

    id_type = dict(texts.dtypes)["doc_id"]
    lines = written(mapped(texts, suspects, f"doc_id {id_type}, line binary"), "suspect-lines")
    by_doc = lines.groupBy("line", "doc_id").agg(F.count("*").alias("n"))
    counted = by_doc.groupBy("line").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper")).where(F.col("n_docs") >= min_docs)
    drops = written(counted.select("line", "keeper"), "dropped-lines")
    lost = lines.join(drops, "line").where(F.col("doc_id").isNull() | (F.col("doc_id") < F.col("keeper")))
    return lost.groupBy("doc_id").agg(F.collect_set("line").alias("gone"))


def deduplicated(docs: DataFrame, doc: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS,
                 bits: int = FILTER_BITS) -> DataFrame:
    """All documents with all their columns and ``__dedup``: a struct of the kept text, ``n_lines`` before and ``n_dropped``."""
    lost = repeated_lines(docs, doc, text, min_docs, min_chars, bits).select(F.col("doc_id").alias("__lost_id"), F.col("gone").alias("__gone"))
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("text string, n_lines bigint, n_dropped bigint")
    def rewritten(texts: pd.Series, gone: pd.Series) -> pd.DataFrame:
        rows = [without_lines(t, set(g) if g is not None else set(), min_chars) for t, g in zip(texts, gone, strict=True)]
        return pd.DataFrame(rows, columns=["text", "n_lines", "n_dropped"])

    joined = docs.join(lost.hint("shuffle_hash"), docs[doc].eqNullSafe(lost["__lost_id"]), "left")
    return joined.withColumn("__dedup", rewritten(F.col(text), F.col("__gone"))).drop("__lost_id", "__gone")


_SQL = """
WITH lines AS (
    SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
), often AS (
    SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
    SELECT l.*, o.key IS NOT NULL AND l.doc_id < o.keeper AS gone FROM lines l LEFT JOIN often o ON l.key = o.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op4_line_dedup", _SQL)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """All lines of all documents."""
    out = deduplicated(table(spark, folder, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("__dedup.n_lines").alias("n_lines"), F.col("__dedup.n_dropped").alias("n_dropped"),
                      F.sha2("__dedup.text", 256).alias("kept_sha256"))
