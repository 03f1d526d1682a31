"""The corpus pipeline: five stages over ``documents``, each written as a table and read again by the next.

Every stage takes ``(spark, docs, sf_dir)``, works on all rows it is given and, but for the last, returns the columns it was given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.decontamination import decontaminated
from factloom.llm.jaccardjoin import one_of_each
from factloom.llm.linededup import deduplicated
from factloom.llm.pieces import encoded, public_model
from factloom.llm.quality import THRESHOLD, fitted, scored
from factloom.llm.registry import table
from factloom.llm.shared import written

#: Near copies in the pipeline: five-word shingles, similarity of 0.8 or more.
NEAR_WIDTH = 5
NEAR_PERCENT = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    vectors, network = fitted(docs, table(spark, sf_dir, "labels"))
    return scored(docs, vectors, network, "__score").where(F.col("__score") >= THRESHOLD).drop("__score")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that other documents keep; ``n_chars`` follows the text."""
    changed = F.col("__dedup.n_dropped") > 0
    new = {"text": F.when(changed, F.col("__dedup.text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.char_length("__dedup.text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return deduplicated(docs).withColumns(new).drop("__dedup")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    return one_of_each(docs, NEAR_WIDTH, NEAR_PERCENT)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with a benchmark item."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's ids with the end id, and digests of them and of the text they decode to."""
    found = encoded(docs, public_model())
    return found.select("doc_id", F.size("pieces.ids").cast("bigint").alias("n_tokens"), F.col("pieces.ids").alias("ids"),
                        F.sha2(F.array_join("pieces.ids", " "), 256).alias("ids_sha256"), F.sha2("pieces.decoded", 256).alias("decoded_sha256"))


STAGES = [("quality_classifier", quality), ("line_dedup", line_dedup), ("near_copies", near_copies), ("decontamination", benchmark_free), ("sentencepiece", pieces)]

#: The classifier and the encoder have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
