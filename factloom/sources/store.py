"""Writers: idempotent answers, replaced manifests and blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.sources import versions

ANSWERS = "workspace_id long, key string, question string, ordinal long"


def plan_answers(new: DataFrame, existing: DataFrame) -> DataFrame:
    """What becomes of each new answer ``(workspace_id, key, question)``: ``append`` with its ordinal, ``replay`` or ``conflict``.

    The same key with the same question is the stored answer again; with another question it is a conflict. A key
    that comes twice in one batch counts once.
    """
    once = new.groupBy("workspace_id", "key").agg(F.min("question").alias("question"), F.count_distinct("question").alias("variants"))
    stored = existing.select("workspace_id", "key", F.col("question").alias("_old"), F.col("ordinal").alias("_ord"))
    j = once.join(stored, ["workspace_id", "key"], "left")
    j = j.withColumn("action", F.when(F.col("variants") > 1, "conflict").when(F.col("_old").isNull(), "append")
                     .when(F.col("_old") == F.col("question"), "replay").otherwise("conflict"))
    tops = existing.groupBy("workspace_id").agg(F.max("ordinal").alias("_top"))
    w = Window.partitionBy("workspace_id").orderBy("key")
    fresh = j.where("action = 'append'").withColumn("_n", F.row_number().over(w)).join(tops, "workspace_id", "left")
    fresh = fresh.select("workspace_id", "key", "question", "action", (F.coalesce("_top", F.lit(0)) + F.col("_n")).cast("long").alias("ordinal"))
    rest = j.where("action <> 'append'").select("workspace_id", "key", "question", "action", F.col("_ord").cast("long").alias("ordinal"))
    return fresh.unionByName(rest)


def write_answers(new: DataFrame, path: str) -> int:
    """Adds the answers which ``plan_answers`` marks, as a new version; a second run of the same batch adds nothing. Writers at the same time never give
    out the same ordinal: the second plans again on what the first has stored."""
    def planned(existing: DataFrame) -> DataFrame:
        return plan_answers(new, existing).where("action = 'append'").select(
            F.col("workspace_id").cast("long").alias("workspace_id"), "key", "question", "ordinal")

    return versions.commit(new.sparkSession, path, planned, schema=ANSWERS)


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    return versions.read(spark, path, ANSWERS)


def write_manifest(files: DataFrame, path: str) -> int:
    """Replaces the manifests of all runs in ``files`` in one step, leaving other runs as they are; ``versions.read`` sees the old or the new ones."""
    return versions.commit(files.sparkSession, path, files, ("run_id",))


def write_blocks(blocks: DataFrame, path: str) -> int:
    """Replaces the blocks of the files handed in, by (run, file bucket), in one step; other files' blocks in the same buckets stay. ``blocks`` has ``file_id``."""
    def merged(stored: DataFrame) -> DataFrame:
        beside = stored.join(blocks.select("run_id", "bucket").distinct(), ["run_id", "bucket"], "left_semi").join(
            blocks.select("run_id", "file_id").distinct(), ["run_id", "file_id"], "left_anti")
        return blocks.unionByName(beside)

    return versions.commit(blocks.sparkSession, path, merged, ("run_id", "bucket"), blocks.schema)
