"""Admission, answers, coverage and block streams.

Every job writes through ``foreachBatch`` so that a batch that runs again after a lost executor replaces its own rows or changes nothing. No job has a
watermark: rows count however late they come. Keyed results are merged into a fixed number of buckets by their key, so a table does not fall into
more parts with every batch; a batch becomes a version of the table, and of these the last two are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.operators import coverage
from factloom.operators.blocks import chunk_text
from factloom.sources import files as readers
from factloom.sources import versions

#: Buckets of a merged table; each batch rewrites those that its keys fall into.
BUCKETS = 16


def _sink(path: str):
    """Writes a micro-batch under its id, replacing what an earlier try of the same batch left."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)

    return write


def _merge(batch: DataFrame, path: str, key: list[str], rank: Column, buckets: int) -> None:
    """One row for each key: of the stored one and those of the batch, the one with the highest ``rank``. The same batch twice changes nothing."""
    spark = batch.sparkSession
    fresh = batch.withColumn("bucket", F.pmod(F.hash(*key), F.lit(buckets)))
    rest = [c for c in fresh.columns if c not in key]

    def best(stored: DataFrame) -> DataFrame:
        touched = stored.join(fresh.select("bucket").distinct(), "bucket", "left_semi").select(*fresh.columns)
        return touched.unionByName(fresh).groupBy(*key).agg(F.max_by(F.struct(*rest), rank).alias("s")).select(*key, "s.*")

    versions.commit(spark, path, best, ("bucket",), fresh.schema)
    versions.vacuum(spark, path)


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of what a stream has merged, without the number of the bucket."""
    return versions.read(spark, path).drop("bucket")


def stream_admission(events: DataFrame, user: str, ts: str, out: str, checkpoint: str, per_minute: int) -> StreamingQuery:
    """Counts per user and minute, by batch; ``read_admission`` adds them up and tells what is over the limit."""
    def write(batch: DataFrame, batch_id: int) -> None:
        counted = batch.groupBy(F.date_trunc("minute", ts).alias("minute"), user).agg(F.count(F.lit(1)).alias("n"))
        _sink(out)(counted.withColumn("per_minute", F.lit(per_minute)), batch_id)

    return events.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def read_admission(spark: SparkSession, out: str, user: str) -> DataFrame:
    rows = spark.read.parquet(out)
    counts = rows.groupBy("minute", user).agg(F.sum("n").alias("n"), F.max("per_minute").alias("_limit"))
    return counts.select("minute", user, "n", F.greatest(F.lit(0), F.col("n") - F.col("_limit")).alias("over"))


_SEEN = "batch long, scope string, who string, minute timestamp, n long"


def stream_decisions(events: DataFrame, user: str, ts: str, tiebreak: str, out: str, state: str, checkpoint: str, per_user: int, overall: int,
                     lateness_minutes: int | None = None) -> StreamingQuery:
    """Every event of a stream admitted or refused, with the seconds to wait, by a limit per user and one for all in each minute.

    Events of a batch come behind those of earlier batches, in a batch they are ordered by time. The counters are a versioned table in ``state`` whose rows
    know their batch: a batch that runs again counts from the rows of earlier ones only, so it decides as before and counts once. With
    ``lateness_minutes`` the counters of minutes that lie further behind the newest of earlier batches are let go, and later events of such a minute are counted from zero;
    without it they are kept for good. Lost executors and restarts change no decision.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = versions.read(spark, state, _SEEN).where(F.col("batch") < batch_id).groupBy("scope", "who", "minute").agg(F.sum("n").alias("n"))
        if lateness_minutes is not None:  # by the newest minute of earlier batches, so that a second run lets go of the same
            newest = before.agg(F.max("minute"))
            before = before.where(F.col("minute") >= newest.scalar() - F.make_dt_interval(mins=F.lit(lateness_minutes)))
        _sink(out)(coverage.admission_after(batch, user, ts, tiebreak, per_user, overall, before), batch_id)
        place = f"{out}/batch_id={batch_id}"
        if batch.isEmpty():
            return
        fresh = coverage.seen_in(spark.read.parquet(place), user).withColumn("batch", F.lit(batch_id).cast("long"))
        rows = before.withColumn("batch", F.lit(batch_id - 1).cast("long")).unionByName(fresh)
        versions.commit(spark, state, rows.select("batch", "scope", "who", "minute", "n"), schema=_SEEN, whole=True)
        versions.vacuum(spark, state)

    return events.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def stream_answers(drafts: DataFrame, key: list[str], ts: str, out: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Each idempotency key once, whenever it is sent again: the stored answer stays, and of several in one batch the earliest counts."""
    def write(batch: DataFrame, batch_id: int) -> None:
        numbered = batch.withColumn("batch_id", F.lit(batch_id).cast("long"))
        _merge(numbered, out, key, F.struct(-F.col("batch_id"), -F.unix_micros(F.col(ts).cast("timestamp"))), buckets)

    return drafts.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def stream_states(changes: DataFrame, out: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Newest state per file, merged with what is stored."""
    def write(batch: DataFrame, batch_id: int) -> None:
        rest = [c for c in batch.columns if c not in ("run_id", "file_id")]
        _merge(batch, out, ["run_id", "file_id"], F.struct("seq", *[c for c in rest if c != "seq"]), buckets)

    return changes.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def read_states(spark: SparkSession, out: str) -> DataFrame:
    return read_merged(spark, out)


def stream_coverage(spark: SparkSession, out: str, runs: DataFrame) -> DataFrame:
    """Coverage manifest from the states the stream has seen so far."""
    return coverage.coverage_manifest(read_states(spark, out), runs)


def stream_chunks(texts: DataFrame, keys: list[str], out: str, checkpoint: str, text: str = "text") -> StreamingQuery:
    """Addressed blocks of the texts of a stream."""
    def write(batch: DataFrame, batch_id: int) -> None:
        _sink(out)(chunk_text(batch, keys, text), batch_id)

    return texts.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def stream_blocks(spark: SparkSession, folder: str, out: str, checkpoint: str, glob: str = "*.txt") -> StreamingQuery:
    """New text files of a folder to addressed blocks, each file once."""
    incoming = (spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
                .option("pathGlobFilter", glob).load(folder).select("path", "content"))

    def write(batch: DataFrame, batch_id: int) -> None:
        text = readers.read_text(batch)
        _sink(out)(chunk_text(text.where("error IS NULL"), ["path"]), batch_id)

    return incoming.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
