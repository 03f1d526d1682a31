"""Admission per event on a stream: equal to the batch rule over several batches, after a restart, and when a batch runs twice."""

from pyspark.sql import functions as F

from factloom.operators import coverage
from factloom.sources import versions
from factloom.streaming import jobs

EVENTS = "id long, who string, at timestamp"


def send(spark, folder, name, rows):
    spark.createDataFrame(rows, "id long, who string, at string").selectExpr("id", "who", "CAST(at AS timestamp) AS at").coalesce(1).write.parquet(str(folder / name))


def run(spark, folder, tmp_path, **more):
    stream = spark.readStream.schema(EVENTS).option("recursiveFileLookup", "true").parquet(str(folder))
    jobs.stream_decisions(stream, "who", "at", "id", str(tmp_path / "out"), str(tmp_path / "state"), str(tmp_path / "ckpt"), 2, 3, **more).awaitTermination()
    return {r.id: (r.tier, r.retry_after) for r in spark.read.parquet(str(tmp_path / "out")).collect()}


def test_decisions_equal_the_batch_rule_over_batches(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    rows = [(i, [f"u{i % 3}", None][i % 5 == 4], f"2024-01-01 10:0{i // 14}:{i % 14 * 4:02d}") for i in range(42)]
    for n in range(4):
        send(spark, folder, f"part{n}", rows[n * 11:(n + 1) * 11])
        got = run(spark, folder, tmp_path)
    events = spark.read.parquet(*[str(folder / f"part{n}") for n in range(4)])
    want = {r.id: r.tier for r in coverage.admission_tiers(events, "who", "at", "id", 2, 3).collect()}
    assert {k: v[0] for k, v in got.items()} == want and set(want.values()) == {"admitted", "user_limit", "overall_limit"}
    seconds = dict(events.select("id", F.second("at")).collect())
    assert all(v[1] == (None if v[0] == "admitted" else 60 - seconds[k]) for k, v in got.items())


def test_a_batch_that_runs_again_decides_as_before(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    send(spark, folder, "a", [(1, "u", "2024-01-01 10:00:01"), (2, "u", "2024-01-01 10:00:02")])
    run(spark, folder, tmp_path)
    send(spark, folder, "b", [(3, "u", "2024-01-01 10:00:03"), (4, "v", "2024-01-01 10:00:04"), (5, "w", "2024-01-01 10:00:05")])
    first = run(spark, folder, tmp_path)
    (tmp_path / "ckpt" / "commits" / "1").unlink()  # as if the session had been lost after the batch was written
    for crc in (tmp_path / "ckpt" / "commits").glob(".1.crc"):
        crc.unlink()
    assert run(spark, folder, tmp_path) == first == {
        1: ("admitted", None), 2: ("admitted", None), 3: ("user_limit", 57), 4: ("admitted", None), 5: ("overall_limit", 55)}
    seen = versions.read(spark, str(tmp_path / "state"), jobs._SEEN)
    assert sorted((r.scope, r.who or "", r.n) for r in seen.groupBy("scope", "who").agg(F.sum("n").alias("n")).collect()) == [
        ("all", "", 4), ("user", "u", 3), ("user", "v", 1), ("user", "w", 1)]


def test_old_counters_are_let_go(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    send(spark, folder, "a", [(1, "u", "2024-01-01 10:00:01"), (2, "u", "2024-01-01 10:05:00")])
    run(spark, folder, tmp_path, lateness_minutes=2)
    send(spark, folder, "b", [(3, "u", "2024-01-01 10:05:01"), (4, "u", "2024-01-01 10:00:02")])
    got = run(spark, folder, tmp_path, lateness_minutes=2)
    assert {k: v[0] for k, v in got.items()} == dict.fromkeys((1, 2, 3, 4), "admitted")
    send(spark, folder, "c", [(5, "u", "2024-01-01 10:05:02")])
    assert run(spark, folder, tmp_path, lateness_minutes=2)[5] == ("user_limit", 58)
    state = versions.read(spark, str(tmp_path / "state"), jobs._SEEN)
    assert {str(r.minute) for r in state.collect()} == {"2024-01-01 10:05:00"}
