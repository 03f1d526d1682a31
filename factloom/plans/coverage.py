"""Coverage, states, constraints, admission and scoring, with events playing file states."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import coverage as cov
from factloom.plans.registry import query

# one file per event: state by event id, run by user
_STATE = ("CASE event_id % 11 WHEN 0 THEN 'discovered' WHEN 1 THEN 'downloading' WHEN 2 THEN 'embedding' WHEN 3 THEN 'retryable_failed' WHEN 4 THEN 'terminal_failed' "
          "WHEN 5 THEN 'unsupported' WHEN 6 THEN 'capped' WHEN 7 THEN 'terminal_failed' WHEN 8 THEN 'terminal_failed' ELSE 'ready' END")
_CODE = "CASE event_id % 11 WHEN 4 THEN 'not_found' WHEN 7 THEN 'invalid_csv' WHEN 8 THEN 'timeout' WHEN 3 THEN 'inaccessible' END"
_STAGE = "CASE event_id % 11 WHEN 4 THEN 'download' WHEN 7 THEN 'parse' WHEN 8 THEN 'parse' WHEN 3 THEN 'download' END"
_FILES = f"SELECT user_id AS run_id, event_id, {_STATE} AS status, {_CODE} AS code, {_STAGE} AS stage FROM events"
_RUNS = "SELECT user_id AS run_id, count(*) + user_id % 3 AS discovered, user_id % 4 <> 0 AS complete FROM events GROUP BY 1"


def _files(t):
    return t.events.selectExpr("user_id AS run_id", "event_id AS file_id", "'file ' || CAST(event_id AS STRING) AS source_name", f"{_STATE} AS status",
                               f"{_CODE} AS error_code", f"{_STAGE} AS error_stage", "CAST(value AS INT) AS n_blocks")


def _runs(t):
    return t.events.groupBy(F.col("user_id").alias("run_id")).agg(F.count(F.lit(1)).alias("n")).selectExpr(
        "run_id", "n + run_id % 3 AS discovered", "run_id % 4 <> 0 AS discovery_complete",
        "CASE WHEN run_id % 5 = 0 THEN array('failed', 'page_limit') ELSE array() END AS gap_reasons")


_MANIFEST = f"""f AS ({_FILES}), r AS ({_RUNS}), c AS (SELECT run_id, count_if(status = 'ready') AS ready,
  count_if(status IN ('discovered', 'downloading', 'embedding')) AS processing, count_if(code = 'timeout') AS failed, count_if(status = 'unsupported') AS unsupported,
  count_if(code IN ('not_found', 'inaccessible')) AS inaccessible, count_if(status = 'capped') AS capped, count_if(code = 'invalid_csv') AS unsafe_to_parse FROM f GROUP BY 1)"""


@query("coverage_manifest", f"""WITH {_MANIFEST}
SELECT r.run_id, discovered, ready, processing, failed, unsupported, inaccessible, capped, unsafe_to_parse, r.run_id % 3 AS unknown_branch FROM r JOIN c USING (run_id)""")
def coverage_manifest(t):
    return cov.coverage_manifest(_files(t), _runs(t)).select(
        "run_id", "discovered", "ready", "processing", "failed", "unsupported", "inaccessible", "capped", "unsafe_to_parse", "unknown_branch")


@query("coverage_gaps", f"""WITH {_MANIFEST},
b AS (SELECT run_id, list_filter([CASE WHEN processing > 0 THEN 'processing' END, CASE WHEN failed > 0 THEN 'failed' END, CASE WHEN unsupported > 0 THEN 'unsupported' END,
  CASE WHEN inaccessible > 0 THEN 'inaccessible' END, CASE WHEN capped > 0 THEN 'capped' END, CASE WHEN run_id % 3 > 0 THEN 'unknown_branch' END,
  CASE WHEN unsafe_to_parse > 0 THEN 'unsafe_to_parse' END, CASE WHEN run_id % 5 = 0 THEN 'page_limit' END], lambda x: x IS NOT NULL) AS g FROM c)
SELECT run_id, array_to_string(g, ',') || CASE WHEN run_id % 4 = 0 AND NOT list_has_any(g, ['capped', 'inaccessible', 'unknown_branch']) THEN
  CASE WHEN len(g) > 0 THEN ',' ELSE '' END || 'unknown_branch' ELSE '' END AS gaps FROM b""")
def coverage_gaps(t):
    return cov.coverage_gaps(cov.coverage_manifest(_files(t), _runs(t))).select("run_id", F.array_join("gaps", ",").alias("gaps"))


@query("source_issues", f"""WITH f AS ({_FILES})
SELECT run_id, 'file ' || CAST(event_id AS STRING) AS source_name, CASE WHEN code = 'not_found' THEN 'missing_file' WHEN code = 'inaccessible' THEN 'access_denied' WHEN code = 'invalid_csv'
  THEN 'unsafe_to_parse' WHEN code = 'timeout' THEN 'source_failed' ELSE status END AS kind FROM f WHERE code IS NOT NULL OR status IN ('capped', 'unsupported')
UNION ALL SELECT run_id, '', 'partial_sync' FROM f GROUP BY run_id HAVING run_id % 4 = 0 OR bool_or(status IN ('discovered', 'downloading', 'embedding'))""")
def source_issues(t):
    return cov.source_issues(_files(t), _runs(t)).select("run_id", F.coalesce("source_name", F.lit("")).alias("source_name"), "kind")


@query("run_progress", f"""
WITH f AS (SELECT {_STATE} AS s, * FROM events)
SELECT user_id AS run_id, count_if(s = 'discovered') AS queued, count_if(s IN ('downloading', 'embedding')) AS parsing, count_if(s = 'ready') AS ready,
  count_if(s LIKE '%failed') AS failed, count_if(s = 'unsupported') AS unsupported, count_if(s = 'capped') AS capped,
  CAST(coalesce(sum(CASE WHEN s = 'ready' THEN CAST(trunc(value) AS INT) END), 0) AS BIGINT) AS ready_blocks FROM f GROUP BY 1""")
def run_progress(t):
    return cov.run_progress(_files(t))


# states of each run taken from one event type only, so that all outcomes occur
_PICK = "CASE WHEN user_id % 4 = 0 THEN 'ready' WHEN user_id % 4 = 1 AND event_id % 2 = 0 THEN 'capped' WHEN user_id % 4 = 2 THEN 'terminal_failed' WHEN user_id % 4 = 3 AND event_id % 5 = 0 THEN 'parsed' ELSE 'ready' END"


@query("terminal_runs", f"""
WITH f AS (SELECT user_id, {_PICK} AS s FROM events)
SELECT user_id AS run_id, CASE WHEN bool_or(s = 'parsed') THEN 'unresolved' WHEN count_if(s = 'ready') = 0 THEN 'failed' WHEN count_if(s <> 'ready') > 0 OR user_id % 8 = 0 THEN 'partial' ELSE 'ready' END
  AS run_status FROM f GROUP BY 1""")
def terminal_runs(t):
    files = t.events.selectExpr("user_id AS run_id", f"{_PICK} AS status")
    return cov.terminal_status(files, files.select("run_id").distinct().withColumn("has_gaps", F.col("run_id") % 8 == 0))


@query("closed_snapshots", f"""WITH f AS ({_FILES})
SELECT event_id AS file_id, CASE WHEN status IN ('discovered', 'downloading', 'embedding', 'retryable_failed') THEN 'terminal_failed' ELSE status END AS status,
  coalesce(CASE WHEN status IN ('discovered', 'downloading', 'embedding') THEN 'stalled' ELSE code END, '') AS error_code,
  coalesce(CASE status WHEN 'discovered' THEN 'admission' WHEN 'downloading' THEN 'download' WHEN 'embedding' THEN 'embedding' ELSE stage END, '') AS error_stage FROM f""")
def closed_snapshots(t):
    c = cov.close_snapshot(_files(t), "stalled")
    return c.select("file_id", "status", F.coalesce("error_code", F.lit("")).alias("error_code"), F.coalesce("error_stage", F.lit("")).alias("error_stage"))


@query("unbalanced_counts", f"""WITH {_MANIFEST} SELECT run_id, 'counts_do_not_balance' AS violation FROM r WHERE run_id % 10 = 7""")
def unbalanced_counts(t):
    m = cov.coverage_manifest(_files(t), _runs(t))
    return cov.check_counts(m.withColumn("ready", F.col("ready") + F.when(F.col("run_id") % 10 == 7, 1).otherwise(0)))


@query("span_violations", """
SELECT doc_id AS citation_id, 'empty_span' AS violation FROM documents WHERE doc_id % 5 = 0 UNION ALL
SELECT doc_id, 'span_length' FROM documents WHERE CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 20 END <> length(substr(text, 1 + doc_id * 31 % greatest(length(text), 1), CASE WHEN doc_id % 7 = 0 THEN 15 ELSE 20 END)) UNION ALL SELECT doc_id, 'locator' FROM documents WHERE doc_id % 9 = 0""")
def span_violations(t):
    at = "CAST(doc_id * 31 % greatest(length(text), 1) AS INT)"
    c = t.documents.selectExpr("doc_id AS citation_id", f"{at} + CASE WHEN doc_id % 5 = 0 THEN 20 ELSE 0 END AS start", f"{at} + 20 AS stop",
                               f"substr(text, {at} + 1, CASE WHEN doc_id % 7 = 0 THEN 15 ELSE 20 END) AS quote", "CASE WHEN doc_id % 9 <> 0 THEN 3 END AS line_start", "CAST(NULL AS INT) AS page_index")
    return cov.check_spans(c)


@query("reference_violations", """
SELECT CAST(o_orderkey AS STRING) AS id, 'unused_citation' AS violation FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber < 5)
UNION ALL SELECT DISTINCT CAST(l_partkey AS STRING), 'unresolved_citation' FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber < 5 AND o_orderstatus = 'P'""")
def reference_violations(t):
    claims = t.lineitem.where("l_linenumber < 5").selectExpr("l_partkey AS claim_id", "l_orderkey AS citation_id")
    return cov.check_refs(claims, t.orders.where("o_orderstatus <> 'P'").selectExpr("o_orderkey AS citation_id"))


_PATH = ["discovered", "admitted", "downloading", "parsed", "embedding", "ready"]


@query("illegal_transitions", """
WITH s AS (SELECT user_id AS f, event_id AS q, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events),
l AS (SELECT f, q, CASE WHEN i = 5 AND f % 4 = 1 THEN 'terminal_failed' WHEN i < 6 THEN ['discovered', 'admitted', 'downloading', 'parsed', 'embedding', 'ready'][i + 1] ELSE 'parsed' END AS st,
  CASE WHEN f % 8 = 1 THEN 'embedding' ELSE 'parse' END AS stage, i FROM s), p AS (SELECT *, lag(st) OVER (PARTITION BY f ORDER BY q) AS pv FROM l)
SELECT f AS file_id, q AS seq, pv AS previous, st AS status FROM p WHERE (i = 5 AND st = 'terminal_failed' AND stage <> 'embedding') OR i >= 6""")
def illegal_transitions(t):
    from pyspark.sql import Window

    i = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    log = t.events.select(F.col("user_id").alias("file_id"), F.col("event_id").alias("seq"), i.alias("i"))
    status = (F.when((F.col("i") == 5) & (F.col("file_id") % 4 == 1), "terminal_failed")
              .when(F.col("i") < 6, F.get(F.array(*[F.lit(s) for s in _PATH]), F.col("i"))).otherwise("parsed"))
    log = log.withColumn("status", status).withColumn("error_stage", F.when(F.col("file_id") % 8 == 1, "embedding").otherwise("parse"))
    return cov.check_transitions(log)


@query("changes_after_publication", """
WITH f AS (SELECT user_id AS run_id, min(event_id) FILTER (WHERE event_id % 40 = 7) AS shown FROM events GROUP BY 1)
SELECT run_id, CASE WHEN event_id % 40 <> 7 THEN event_id % 5 END AS file_id, event_id AS seq, CASE WHEN event_id % 40 = 7 THEN 'partial' ELSE 'ready' END AS status, shown AS published_at
FROM events JOIN f ON f.run_id = user_id WHERE event_id > shown""")
def changes_after_publication(t):
    """Events as entries of their user's run, some of which publish it."""
    e = t.events.selectExpr("user_id AS run_id", "event_id % 5 AS file_id", "event_id AS seq", "CASE WHEN event_id % 40 = 7 THEN 'partial' ELSE 'ready' END AS status")
    return cov.changes_after_publication(e.where("status = 'ready'"), e.where("status = 'partial'").drop("file_id"))


@query("admitted_events", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, date_trunc('minute', ts) ORDER BY ts, event_id) AS k FROM events)
SELECT event_id, k <= 1 AS admitted, CAST(CASE WHEN k > 1 THEN 60 - floor(extract(second FROM ts)) ELSE 0 END AS BIGINT) AS retry_after FROM r""")
def admitted_events(t):
    a = cov.admission(t.events, "user_id", "ts", "event_id", 1)
    return a.select("event_id", "admitted", F.coalesce("retry_after", F.lit(0)).cast("long").alias("retry_after"))


@query("tiered_admission", """
WITH e AS (SELECT *, date_trunc('hour', ts) AS h FROM events), a AS (SELECT *, row_number() OVER (PARTITION BY user_id, h ORDER BY ts, event_id) AS k FROM e),
b AS (SELECT event_id, row_number() OVER (PARTITION BY h ORDER BY ts, event_id) AS m FROM a WHERE k <= 2)
SELECT a.event_id, CASE WHEN k > 2 THEN 'user_limit' WHEN m <= 10 THEN 'admitted' ELSE 'overall_limit' END AS tier FROM a LEFT JOIN b USING (event_id)""")
def tiered_admission(t):
    # one stored hour is played as one minute, so that both limits bite on these sparse events
    e = t.events.withColumn("at", F.expr("date_trunc('hour', ts) + make_dt_interval(0, 0, 0, (minute(ts) * 60 + second(ts)) / 60.1)"))
    return cov.admission_tiers(e, "user_id", "at", "event_id", 2, 10).select("event_id", "tier")



_SCORED = """
WITH v AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1)
SELECT k AS case_id, k % 3 <> 0 AND k % 5 <> 0 AS accuracy, k % 4 <> 0 AS citations, k % 7 <> 0 AS policy_ok, k % 5 <> 0 AS uncertainty,
  k % 3 <> 0 AND k % 5 <> 0 AND k % 4 <> 0 AND k % 7 <> 0 AS all_ok FROM v"""


@query("scored_case_means", f"""SELECT round(avg(accuracy::INT), 9) AS accuracy, round(avg(citations::INT), 9) AS citations, round(avg(policy_ok::INT), 9) AS policy_ok,
  round(avg(uncertainty::INT), 9) AS uncertainty, round(avg(all_ok::INT), 9) AS all_ok FROM ({_SCORED})""")
def scored_case_means(t):
    means = cov.score_means(scored_cases(t))
    return means.select(*[F.round(c, 9).alias(c) for c in means.columns])


@query("scored_cases", _SCORED)
def scored_cases(t):
    want = t.lineitem.groupBy(F.col("l_orderkey").alias("case_id")).agg(F.collect_list("l_linenumber").alias("values"))
    want = want.withColumn("status", F.lit("evidence_supported")).withColumn("policy", F.lit("v1"))
    k = F.col("case_id")
    got = want.select(
        "case_id", F.when(k % 3 == 0, F.concat(F.col("values"), F.array(F.lit(99)))).otherwise(F.reverse("values")).alias("values"),
        F.when(k % 5 == 0, "insufficient").otherwise("evidence_supported").alias("status"), F.when(k % 7 == 0, "v0").otherwise("v1").alias("policy"), (k % 4 != 0).alias("citations_ok"))
    return cov.score_cases(got, want)


# a case for each document, its two claims cited from the document's own block of a source with many blocks, which follow each other and share no line, as in a
# file (else a wrong line could be a right one of another block); faults by the document's number
_AT = "CAST(doc_id * 31 % greatest(length(text) - 20, 1) AS INT)"
_FIRST_LINE = "doc_id * 1000000000 + 3"
_LINE = f"{_FIRST_LINE} + length(left(text, {_AT})) - length(replace(left(text, {_AT}), chr(10), ''))"
_CASE_SOURCE = "'source ' || CAST(doc_id % 20 AS STRING)"


@query("citation_integrity", f"""
WITH f AS (SELECT doc_id AS case_id, length(text) < 20 OR doc_id % 3 = 0 OR doc_id % 5 = 0 AS lost, doc_id % 7 = 0 AS bare, doc_id % 11 = 0 AS unsupported,
  doc_id % 13 = 0 AS missing, doc_id % 17 = 0 AS forbidden, doc_id % 3 = 0 AS other FROM documents)
SELECT case_id, concat_ws(',', CASE WHEN forbidden THEN 'citation_forbidden' END, CASE WHEN bare THEN 'claim_without_citation' END, CASE WHEN lost THEN 'not_in_source' END,
  CASE WHEN missing THEN 'source_missing' END, CASE WHEN other OR unsupported THEN 'value_without_support' END) AS codes,
  NOT (lost OR bare OR unsupported OR missing OR forbidden) AS citations_ok FROM f""")
def citation_integrity(t):
    d = t.spread("documents")
    corpus = d.selectExpr("doc_id AS block_id", f"{_CASE_SOURCE} AS source", f"{_FIRST_LINE} AS line_start", "text")
    quoted = f"substr(text, {_AT} + 1, 20)"
    cites = d.selectExpr("doc_id AS citation_id", "doc_id AS case_id", "1 AS claim_id", f"{_CASE_SOURCE} AS source", f"{_AT} AS start", f"{_AT} + 20 AS stop",
                         f"CASE WHEN doc_id % 3 = 0 THEN repeat('~', 20) ELSE {quoted} END AS quote", f"{_LINE} + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS line_start")
    claims = d.selectExpr("doc_id AS case_id", "1 AS claim_id", f"CASE WHEN doc_id % 11 = 0 THEN 'not stated anywhere' ELSE substr({quoted}, 2, 9) END AS value").unionByName(
        d.where("doc_id % 7 = 0").selectExpr("doc_id AS case_id", "2 AS claim_id", "CAST(NULL AS STRING) AS value"))
    cases = d.selectExpr("doc_id AS case_id", f"array({_CASE_SOURCE}, CASE WHEN doc_id % 13 = 0 THEN 'elsewhere' ELSE {_CASE_SOURCE} END) AS sources",
                         "CASE WHEN doc_id % 17 = 0 THEN 'forbidden' ELSE 'required' END AS mode")
    return cov.citation_integrity(cases, claims, cites, corpus).select("case_id", F.array_join("codes", ",").alias("codes"), "citations_ok")


@query("verified_citations", """
SELECT doc_id AS citation_id, doc_id % 3 <> 0 AS quote_ok, doc_id % 4 <> 0 AS line_ok FROM documents""")
def verified_citations(t):
    at = "CAST(doc_id * 31 % greatest(length(text) - 20, 1) AS INT)"
    c = t.documents.selectExpr("doc_id AS citation_id", "doc_id AS file_id", f"{at} AS start", f"{at} + 20 AS stop",
                               f"CASE WHEN doc_id % 3 = 0 THEN 'other' ELSE substr(text, {at} + 1, 20) END AS quote",
                               f"1 + length(left(text, {at})) - length(replace(left(text, {at}), '\\n', '')) + CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS line_start")
    return cov.verify_citations(c, t.documents.withColumnRenamed("doc_id", "file_id"))


@query("regression_verdicts", """
SELECT o_orderkey AS case_id, CASE WHEN o_orderkey % 10 = 0 THEN 'missing' WHEN o_orderkey % 10 = 1 THEN 'unexpected' WHEN o_orderkey % 10 = 2 THEN 'duplicated'
  WHEN o_orderkey % 10 = 3 THEN 'fail' ELSE 'pass' END AS verdict FROM orders""")
def regression_verdicts(t):
    o = t.orders.selectExpr("o_orderkey AS case_id", "o_orderstatus AS status", "CAST(o_totalprice AS STRING) AS value")
    m = F.col("case_id") % 10
    actual = o.where(m != 0).withColumn("value", F.when(m == 3, "changed").otherwise(F.col("value")))
    actual = actual.unionByName(o.where(m == 2))
    return cov.regression_diff(actual, o.where(m != 1), ["status", "value"])
