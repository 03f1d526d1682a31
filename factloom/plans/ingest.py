"""Folder expansion, admission of files, caps, file parsing and writers."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import hierarchy
from factloom.plans.registry import query
from factloom.session import scratch_path
from factloom.sources import files as readers
from factloom.sources import store, versions

# world > region > nation > segment (folders) > customers; rich ones are folders themselves, and nations link back to the world
_SEGMENT = "'s' || CAST(c_nationkey AS STRING) || c_mktsegment"


def _edges(t):
    world = t.region.selectExpr("'world' AS parent_id", "'r' || CAST(r_regionkey AS STRING) AS id", "r_name AS name", "true AS is_folder", "false AS trashed")
    nation = t.nation.selectExpr("'r' || CAST(n_regionkey AS STRING)", "'n' || CAST(n_nationkey AS STRING)", "n_name", "true", "false")
    back = t.nation.selectExpr("'n' || CAST(n_nationkey AS STRING)", "'world'", "'World'", "true", "false")
    seg = t.customer.selectExpr("'n' || CAST(c_nationkey AS STRING)", _SEGMENT, "c_mktsegment", "true", "c_nationkey = 7").distinct()
    cust = t.customer.selectExpr(_SEGMENT, "'c' || CAST(c_custkey AS STRING)", "c_name", "c_acctbal > 9000", "c_acctbal < -900")
    deep = t.customer.where("c_acctbal > 9000").selectExpr("'c' || CAST(c_custkey AS STRING)", "'d' || CAST(c_custkey AS STRING)", "'deep'", "false", "false")
    out = world
    for part in (nation, back, seg, cust, deep):
        out = out.union(part)
    return out


_PLACED = f"""c AS (SELECT 'c' || CAST(c_custkey AS STRING) AS id, 'World/' || r_name || '/' || n_name || '/' || c_mktsegment || '/' || c_name AS path, c_acctbal, {_SEGMENT} AS seg
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_nationkey <> 7)"""


@query("expanded_hierarchy", f"""WITH {_PLACED}
SELECT 'r' || CAST(r_regionkey AS STRING) AS id, 1 AS depth, 'World/' || r_name AS path, false AS trashed FROM region
UNION ALL SELECT 'n' || CAST(n_nationkey AS STRING), 2, 'World/' || r_name || '/' || n_name, false FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'world', 3, 'World/' || r_name || '/' || n_name || '/World', false FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT DISTINCT {_SEGMENT}, 3, 'World/' || r_name || '/' || n_name || '/' || c_mktsegment, c_nationkey = 7 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT id, 4, path, c_acctbal < -900 FROM c""")
def expanded_hierarchy(t):
    roots = t.spark.createDataFrame([("world", "World")], "id string, name string")
    res, _ = hierarchy.expand_hierarchy(_edges(t), roots, max_depth=3)
    return res.select("id", "depth", F.array_join("path", "/").alias("path"), "trashed")


@query("hierarchy_gaps", f"""WITH {_PLACED} SELECT id, path, 'depth_limit' AS reason FROM c WHERE c_acctbal > 9000""")
def hierarchy_gaps(t):
    roots = t.spark.createDataFrame([("world", "World")], "id string, name string")
    _, gaps = hierarchy.expand_hierarchy(_edges(t), roots, max_depth=3)
    return gaps.select("id", F.array_join("path", "/").alias("path"), "reason")


_MIME = ("CASE doc_id % 6 WHEN 0 THEN 'text/csv' WHEN 1 THEN 'application/pdf' WHEN 2 THEN 'text/plain' WHEN 3 THEN 'image/png' "
         "WHEN 4 THEN 'application/vnd.google-apps.shortcut' ELSE 'application/vnd.google-apps.document' END")
_NAME = "source || '.' || CASE WHEN doc_id % 4 = 0 THEN 'CSV' WHEN doc_id % 4 = 1 THEN 'pdf' WHEN doc_id % 4 = 2 THEN 'md' ELSE 'x' END"
_REASON = """CASE doc_id % 6 WHEN 0 THEN CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'mime_extension_conflict' END WHEN 1 THEN CASE WHEN doc_id % 4 = 1 THEN '' ELSE 'mime_extension_conflict' END
  WHEN 2 THEN CASE WHEN doc_id % 4 = 2 THEN '' ELSE 'mime_extension_conflict' END WHEN 3 THEN 'unsupported_mime_type' WHEN 4 THEN 'shortcut_not_followed' ELSE '' END"""


def _classified(t):
    f = t.documents.selectExpr("doc_id AS file_id", "lang AS run_id", f"{_NAME} AS name", f"{_MIME} AS mime", "doc_id % 10 = 0 AS trashed")
    return hierarchy.classify_files(f)


@query("classified_files", f"""
SELECT doc_id AS file_id, {_REASON} AS reason, CASE WHEN {_REASON} <> '' THEN '' ELSE CASE doc_id % 6 WHEN 0 THEN 'csv' WHEN 1 THEN 'pdf' ELSE 'plain_text' END END AS parser,
  CASE WHEN {_REASON} <> '' THEN '' ELSE CASE doc_id % 6 WHEN 2 THEN 'download_text' WHEN 5 THEN 'export_text' ELSE 'download_binary' END END AS mode FROM documents""")
def classified_files(t):
    e = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return _classified(t).select("file_id", e("reason"), e("parser"), e("mode"))


@query("discovery_summary", f"""
WITH f AS (SELECT lang AS run_id, {_REASON} = '' AS ok, doc_id % 10 = 0 AS trashed FROM documents)
SELECT run_id, count(*) AS seen, count_if(trashed) AS skipped_trashed, count_if(NOT trashed) AS discovered, count_if(NOT trashed AND ok) AS queued,
  count_if(NOT trashed AND NOT ok) AS unsupported, CAST(0 AS BIGINT) AS capped, CASE WHEN count_if(NOT trashed AND NOT ok) > 0 THEN 'unsupported' ELSE '' END ||
  CASE run_id WHEN 'de' THEN ',capped' WHEN 'fr' THEN ',inaccessible' ELSE '' END AS reasons, 'partial' AS status FROM f GROUP BY 1""")
def discovery_summary(t):
    gaps = t.documents.select(F.col("lang").alias("run_id")).distinct().withColumn(
        "reason", F.when(F.col("run_id") == "de", "depth_limit").when(F.col("run_id") == "fr", "not_found")).where("reason IS NOT NULL")
    return hierarchy.discovery_summary(_classified(t), gaps).withColumn("reasons", F.array_join("coverage_reasons", ",")).drop("coverage_reasons")


@query("capped_files", """
WITH RECURSIVE f AS (SELECT source AS run_id, doc_id, n_chars, CAST(ceil(n_chars / 400.0) AS INT) AS nb, row_number() OVER (PARTITION BY source ORDER BY doc_id % 3 <> 0, doc_id) AS k FROM documents),
s(run_id, doc_id, k, rem, outcome) AS (
  SELECT run_id, CAST(-1 AS BIGINT), CAST(0 AS BIGINT), 60, '' FROM (SELECT DISTINCT run_id FROM f)
  UNION ALL SELECT f.run_id, f.doc_id, f.k, CASE WHEN s.rem > 0 AND f.n_chars <= 20000 AND f.nb <= s.rem THEN s.rem - f.nb ELSE s.rem END,
    CASE WHEN s.rem = 0 THEN 'block_cap' WHEN f.n_chars > 20000 THEN 'file_size_limit' WHEN f.nb > s.rem THEN 'block_cap' ELSE 'accepted' END
  FROM s JOIN f ON f.run_id = s.run_id AND f.k = s.k + 1)
SELECT run_id, doc_id AS file_id, outcome FROM s WHERE k > 0""")
def capped_files(t):
    f = t.documents.selectExpr("source AS run_id", "doc_id AS file_id", "doc_id AS ordinal", "doc_id % 3 = 0 AS is_pdf", "n_chars AS bytes",
                               "CAST(ceil(n_chars / 400.0) AS INT) AS n_blocks", "CAST(0 AS INT) AS used")
    return hierarchy.apply_caps(f, 20000, 60).select("run_id", "file_id", "outcome")


_CSV = ("'Order,Quantity , Flag' || chr(13) || chr(10) || chr(10) || CAST(l_orderkey AS STRING) || ',\"' || CAST(l_quantity AS STRING) || '\",' || l_returnflag || chr(10) || "
        "'ragged,row' || chr(10) || 'second,  a   b ,' || l_linestatus || CASE WHEN l_linenumber = 7 THEN '\"x' ELSE '' END")


@query("csv_cells", """
WITH l AS (SELECT CAST(l_orderkey * 10 + l_linenumber AS STRING) AS path, * FROM lineitem)
SELECT path, 1 AS row_ord, 2 AS line_no, 'Order' AS header, CAST(l_orderkey AS STRING) AS raw, 1 AS malformed FROM l WHERE l_linenumber <> 7
UNION ALL SELECT path, 1, 2, 'Quantity', CAST(l_quantity AS STRING), 1 FROM l WHERE l_linenumber <> 7 UNION ALL SELECT path, 1, 2, 'Flag', l_returnflag, 1 FROM l WHERE l_linenumber <> 7
UNION ALL SELECT path, 2, 4, 'Order', 'second', 1 FROM l WHERE l_linenumber <> 7 UNION ALL SELECT path, 2, 4, 'Quantity', 'a b', 1 FROM l WHERE l_linenumber <> 7
UNION ALL SELECT path, 2, 4, 'Flag', l_linestatus, 1 FROM l WHERE l_linenumber <> 7
UNION ALL SELECT path, 1, 2, 'Order', CAST(l_orderkey AS STRING), 1 FROM l WHERE l_linenumber = 7 UNION ALL SELECT path, 1, 2, 'Quantity', CAST(l_quantity AS STRING), 1 FROM l WHERE l_linenumber = 7
UNION ALL SELECT path, 1, 2, 'Flag', l_returnflag, 1 FROM l WHERE l_linenumber = 7 UNION ALL SELECT path, 2, 4, 'Order', 'second', 1 FROM l WHERE l_linenumber = 7
UNION ALL SELECT path, 2, 4, 'Quantity', 'a b', 1 FROM l WHERE l_linenumber = 7 UNION ALL SELECT path, 2, 4, 'Flag', l_linestatus || '"x', 1 FROM l WHERE l_linenumber = 7""")
def csv_cells(t):
    f = t.spread("lineitem").selectExpr("CAST(l_orderkey * 10 + l_linenumber AS STRING) AS path", f"CAST({_CSV} AS BINARY) AS content")
    return readers.parse_csv_tables(f).select("path", "row_ord", "line_no", "header", "raw", "malformed")


@query("text_files", r"""
SELECT doc_id AS path, CASE WHEN doc_id % 20 = 0 THEN 'invalid_encoding' WHEN doc_id % 20 = 1 THEN 'no_text' ELSE '' END AS error,
  CASE WHEN doc_id % 20 < 2 THEN 0 ELSE length(trim(regexp_replace(regexp_replace(text, '[^\S\n]+(\n|$)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9))) END AS n_chars FROM documents""")
def text_files(t):
    f = t.documents.selectExpr(
        "doc_id AS path", "CASE WHEN doc_id % 20 = 0 THEN X'41C328' WHEN doc_id % 20 = 1 THEN CAST('  ' AS BINARY) ELSE concat(X'EFBBBF', CAST(replace(text, chr(10), chr(13) || chr(10)) AS BINARY)) END AS content")
    return readers.read_text(f).select("path", F.coalesce("error", F.lit("")).alias("error"), F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars"))


@query("planned_answers", """
WITH o AS (SELECT conv_id AS workspace_id, 'k' || CAST(turn AS STRING) AS key, text AS question, turn + 1 AS ordinal FROM conversations WHERE role = 'user'),
n AS (SELECT workspace_id, key, CASE WHEN ordinal % 3 = 0 THEN 'changed' ELSE question END AS question FROM o UNION ALL
  SELECT conv_id, 'n' || CAST(turn AS STRING), text FROM conversations WHERE role = 'assistant'),
j AS (SELECT n.*, o.question AS old, o.ordinal FROM n LEFT JOIN o USING (workspace_id, key)),
a AS (SELECT workspace_id, key, row_number() OVER (PARTITION BY workspace_id ORDER BY key) AS k FROM j WHERE old IS NULL)
SELECT j.workspace_id, j.key, CASE WHEN old IS NULL THEN 'append' WHEN old = j.question THEN 'replay' ELSE 'conflict' END AS action,
  coalesce(j.ordinal, (SELECT max(ordinal) FROM o WHERE o.workspace_id = j.workspace_id) + a.k, a.k) AS ordinal FROM j LEFT JOIN a USING (workspace_id, key)""")
def planned_answers(t):
    c = t.conversations
    old = c.where("role = 'user'").selectExpr("conv_id AS workspace_id", "'k' || CAST(turn AS STRING) AS key", "text AS question", "turn + 1 AS ordinal")
    new = old.selectExpr("workspace_id", "key", "CASE WHEN ordinal % 3 = 0 THEN 'changed' ELSE question END AS question").unionByName(
        c.where("role = 'assistant'").selectExpr("conv_id AS workspace_id", "'n' || CAST(turn AS STRING) AS key", "text AS question"))
    return store.plan_answers(new, old).select("workspace_id", "key", "action", "ordinal")


@query("replaced_manifest", """
SELECT lang AS run_id, doc_id AS file_id, CASE WHEN lang = 'de' THEN 'replaced' ELSE 'first' END AS version FROM documents""")
def replaced_manifest(t):
    path = scratch_path(t.spark, "manifest")
    d = t.documents.selectExpr("lang AS run_id", "doc_id AS file_id", "'first' AS version")
    store.write_manifest(d, path)
    store.write_manifest(d.where("run_id = 'de'").withColumn("version", F.lit("replaced")), path)
    return versions.read(t.spark, path).select("run_id", "file_id", "version")
