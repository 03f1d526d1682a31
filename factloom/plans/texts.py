"""Blocks, lines, text tables and artifacts over the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import text as tx
from factloom.functions import vocab
from factloom.operators import blocks, catalog, tables
from factloom.plans.registry import query
from factloom.plans.shared import (
    PLAIN_ORDER, forms_sql, kind_sql, long_words_sql, quoted, render, select_sql,
)

NORM_SQL = r"""trim(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[^\S\n]+(\n|$)', '\1', 'g'),
  '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9))"""


@query("normalised_texts", f"""
SELECT doc_id, sha256({NORM_SQL}) AS digest, length({NORM_SQL}) AS n_chars FROM documents""")
def normalised_texts(t):
    n = t.documents.select("doc_id", blocks.normalise_text(F.col("text")).alias("t"))
    return n.select("doc_id", F.sha2("t", 256).alias("digest"), F.char_length("t").cast("long").alias("n_chars"))


_CHUNKS = rf"""WITH RECURSIVE d AS (SELECT doc_id, {NORM_SQL} AS t FROM documents),
s(doc_id, t, n, cur, stop_at) AS (
  SELECT doc_id, t, length(t), 0::BIGINT, NULL::BIGINT FROM d
  UNION ALL
  SELECT doc_id, t, n, e + length(regexp_extract(substr(t, e + 1, 4000), '^\s*')), e FROM (
    SELECT doc_id, t, n, cur, CASE WHEN cur + 1800 >= n THEN n
      WHEN length(regexp_extract(substr(t, cur + 901, 900), '(?s)^.*[\n ]')) > 0
      THEN cur + 900 + length(regexp_extract(substr(t, cur + 901, 900), '(?s)^.*[\n ]')) - 1 ELSE cur + 1800 END AS e
    FROM s WHERE cur < n)),
p AS (SELECT doc_id, t, stop_at, lag(cur) OVER (PARTITION BY doc_id ORDER BY cur, stop_at NULLS FIRST) AS begin_at FROM s),
b AS (SELECT doc_id, t, begin_at, stop_at, substr(t, begin_at + 1, stop_at - begin_at) AS piece FROM p WHERE stop_at IS NOT NULL),
c AS (SELECT doc_id, t, begin_at + length(regexp_extract(piece, '^\s*')) AS start,
  begin_at + length(regexp_replace(piece, '\s+$', '')) AS stop FROM b)"""


@query("text_chunks", _CHUNKS + r"""
SELECT doc_id, start, stop, 1 + length(substr(t, 1, start)) - length(replace(substr(t, 1, start), chr(10), '')) AS line_start,
  sha256(substr(t, start + 1, stop - start)) AS text_hash,
  1 + length(substr(t, 1, stop)) - length(replace(substr(t, 1, stop), chr(10), '')) AS line_end FROM c""")
def text_chunks(t):
    d = t.spread("documents").select("doc_id", blocks.normalise_text(F.col("text")).alias("text"))
    b = blocks.located(blocks.chunk_text(d, ["doc_id"]))
    return b.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("start", "stop", "line_start", "line_end")], "text_hash")


@query("chunks_rebuild_text", r"""
SELECT doc_id, 0::BIGINT AS broken, CAST(length(regexp_replace(text, '\s+', '', 'g')) AS BIGINT) AS dense_chars FROM documents""")
def chunks_rebuild_text(t):
    """Both chunkings keep every non-blank character, and each block equals its span of the source."""
    d = t.documents.select("doc_id", "text")
    parts = blocks.chunk_lines(d, ["doc_id"]).withColumn("how", F.lit("lines")).unionByName(
        blocks.chunk_text(d, ["doc_id"]).withColumn("how", F.lit("text")))
    j = parts.withColumnRenamed("text", "block").join(d, "doc_id")
    bad = F.substring(F.col("text"), F.col("start") + 1, F.col("stop") - F.col("start")) != F.col("block")
    per = j.groupBy("doc_id", "how").agg(
        F.count_if(bad).alias("bad"), F.sum(F.char_length(F.regexp_replace("block", r"\s+", ""))).alias("dense"))
    return per.groupBy("doc_id").agg(
        (F.sum("bad") + F.when(F.min("dense") != F.max("dense"), 1).otherwise(0)).cast("long").alias("broken"),
        F.max("dense").cast("long").alias("dense_chars"))


_LINES = """l AS (SELECT doc_id, i, line, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(line) - 1 AS off FROM
  (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM documents)),
n AS (SELECT doc_id, i AS line_no, CAST(off + length(line) - length(ltrim(line, ' ')) AS BIGINT) AS start, trim(line, ' ') AS text
  FROM l WHERE trim(line) <> '')"""


def _lines(t):
    """Lines of documents, found block by block, with their positions in the whole document."""
    b = blocks.chunk_lines(t.spread("documents").select("doc_id", "text"), ["doc_id"])
    lines = blocks.source_lines(b.withColumn("offset", F.col("start")), ["doc_id", "block_ord", "offset"])
    return lines.select("doc_id", "block_ord", F.col("line_no").cast("long").alias("line_no"),
                        (F.col("offset") + F.col("start")).cast("long").alias("start"),
                        (F.col("offset") + F.col("stop")).cast("long").alias("stop"), "text")


@query("source_lines", f"WITH {_LINES} SELECT doc_id, line_no, start, sha256(text) AS text_hash FROM n")
def source_lines(t):
    # trimmed block borders may drop leading blanks of a block's first line; spans are relative to the trimmed text
    return _lines(t).select("doc_id", "line_no", "start", F.sha2("text", 256).alias("text_hash"))


@query("line_citations", f"""
WITH {_LINES}, r AS (SELECT doc_id, line_no AS row_id, text, CASE WHEN line_no % 2 = 0 THEN line_no END AS row_line FROM n),
c AS (SELECT r.doc_id, r.row_id, count(*) AS hits, min(n.start) AS start FROM r JOIN n ON n.doc_id = r.doc_id AND n.text = r.text
  AND (r.row_line IS NULL OR n.line_no = r.row_line) GROUP BY 1, 2)
SELECT doc_id AS file_id, row_id, hits = 1 AS resolved, CASE WHEN hits = 1 THEN start ELSE -1 END AS start FROM c""")
def line_citations(t):
    lines = _lines(t).withColumnsRenamed({"doc_id": "file_id", "block_ord": "block_id"})
    rows = lines.select("file_id", F.col("line_no").alias("row_id"), F.col("text").alias("quote"),
                        F.when(F.col("line_no") % 2 == 0, F.col("line_no")).alias("row_line"))
    return blocks.line_citation(rows, lines).select(
        "file_id", "row_id", "resolved", F.coalesce("spot.start", F.lit(-1)).alias("start"))


# documents with tables: one rendered sheet per supplier, and the given documents themselves
_SHEET = ("'Supplier sheet ' || CAST(s_suppkey AS STRING) || chr(10) || 'Field | Value | Note' || chr(10) || '--- | :---: | ---' || "
          "chr(10) || '| Balance | ' || CAST(s_acctbal AS STRING) || ' | usd |' || chr(10) || chr(10) || 'Nation | ' || "
          "CAST(s_nationkey AS STRING) || ' | x | y' || chr(10) || 'Closing words' || chr(10) || 'A' || chr(9) || 'B  b' || chr(10) || "
          "s_name || chr(9) || ' n' || CAST(s_suppkey AS STRING) || chr(10) || 'end'")
_TABLE_DOCS = f"""SELECT doc_id, text FROM documents UNION ALL SELECT -1 - s_suppkey, {_SHEET} FROM supplier"""
_LINES2 = _LINES.replace("FROM documents", "FROM docs")


def _table_rows(t):
    docs = t.documents.select("doc_id", "text").unionByName(
        t.supplier.selectExpr("-1 - s_suppkey AS doc_id", f"{_SHEET} AS text"))
    return tables.text_tables(docs.withColumnRenamed("doc_id", "file_id"))


@query("detected_tables", f"""
WITH docs AS ({_TABLE_DOCS}), {_LINES2},
m AS (SELECT *, CASE WHEN contains(text, chr(9)) THEN 'tab' WHEN length(text) - length(replace(text, '|', '')) >= 2 THEN 'pipe' END AS d FROM n),
g AS (SELECT *, lag(d) OVER w AS pd, lag(text) OVER w AS pt FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
r AS (SELECT *, sum(CASE WHEN d IS NOT DISTINCT FROM pd AND d IS NOT NULL THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM g),
c AS (SELECT *, list_transform(CASE d WHEN 'tab' THEN string_split(text, chr(9)) ELSE string_split(trim(trim(text), '|'), '|') END,
  lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))) AS cells, row_number() OVER (PARTITION BY doc_id, run ORDER BY line_no) AS k,
  first_value(line_no) OVER (PARTITION BY doc_id, run ORDER BY line_no) AS table_line,
  first_value(CASE WHEN pd IS NULL THEN pt END) OVER (PARTITION BY doc_id, run ORDER BY line_no) AS title FROM r WHERE d IS NOT NULL),
h AS (SELECT doc_id, run, cells AS headers FROM c WHERE k = 1)
SELECT c.doc_id AS file_id, table_line, coalesce(sha256(title), '') AS title_hash, line_no, sha256(array_to_string(headers, '~')) AS headers,
  sha256(array_to_string(cells, '~')) AS cells, len(cells) <> len(headers) AS malformed
FROM c JOIN h USING (doc_id, run) WHERE k > 1 AND len(headers) >= 2 AND NOT list_contains(headers, '')
  AND NOT (k = 2 AND len(cells) = len(headers) AND len(list_filter(cells, lambda x: NOT regexp_full_match(x, ':?-{{3,}}:?'))) = 0)"""
       .replace("\\\\s", "\\s"))
def detected_tables(t):
    h = lambda c: F.sha2(F.array_join(c, "~"), 256).alias(c)
    return _table_rows(t).select(
        "file_id", F.col("table_line").cast("long").alias("table_line"), F.coalesce(F.sha2("title", 256), F.lit("")).alias("title_hash"),
        F.col("line_no").cast("long").alias("line_no"), h("headers"), h("cells"), "malformed")


_FIELDS = ["order_id", "total", "placed", "priority", "status"]


@query("order_cells", f"""
WITH c AS ({select_sql(PLAIN_ORDER, 'orders')}) """ + " UNION ALL ".join(
    f"SELECT 'orders' AS table_id, row_ord, {i + 1} AS col_ord, '{f}' AS field_id, {f} AS raw FROM c" for i, f in enumerate(_FIELDS)))
def order_cells(t):
    return tables.wide_to_cells(render(t.orders, PLAIN_ORDER), F.lit("orders"), F.col("row_ord"), _FIELDS).select(
        "table_id", "row_ord", "col_ord", "field_id", "raw")


@query("cells_back_to_rows", f"SELECT * FROM ({select_sql(PLAIN_ORDER, 'orders')})")
def cells_back_to_rows(t):
    cells = tables.wide_to_cells(render(t.orders, PLAIN_ORDER), F.lit("orders"), F.col("row_ord"), _FIELDS)
    return tables.cells_to_wide(cells, _FIELDS).drop("table_id")


# one small table per customer nation; the third column is a second 'code' and the balance column is sometimes text
_NATION = {"table_id": "'n' || CAST(c_nationkey AS STRING)", "row_ord": "c_custkey", "a": "'C-' || CAST(c_custkey AS STRING)",
           "b": "CASE WHEN c_custkey % 40 = 3 THEN 'see note' ELSE CAST(c_acctbal AS STRING) END", "c": "c_mktsegment"}


@query("table_profiles", f"""
WITH c AS ({select_sql(_NATION, 'customer')}), k AS (SELECT table_id, row_ord, {kind_sql('b')} AS kb FROM c),
m AS (SELECT table_id, count_if(row_ord % 500 = 11) AS bad FROM c GROUP BY 1)
SELECT k.table_id, CAST(3 AS BIGINT) AS n_columns, CAST(1 AS BIGINT) AS duplicate_ids,
  CASE WHEN count(DISTINCT kb) > 1 THEN CAST(1 AS BIGINT) ELSE 0 END AS mixed_columns, max(bad) AS malformed_rows, max(bad) = 0 AS complete,
  'duplicate_normalized_field_identifier' || CASE WHEN max(bad) > 0 THEN ',malformed_row_shape' ELSE '' END ||
  CASE WHEN count(DISTINCT kb) > 1 THEN ',mixed_inferred_column_types' ELSE '' END AS codes
FROM k JOIN m USING (table_id) GROUP BY 1""")
def table_profiles(t):
    c = render(t.customer, _NATION)
    cells = tables.wide_to_cells(c.withColumnsRenamed({"a": "Code", "b": "Balance", "c": "code!"}),
                                 F.col("table_id"), F.col("row_ord"), ["Code", "Balance", "code!"])
    bad = c.groupBy("table_id").agg(F.count_if(F.col("row_ord") % 500 == 11).alias("malformed_rows"))
    p = tables.profile_tables(cells, bad)
    return p.select("table_id", "n_columns", "duplicate_ids", "mixed_columns", "malformed_rows", "complete",
                    F.array_join("ambiguity_codes", ",").alias("codes"))


_ARTIFACTS = {
    "file_id": "doc_id", "table_id": "CAST(doc_id % 3 AS STRING)", "written_at": "n_chars",
    "source_hash": "CASE WHEN doc_id % 4 = 0 THEN 'old' ELSE source END", "parser": "CASE WHEN doc_id % 5 = 0 THEN 'v1' ELSE 'v2' END",
    "schema_version": "CASE WHEN doc_id % 7 = 0 THEN 'a1' ELSE 'a2' END", "complete": "doc_id % 6 <> 1"}


@query("accepted_artifacts", f"""
WITH a AS ({select_sql(_ARTIFACTS, 'documents')} UNION ALL SELECT doc_id, CAST(doc_id % 3 AS STRING), n_chars + 1, source, 'v2', 'a2', true FROM documents
  WHERE lang = 'en')
SELECT file_id, table_id, min(written_at) AS written_at FROM a JOIN documents d ON a.file_id = d.doc_id
WHERE a.source_hash = d.source AND parser = 'v2' AND schema_version = 'a2' AND complete GROUP BY 1, 2""")
def accepted_artifacts(t):
    a = render(t.spread("documents"), _ARTIFACTS).unionByName(t.documents.where("lang = 'en'").selectExpr(
        "doc_id AS file_id", "CAST(doc_id % 3 AS STRING) AS table_id", "n_chars + 1 AS written_at", "source AS source_hash", "'v2' AS parser",
        "'a2' AS schema_version", "true AS complete"))
    files = t.documents.selectExpr("doc_id AS file_id", "source AS source_hash", "'v2' AS parser")
    return tables.accept_artifact(a, files, "a2").select("file_id", "table_id", "written_at")


@query("ordered_ready_blocks", _CHUNKS + """
SELECT c.doc_id AS file_id, CAST(row_number() OVER (PARTITION BY c.doc_id ORDER BY start) - 1 AS BIGINT) AS block_ord, stop - start AS n_chars
FROM c JOIN documents d ON d.doc_id = c.doc_id WHERE d.lang = 'de' AND d.source <> 'src3'""")
def ordered_ready_blocks(t):
    d = t.documents.select(F.col("lang").alias("run_id"), F.col("doc_id").alias("file_id"), blocks.normalise_text(F.col("text")).alias("text"))
    files = t.documents.selectExpr("lang AS run_id", "doc_id AS file_id", "doc_id AS file_ord",
                                   "CASE WHEN source = 'src3' THEN 'capped' ELSE 'ready' END AS status")
    b = blocks.read_blocks(blocks.chunk_text(d, ["run_id", "file_id"]), files, "de")
    return b.select("file_id", F.col("block_ord").cast("long").alias("block_ord"), (F.col("stop") - F.col("start")).cast("long").alias("n_chars"))


_ART_JSON = (
    "'{\"headers\":[\"kind\",\"k\"],\"rows\":[{\"ordinal\":1,\"values\":[\"' || event_type || '\",\"' || CAST(user_id AS STRING) || '\"]},"
    "{\"ordinal\":2,\"values\":[\"' || event_type || '\"' || CASE WHEN event_id % 5 = 0 THEN '' ELSE ',\"x\"' END || ']}]' || "
    "CASE WHEN event_id % 11 = 0 THEN '' ELSE '}' END")


@query("artifact_cells", """
WITH e AS (SELECT * FROM events WHERE event_id % 11 <> 0)
SELECT event_id, 1 AS row_ord, 1 AS col_ord, 'kind' AS header, event_type AS raw FROM e
UNION ALL SELECT event_id, 1, 2, 'k', CAST(user_id AS STRING) FROM e
UNION ALL SELECT event_id, 2, 1, 'kind', event_type FROM e WHERE event_id % 5 <> 0
UNION ALL SELECT event_id, 2, 2, 'k', 'x' FROM e WHERE event_id % 5 <> 0""")
def artifact_cells(t):
    rows = tables.load_artifact_json(t.events.selectExpr("event_id", f"{_ART_JSON} AS artifact"), ["event_id"], "artifact")
    return tables.artifact_cells(rows, ["event_id"])


@query("artifact_problems", """
SELECT event_id, event_id % 11 <> 0 AS readable, CAST(1 AS BIGINT) AS malformed FROM events WHERE event_id % 11 = 0 OR event_id % 5 = 0""")
def artifact_problems(t):
    rows = tables.load_artifact_json(t.events.selectExpr("event_id", f"{_ART_JSON} AS artifact"), ["event_id"], "artifact")
    return rows.groupBy("event_id", "readable").agg(F.count_if("malformed").alias("malformed")).where("malformed > 0")


@query("replaced_blocks", """
SELECT doc_id, n_chars + CASE WHEN source = 'src3' THEN 1 ELSE 0 END AS n_chars FROM documents""")
def replaced_blocks(t):
    d = t.documents.select("doc_id", "n_chars")
    fresh = t.documents.where("source = 'src3'").selectExpr("doc_id", "n_chars + 1 AS n_chars")
    return blocks.replace_blocks(d, fresh, ["doc_id"])


@query("attached_vectors", """
WITH b AS (SELECT vec_id // 4 AS file_id, vec_id % 4 AS block_ord FROM embeddings),
v AS (SELECT vec_id // 4 AS file_id, vec_id % 4 AS block_ord, label, embedding FROM embeddings WHERE label <> 3)
SELECT file_id, block_ord, label, len(embedding)::INT AS dims FROM v WHERE file_id IN
  (SELECT file_id FROM (SELECT file_id, count(*) c FROM b GROUP BY 1) JOIN (SELECT file_id, count(*) k FROM v GROUP BY 1) USING (file_id) WHERE c = k)""")
def attached_vectors(t):
    e = t.embeddings.selectExpr("vec_id", "vec_id DIV 4 AS file_id", "vec_id % 4 AS block_ord", "label", "embedding")
    out = blocks.attach_vectors(e.select("file_id", "block_ord"), e.where("label <> 3").drop("vec_id"), "cfg-1")
    return out.select("file_id", "block_ord", "label", "dims")


@query("complete_artifacts", """
SELECT doc_id AS file_id, doc_id % 8 <> 0 AS count_agrees, doc_id % 8 <> 0 AND doc_id % 3 <> 0 AS complete FROM documents""")
def complete_artifacts(t):
    b = blocks.chunk_text(t.documents.select("doc_id", "text", "source"), ["doc_id", "source"]).selectExpr(
        "doc_id AS file_id", "CASE WHEN doc_id % 3 = 0 AND block_ord = 0 THEN 'stale' ELSE source END AS source_hash", "'v2' AS parser")
    n = b.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    files = t.documents.join(n, F.col("doc_id") == F.col("file_id")).selectExpr(
        "doc_id AS file_id", "source AS source_hash", "'v2' AS parser", "n + CASE WHEN doc_id % 8 = 0 THEN 1 ELSE 0 END AS block_count")
    return blocks.artifact_complete(files, b)


_QT = f"""q AS (SELECT item_id, tok, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, p) AS rk FROM
  (SELECT item_id, tok, count(*) AS n, min(p) AS p FROM (SELECT item_id, generate_subscripts(w, 1) AS p, unnest(w) AS tok FROM
    (SELECT item_id, list_filter({long_words_sql('text')}, lambda x: x NOT IN ({quoted(vocab.QUERY_STOP_WORDS)})) AS w FROM benchmark)) GROUP BY 1, 2)),
qt AS (SELECT item_id, tok, rk FROM q)"""


@query("question_tokens", f"WITH {_QT} SELECT item_id, string_agg(tok, ' ' ORDER BY rk) AS tokens FROM qt GROUP BY 1")
def question_tokens(t):
    return t.benchmark.select("item_id", F.array_join(tx.query_tokens(F.col("text")), " ").alias("tokens"))


@query("token_coverage", f"""
WITH {_QT}, qf AS (SELECT item_id, tok, unnest({forms_sql('tok')}) AS form FROM qt),
dt AS (SELECT doc_id, unnest(list_distinct({long_words_sql('text')})) AS tok FROM documents),
df AS (SELECT DISTINCT doc_id, unnest({forms_sql('tok')}) AS form FROM dt)
SELECT doc_id, item_id, count(DISTINCT tok) AS coverage FROM df JOIN qf USING (form) GROUP BY 1, 2""")
def token_coverage(t):
    q = t.benchmark.select("item_id", tx.query_tokens(F.col("text")).alias("tokens"))
    return catalog.token_coverage(t.spread("documents").select("doc_id", "text"), "doc_id", q, "item_id")
