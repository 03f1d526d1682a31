"""Cell typing, normalisation, predicates and catalog queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import text, typing, vocab
from factloom.operators import catalog
from factloom.operators import relational as rel
from factloom.plans.registry import query
from factloom.plans.shared import (
    LINE_CELLS, ORDER_CELLS, PLAIN_ORDER, date_sql, forms_sql, key_sql, kind_sql, num_sql, quoted, render,
    select_sql, squash_sql, unit_sql, words_sql,
)

_CELL_COLUMNS = ["order_id", "customer", "status", "total", "placed", "priority"]
_UNPIVOT = " UNION ALL ".join(
    f"SELECT row_ord, '{c}' AS col, {squash_sql(c)} AS v FROM cells" for c in _CELL_COLUMNS)


@query("typed_cells", f"""
WITH cells AS ({select_sql(ORDER_CELLS, 'orders')}), long AS ({_UNPIVOT}), k AS (SELECT *, {kind_sql('v')} AS kind FROM long)
SELECT row_ord, col, kind, coalesce(CASE WHEN kind = 'number' THEN {unit_sql('v')} END, '') AS unit,
  CASE WHEN kind = 'number' THEN round(CAST({num_sql('v')} AS DOUBLE), 4) END AS num,
  coalesce(CASE WHEN kind = 'date' THEN CAST({date_sql('v')} AS STRING) END, '') AS dt,
  coalesce(CASE WHEN kind = 'boolean' THEN lower(v) IN ({quoted(vocab.TRUE_WORDS)}) END, false) AS truth
FROM k""")
def typed_cells(t):
    cells = render(t.spread("orders"), ORDER_CELLS)
    long = cells.select("row_ord", F.inline(F.array(*[
        F.struct(F.lit(c).alias("col"), F.col(c).alias("v")) for c in _CELL_COLUMNS])))
    typed = long.withColumn("t", typing.typed_cell(F.col("v")))
    return typed.select(
        "row_ord", "col", F.col("t.kind").alias("kind"), F.coalesce("t.unit", F.lit("")).alias("unit"),
        F.round(F.col("t.num").cast("double"), 4).alias("num"),
        F.coalesce(F.col("t.dt").cast("string"), F.lit("")).alias("dt"),
        F.coalesce("t.bool", F.lit(False)).alias("truth"))


@query("normalised_keys", f"""
SELECT doc_id, sha256({key_sql('text')}) AS key_hash, CAST(len({words_sql('text')}) AS BIGINT) AS n_words FROM documents""")
def normalised_keys(t):
    return t.spread("documents").select(
        "doc_id", F.sha2(text.norm_key(F.col("text")), 256).alias("key_hash"),
        F.size(text.words(F.col("text"))).cast("long").alias("n_words"))


@query("field_ids", r"""
WITH h AS (SELECT p_partkey, p_brand || ' (' || p_type || ') / ' || p_name || ' %' AS header FROM part)
SELECT p_partkey, trim(regexp_replace(lower(header), '[^a-z0-9]+', '_', 'g'), '_') AS field_id FROM h""")
def field_ids(t):
    header = F.expr("p_brand || ' (' || p_type || ') / ' || p_name || ' %'")
    return t.part.select("p_partkey", text.field_id(header).alias("field_id"))


def _vocabulary(t):
    return (t.spread("documents").select(F.explode(F.array_distinct(text.words(F.col("text")))).alias("token"))
            .groupBy("token").agg(F.count(F.lit(1)).alias("n_docs")))


_VOCABULARY = f"""SELECT token, count(*) AS n_docs FROM
  (SELECT doc_id, unnest(list_distinct({words_sql('text')})) AS token FROM documents) GROUP BY token"""


@query("token_forms", f"""
WITH v AS ({_VOCABULARY})
SELECT token, n_docs, array_to_string(list_sort({forms_sql('token')}), ' ') AS forms FROM v""")
def token_forms(t):
    return _vocabulary(t).select(
        "token", "n_docs", F.array_join(F.array_sort(text.token_forms(F.col("token"))), " ").alias("forms"))


@query("search_forms", rf"""
WITH v AS ({_VOCABULARY}), f AS (SELECT token, {forms_sql('token')} AS forms FROM v),
b AS (SELECT token, forms, list_filter(forms, lambda x: length(x) < length(token)) AS singles FROM f),
base AS (SELECT token, forms, list_filter(CASE WHEN len(singles) > 0 THEN singles WHEN token LIKE '%ws' THEN []
  ELSE [token] END, lambda x: regexp_full_match(x, '\p{{L}}{{2,}}') AND x NOT IN ('as', 'is', 'us')) AS bases FROM b),
cand AS (SELECT token, forms, unnest(list_distinct(list_concat(forms, list_transform(bases, lambda x:
  CASE WHEN regexp_full_match(x, '.+[^aeiou]y') THEN x[:-2] || 'ies'
       WHEN regexp_matches(x, '(s|x|z|ch|sh)$') THEN x || 'es' ELSE x || 's' END)))) AS c FROM base)
SELECT token, string_agg(c, ' ' ORDER BY c) AS forms FROM cand
WHERE len(list_intersect({forms_sql('c')}, forms)) > 0 GROUP BY token""")
def search_forms(t):
    return _vocabulary(t).select("token", F.array_join(F.array_sort(text.search_forms(F.col("token"))), " ").alias("forms"))


_CMP = (
    "CASE WHEN ak = 'number' AND bk = 'number' THEN CASE WHEN au IS NOT NULL AND bu IS NOT NULL AND au <> bu THEN NULL "
    "WHEN an > bn THEN 1 WHEN an < bn THEN -1 ELSE 0 END "
    "WHEN ak = 'date' AND bk = 'date' THEN CASE WHEN ad > bd THEN 1 WHEN ad < bd THEN -1 ELSE 0 END "
    "WHEN ak IN ('identifier', 'text') AND bk IN ('identifier', 'text') THEN "
    f"CASE WHEN {key_sql('a')} > {key_sql('b')} THEN 1 WHEN {key_sql('a')} < {key_sql('b')} THEN -1 ELSE 0 END "
    "WHEN ak = 'boolean' AND bk = 'boolean' THEN CASE WHEN lower(a) IN ('true', 'yes', 'y') AND lower(b) NOT IN "
    "('true', 'yes', 'y') THEN 1 WHEN lower(b) IN ('true', 'yes', 'y') AND lower(a) NOT IN ('true', 'yes', 'y') THEN -1 "
    "ELSE 0 END END"
)
# operand pairs of every kind, rendered from orders
_PAIR = {
    "row_ord": "o_orderkey",
    "a": "CASE WHEN o_orderkey % 6 = 0 THEN '$' || CAST(o_totalprice AS STRING) WHEN o_orderkey % 6 = 1 THEN "
         "CAST(CAST(o_orderdate AS DATE) AS STRING) WHEN o_orderkey % 6 = 2 THEN o_orderpriority WHEN o_orderkey % 6 = 3 "
         "THEN 'yes' WHEN o_orderkey % 6 = 4 THEN 'ID-' || CAST(o_custkey AS STRING) ELSE CAST(o_totalprice AS STRING) END",
    "b": "CASE WHEN o_orderkey % 6 = 0 THEN CAST(o_custkey AS STRING) || CASE WHEN o_orderkey % 4 = 0 THEN ' EUR' ELSE '' "
         "END WHEN o_orderkey % 6 = 1 THEN '6/15/1998' WHEN o_orderkey % 6 = 2 THEN '3-Medium' WHEN o_orderkey % 6 = 3 THEN "
         "CASE WHEN o_orderkey % 4 = 1 THEN 'No' ELSE 'TRUE' END WHEN o_orderkey % 6 = 4 THEN o_orderpriority "
         "ELSE '100,000.5' END",
}


@query("compared_cells", f"""
WITH p AS ({select_sql(_PAIR, 'orders')}),
k AS (SELECT *, {kind_sql('a')} AS ak, {kind_sql('b')} AS bk, {unit_sql('a')} AS au, {unit_sql('b')} AS bu,
  {num_sql('a')} AS an, {num_sql('b')} AS bn, {date_sql('a')} AS ad, {date_sql('b')} AS bd FROM p)
SELECT row_ord, coalesce(CAST({_CMP} AS STRING), 'incomparable') AS outcome FROM k""")
def compared_cells(t):
    p = render(t.spread("orders"), _PAIR)
    cmp = typing.compare_typed(typing.typed_cell(F.col("a")), typing.typed_cell(F.col("b")))
    return p.select("row_ord", F.coalesce(cmp.cast("string"), F.lit("incomparable")).alias("outcome"))


@query("typed_filter", f"""
WITH c AS ({select_sql(LINE_CELLS, 'lineitem')})
SELECT row_ord, price, shipped FROM c WHERE TRY_CAST(replace(price, '$', '') AS DECIMAL(28,10)) >= 20000
  AND CAST(shipped AS DATE) < DATE '1999-06-01' AND lower(flag) <> 'r' AND lower(flag) <> 'n'
  AND CAST(discount AS DECIMAL(28,10)) > CAST(tax AS DECIMAL(28,10)) AND quantity <> ''""")
def typed_filter(t):
    # flag 'N' reads as a boolean and is therefore not comparable with the text 'r'
    preds = [("price", "ge", "$20,000"), ("shipped", "lt", "6/1/1999"), ("flag", "ne", "r"), ("discount", "gt", F.col("tax")),
             ("quantity", "not_null")]
    return rel.where_typed(render(t.spread("lineitem"), LINE_CELLS), preds).select("row_ord", "price", "shipped")


@query("predicate_validation", f"""
WITH c AS ({select_sql(ORDER_CELLS, 'orders')}), k AS (SELECT {kind_sql(squash_sql('total'))} AS tk,
  {unit_sql(squash_sql('total'))} AS tu, {kind_sql('placed')} AS pk, {kind_sql('status')} AS sk FROM c)
SELECT 0 AS predicate, 'total' AS "column", 'gt' AS op, bool_or(tk = 'number' AND coalesce(tu, 'USD') = 'USD') AS comparable FROM k
UNION ALL SELECT 1, 'total', 'gt', bool_or(tk = 'number' AND coalesce(tu, 'EUR') = 'EUR') FROM k
UNION ALL SELECT 2, 'placed', 'le', bool_or(pk = 'date') FROM k
UNION ALL SELECT 3, 'placed', 'eq', bool_or(pk = 'number') FROM k
UNION ALL SELECT 4, 'status', 'eq', bool_or(sk IN ('text', 'identifier')) FROM k""")
def predicate_validation(t):
    return rel.validate_predicates(render(t.spread("orders"), ORDER_CELLS), [
        ("total", "gt", "$100"), ("total", "gt", "100 EUR"), ("placed", "le", "March 1, 1998"), ("placed", "eq", "17"),
        ("status", "eq", "pending review")])


@query("projected_rows", f"""
WITH c AS ({select_sql(ORDER_CELLS, 'orders')})
SELECT row_ord, 'order_id: ' || order_id || '; customer: ' || customer || '; total: ' ||
  CASE WHEN trim(total) = '' THEN 'null' ELSE total END || '; placed: ' || placed AS rendered FROM c""")
def projected_rows(t):
    return rel.project_rows(render(t.spread("orders"), ORDER_CELLS), "order_id", ["customer", "order_id", "total", "placed"]).select(
        "row_ord", "rendered")


@query("projected_cells", """
SELECT c_name AS identity, 'segment' AS "column", c_mktsegment AS value FROM customer
UNION ALL SELECT c_name, 'nation', CAST(c_nationkey AS STRING) FROM customer
UNION ALL SELECT c_name, 'balance', CAST(c_acctbal AS STRING) FROM customer""")
def projected_cells(t):
    c = t.customer.selectExpr("c_name AS name", "c_mktsegment AS segment", "CAST(c_nationkey AS STRING) AS nation",
                              "CAST(c_acctbal AS STRING) AS balance")
    return rel.project_cells(c, "name", ["segment", "nation", "balance"])


_CUST = {"key": "CAST(c_custkey AS STRING)", "name": "c_name", "code": "'C' || CAST(c_custkey AS STRING)",
         "nation": "CAST(c_nationkey AS STRING)", "segment": "c_mktsegment"}
_CUST_LONG = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {i} AS position, {c} AS v FROM c"
                                for i, c in enumerate(_CUST))


@query("identity_columns", f"""
WITH c AS ({select_sql(_CUST, 'customer')}), long AS ({_CUST_LONG}), k AS (SELECT *, {kind_sql('v')} AS kind FROM long)
SELECT "column", position, round(count(DISTINCT {key_sql('v')}) / count(*) + avg(CASE WHEN kind = 'identifier' THEN 1.0 ELSE 0.0
  END), 6) AS score FROM k WHERE kind <> 'null' GROUP BY 1, 2""")
def identity_columns(t):
    r = rel.rank_identity_columns(render(t.customer, _CUST), list(_CUST))
    return r.select("column", "position", F.round("score", 6).alias("score"))


@query("row_labels", """
SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN 'name ' || p_name WHEN p_partkey % 2 = 0 THEN 'brand ' || p_brand
  ELSE 'Row ' || CAST(p_partkey AS STRING) END AS label FROM part""")
def row_labels(t):
    p = t.part.selectExpr(
        "p_partkey", "CASE WHEN p_partkey % 7 = 0 THEN 'n/a' ELSE p_name END AS name", "CAST(p_size AS STRING) AS size",
        "CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'unknown' END AS brand")
    return p.select("p_partkey", rel.row_label(["name", "size", "brand"], F.col("p_partkey")).alias("label"))


@query("mentioned_values", rf"""
WITH w AS (SELECT item_id, {words_sql('text')} AS w FROM benchmark),
v AS (SELECT item_id * 1000 + p AS row_id, 'phrase' AS col, array_to_string(w[greatest(1, least(p, len(w) - 2)):greatest(1, least(p, len(w) - 2)) + 2], ' ') AS phrase
  FROM (SELECT *, unnest(generate_series(1, len(w), 3)) AS p FROM w)),
d AS (SELECT doc_id, ' ' || {key_sql('text')} || ' ' AS body FROM documents)
SELECT d.doc_id, v.row_id, v.col FROM d JOIN v ON contains(d.body, ' ' || v.phrase || ' ') WHERE length(v.phrase) >= 2""")
def mentioned_values(t):
    """The benchmark texts as a table of short values: all of their words, three to a value."""
    words = t.benchmark.select("item_id", text.words(F.col("text")).alias("w")).where("size(w) > 0").select(
        "item_id", "w", F.explode(F.sequence(F.lit(1), F.size("w"), F.lit(3))).alias("p"))
    start = F.greatest(F.lit(1), F.least(F.col("p"), F.size("w") - 2))
    table = words.select((F.col("item_id") * 1000 + F.col("p")).alias("row_id"), F.array_join(F.slice("w", start, 3), " ").alias("phrase"))
    hits = catalog.mention_join(t.spread("documents").select("doc_id", "text"), "doc_id", table, "row_id", ["phrase"])
    return hits.select("doc_id", "row_id", "col")


# column headers and request phrases rendered from part
_HEADERS = {"table_id": "p_brand", "header": "CASE WHEN p_size % 5 = 0 THEN p_name || '_ID' ELSE p_name || ' of the ' || "
            "lower(p_type) END"}
_PHRASE = {"phrase": "'show the ' || lower(p_type) || ' ' || p_name || 's by total'"}


@query("matched_columns", rf"""
WITH h AS (SELECT DISTINCT table_id, header FROM ({select_sql(_HEADERS, 'part')})),
p AS (SELECT DISTINCT phrase FROM ({select_sql(_PHRASE, 'part')})),
hk AS (SELECT DISTINCT header, {key_sql('header')} AS hkey, {words_sql('header')} AS ht FROM h),
pk AS (SELECT phrase, {key_sql('phrase')} AS pkey, {words_sql('phrase')} AS pt FROM p),
s AS (SELECT hk.header, pk.phrase, hkey, pkey, ht,
  list_filter(ht, lambda x: x NOT IN ({quoted(vocab.COLUMN_STOP_WORDS)})) AS meaning,
  list_filter(ht, lambda x: len(list_intersect({forms_sql('x')}, flatten(list_transform(pt, lambda y: {forms_sql('y')})))) > 0) AS hit
  FROM hk, pk),
c AS (SELECT header, phrase, CASE WHEN contains(' ' || pkey || ' ', ' ' || hkey || ' ') THEN 8 + len(ht)
  WHEN len(ht) >= 2 AND ht[-1] IN ('id', 'identifier') AND list_contains(hit, ht[1]) THEN 12
  WHEN len(meaning) > 0 AND len(list_filter(meaning, lambda x: NOT list_contains(hit, x))) = 0 THEN len(meaning) ELSE 0 END AS score
  FROM s)
SELECT table_id, phrase, CAST(sum(score) AS BIGINT) AS score FROM c JOIN h USING (header) WHERE score > 0 GROUP BY 1, 2""")
def matched_columns(t):
    headers = render(t.part, _HEADERS).distinct()
    phrases = render(t.part, _PHRASE).distinct()
    return catalog.match_tables(headers, phrases).select("table_id", "phrase", "score")


_TWO = {"table_id": "p_brand", "position": "CAST(p_size % 3 AS INT)",
        "header": "CASE WHEN p_size % 3 = 0 THEN 'Name' WHEN p_size % 3 = 1 THEN p_type ELSE 'price_of_item' END"}


@query("compatible_tables", f"""
WITH h AS (SELECT DISTINCT table_id, position, header FROM ({select_sql(_TWO, 'part')})),
k AS (SELECT table_id, string_agg({key_sql('header')}, '|' ORDER BY position, header) AS header_key FROM h GROUP BY 1)
SELECT table_id, sha256(header_key) AS header_hash, CAST(count(*) OVER (PARTITION BY header_key) AS BIGINT) AS compatible FROM k""")
def compatible_tables(t):
    return catalog.compatible_tables(render(t.part, _TWO).distinct())


@query("union_by_position", """
SELECT 'left' AS part_of, c_name AS name, CAST(c_nationkey AS STRING) AS nation FROM customer
UNION ALL SELECT 'right', s_name, CAST(s_nationkey AS STRING) FROM supplier""")
def union_by_position(t):
    c = t.customer.selectExpr("'left' AS part_of", "c_name AS Name", "CAST(c_nationkey AS STRING) AS nation")
    s = t.supplier.selectExpr("'right' AS Part_Of", "s_name AS NAME", "CAST(s_nationkey AS STRING) AS `Nation`")
    return catalog.union_tables([c, s]).toDF("part_of", "name", "nation")


@query("colliding_headers", f"""
WITH h AS (SELECT DISTINCT p_brand AS table_id, header FROM (SELECT p_brand, p_name AS header FROM part
  UNION ALL SELECT p_brand, CASE WHEN p_size % 2 = 0 THEN replace(upper(p_name), ' ', '_') ELSE p_type END FROM part))
SELECT table_id, {key_sql('header')} AS header_key, count(*) AS n_headers FROM h GROUP BY 1, 2 HAVING count(*) > 1""")
def colliding_headers(t):
    a = t.part.selectExpr("p_brand AS table_id", "p_name AS header")
    b = t.part.selectExpr("p_brand AS table_id",
                          "CASE WHEN p_size % 2 = 0 THEN replace(upper(p_name), ' ', '_') ELSE p_type END AS header")
    return catalog.duplicate_headers(a.unionByName(b).distinct())


@query("single_cell_lookups", """
SELECT l_orderkey AS request, min(CAST(l_extendedprice AS STRING)) AS value FROM lineitem GROUP BY 1 HAVING count(*) = 1""")
def single_cell_lookups(t):
    found = t.lineitem.selectExpr("l_orderkey AS request", "CAST(l_extendedprice AS STRING) AS price")
    return rel.lookup_cell(found, ["request"], "price")


@query("covered_lookups", """
SELECT l_orderkey AS request, min(CAST(l_extendedprice AS STRING)) AS value FROM lineitem GROUP BY 1 HAVING count(*) = 1 AND l_orderkey % 3 <> 2""")
def covered_lookups(t):
    """Every third request asks for more that its row does not hold than it does."""
    found = t.lineitem.selectExpr(
        "l_orderkey AS request", "CAST(l_extendedprice AS STRING) AS price", "'Price list of parts ' || CAST(l_partkey AS STRING) || ' ' || l_linestatus AS said",
        "CASE l_orderkey % 3 WHEN 0 THEN 'What is the price of part ' || CAST(l_partkey AS STRING) || '?' WHEN 1 THEN 'the stated price, document revision' "
        "ELSE 'price agreed with the second haulage company' END AS asked")
    return rel.lookup_cell(found, ["request"], "price", "asked", "said")


@query("tables_to_union", f"""
WITH h AS (SELECT DISTINCT table_id, position, header FROM ({select_sql(_TWO, 'part')})),
k AS (SELECT table_id, string_agg({key_sql('header')}, '|' ORDER BY position, header) AS header_key FROM h GROUP BY 1),
s AS (SELECT o_custkey % 7 AS request, k.table_id, k.header_key, count(*) % 5 AS score FROM orders JOIN k ON CAST(substr(k.table_id, 7) AS INT) % 11 = o_custkey % 11 GROUP BY ALL),
b AS (SELECT *, max(score) OVER (PARTITION BY request) AS top FROM s),
l AS (SELECT request, arg_min(header_key, table_id) AS header_key FROM b WHERE score = top GROUP BY 1)
SELECT b.request, b.table_id, b.score FROM b JOIN l USING (request, header_key) WHERE b.score >= b.top - 1""")
def tables_to_union(t):
    headers = render(t.part, _TWO).distinct()
    ids = headers.select("table_id").distinct()
    scored = (t.orders.select("o_custkey").join(ids, F.substring("table_id", 7, 9).cast("int") % 11 == F.col("o_custkey") % 11)
              .groupBy((F.col("o_custkey") % 7).alias("request"), "table_id").agg((F.count(F.lit(1)) % 5).alias("score")))
    return catalog.tables_to_union(scored, headers, ["request"])


@query("refused_predicate_is_empty", """SELECT CAST(0 AS BIGINT) AS published, count(*) AS orders FROM orders""")
def refused_predicate_is_empty(t):
    cells = render(t.spread("orders"), PLAIN_ORDER)
    checks = rel.validate_predicates(cells, [("placed", "gt", "17")])
    status = checks.agg(F.when(F.bool_and("comparable"), "complete").otherwise("unsupported").alias("status"))
    published = rel.gate(rel.where_typed(cells, [("placed", "gt", "17")]), status)
    return published.agg(F.count(F.lit(1)).alias("published")).withColumn(
        "orders", cells.agg(F.count(F.lit(1))).scalar())
