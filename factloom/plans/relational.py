"""Aggregates, universal checks, extrema, ordering, top-k and set checks over the order tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.functions import vocab
from factloom.operators import ordering, sets
from factloom.operators import relational as rel
from factloom.plans.registry import query
from factloom.plans.shared import (
    LINE_CELLS, ORDER_CELLS, PLAIN_ORDER, date_sql, kind_sql, num_sql, quoted, render, select_sql, squash_sql,
)


def _d(name: str, places: int = 4):
    return F.round(F.col(name).cast("double"), places).alias(name)


_ORDERS_SINCE = [("placed", "ge", "1997-01-01")]
_TYPED = f"""c AS ({select_sql(ORDER_CELLS, 'orders')}), k AS (SELECT *, {date_sql('placed')} AS dt,
  CASE WHEN {kind_sql(squash_sql('total'))} = 'number' THEN {num_sql(squash_sql('total'))} END AS num FROM c)"""


@query("grouped_totals_gated", f"""
WITH {_TYPED}
SELECT priority, count(*) AS orders, round(CAST(sum(num) AS DOUBLE), 2) AS sum_total, min(row_ord) AS first_ord,
  max(row_ord) AS last_ord, 'USD' AS unit FROM k WHERE dt >= DATE '1997-01-01' GROUP BY priority""")
def grouped_totals_gated(t):
    out = rel.aggregate_by(render(t.spread("orders"), ORDER_CELLS), ["priority"], [("count", None), ("sum", "total")],
                           where=_ORDERS_SINCE, order="row_ord", limit=200)
    return rel.gate(out.result, out.status).select(
        "priority", F.col("count").alias("orders"), _d("sum_total", 2), "first_ord", "last_ord",
        F.col("unit_total").alias("unit"))


@query("aggregate_status", f"""
WITH {_TYPED}
SELECT 'complete' AS status, count(*) AS examined, count_if(dt >= DATE '1997-01-01') AS matched, CAST(0 AS BIGINT) AS malformed
FROM k""")
def aggregate_status(t):
    return rel.aggregate_by(render(t.spread("orders"), ORDER_CELLS), ["priority"], [("count", None), ("sum", "total")],
                            where=_ORDERS_SINCE, limit=200).status


@query("global_aggregate", """
SELECT count(*) AS n, round(CAST(sum(CAST(l_extendedprice AS DECIMAL(28,10))) AS DOUBLE), 2) AS sum_price,
  round(CAST(avg(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE), 4) AS average_price,
  round(CAST(min(l_extendedprice) AS DOUBLE), 2) AS minimum_price,
  round(CAST(max(l_extendedprice) AS DOUBLE), 2) AS maximum_price FROM lineitem WHERE l_discount > l_tax""")
def global_aggregate(t):
    out = rel.aggregate_by(
        render(t.spread("lineitem"), LINE_CELLS), [], [("count", None)] + [(m, "price") for m in
                                                                 ("sum", "average", "minimum", "maximum")],
        where=[("discount", "gt", F.col("tax"))])
    return rel.gate(out.result, out.status).select(
        F.col("count").alias("n"), _d("sum_price", 2), _d("average_price", 4), _d("minimum_price", 2), _d("maximum_price", 2))


@query("grouped_metrics", """
SELECT l_returnflag AS flag, l_linestatus AS line_status, count(*) AS n,
  round(CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE), 2) AS sum_quantity,
  round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE), 2) AS sum_price
FROM lineitem GROUP BY 1, 2""")
def grouped_metrics(t):
    cells = render(t.spread("lineitem"), {**LINE_CELLS, "line_status": "l_linestatus", "quantity": "CAST(l_quantity AS STRING)"})
    out = rel.aggregate_by(cells, ["flag", "line_status"], [("count", None), ("sum", "quantity"), ("sum", "price")])
    return rel.gate(out.result, out.status).select(
        "flag", "line_status", F.col("count").alias("n"), _d("sum_quantity", 2), _d("sum_price", 2))


# groups plus appended rows labelled as totals
_WITH_TOTALS = """SELECT o_orderpriority AS grp, CAST(o_totalprice AS STRING) AS amount FROM orders UNION ALL
SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'Grand-Total' WHEN o_orderkey % 3 = 1 THEN 'SUBTOTAL' ELSE ' overall ' END, '999'
FROM orders WHERE o_orderstatus = 'P'"""


@query("totals_excluded", f"""
SELECT grp, count(*) AS n, round(CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE), 2) AS sum_amount FROM ({_WITH_TOTALS})
WHERE trim(lower(replace(grp, '-', ' '))) NOT IN ({quoted(vocab.TOTAL_LABELS)}) GROUP BY 1""")
def totals_excluded(t):
    t.orders.createOrReplaceTempView("orders")
    out = rel.aggregate_by(t.spark.sql(_WITH_TOTALS), ["grp"], [("count", None), ("sum", "amount")])
    return rel.gate(out.result, out.status).select("grp", F.col("count").alias("n"), _d("sum_amount", 2))


_MIXED_UNITS = {"row_ord": "l_orderkey * 10 + l_linenumber", "flag": "l_returnflag",
                "price": "CASE WHEN l_returnflag = 'R' AND l_orderkey % 2 = 0 THEN CAST(l_extendedprice AS STRING) || ' EUR' "
                         "ELSE '$' || CAST(l_extendedprice AS STRING) END"}


@query("mixed_units_refused", """
SELECT 'unsupported' AS status, count(*) AS examined, count(*) AS matched, CAST(0 AS BIGINT) AS malformed, CAST(0 AS BIGINT)
  AS published FROM lineitem""")
def mixed_units_refused(t):
    out = rel.aggregate_by(render(t.spread("lineitem"), _MIXED_UNITS), ["flag"], [("sum", "price")])
    return out.status.withColumn("published", rel.gate(out.result, out.status).agg(F.count(F.lit(1))).scalar())


@query("malformed_blocks_result", """
SELECT 'incomplete' AS status, count(*) AS examined, count(*) AS matched, count_if(o_orderkey % 1000 = 7) AS malformed,
  CAST(0 AS BIGINT) AS published FROM orders""")
def malformed_blocks_result(t):
    out = rel.aggregate_by(render(t.spread("orders"), PLAIN_ORDER), ["priority"], [("sum", "total")],
                           malformed=F.col("row_ord") % 1000 == 7)
    return out.status.withColumn("published", rel.gate(out.result, out.status).agg(F.count(F.lit(1))).scalar())


@query("cheapest_parts_per_brand", """
SELECT p_brand AS brand, p_partkey, is_single FROM (SELECT *, count(*) OVER (PARTITION BY p_brand) = 1 AS is_single FROM
  (SELECT *, min(p_retailprice) OVER (PARTITION BY p_brand) AS low FROM part) WHERE p_retailprice = low)""")
def cheapest_parts_per_brand(t):
    p = t.part.selectExpr("p_partkey", "p_brand AS brand", "'$' || CAST(p_retailprice AS STRING) AS price")
    return rel.extrema_rows(p, "price", "minimum", ["brand"]).select("brand", "p_partkey", "is_single")


@query("largest_quantity_lines", """
SELECT l_orderkey * 10 + l_linenumber AS row_ord, false AS is_single FROM lineitem
WHERE l_quantity = (SELECT max(l_quantity) FROM lineitem)""")
def largest_quantity_lines(t):
    lines = render(t.spread("lineitem"), {"row_ord": LINE_CELLS["row_ord"], "quantity": "CAST(l_quantity AS STRING)"})
    return rel.extrema_rows(lines, "quantity").select("row_ord", "is_single")


@query("group_contributors", """
SELECT l_returnflag AS flag, count(*) AS contributors, min(l_orderkey * 10 + l_linenumber) AS first_ord,
  max(l_orderkey * 10 + l_linenumber) AS last_ord FROM lineitem WHERE l_quantity >= 25 AND l_orderkey % 101 <> 0 GROUP BY 1""")
def group_contributors(t):
    return rel.contributors(render(t.spread("lineitem"), LINE_CELLS), ["flag"], "row_ord", [("quantity", "ge", 25)])


@query("universal_check", """
SELECT count_if(NOT l_discount <= 0.08) = 0 AS verdict, count_if(NOT l_discount <= 0.08) AS failures, count(*) AS examined
FROM lineitem""")
def universal_check(t):
    out = rel.complete_check(render(t.spread("lineitem"), LINE_CELLS), "discount", [("discount", "le", "0.08")])
    return rel.gate(out.result, out.status)


@query("universal_failures", """
SELECT l_orderkey * 10 + l_linenumber AS row_ord FROM lineitem WHERE l_orderkey % 101 = 0""")
def universal_failures(t):
    return rel.complete_check(render(t.spread("lineitem"), LINE_CELLS), "quantity").audit.select("row_ord")


@query("overflow_refused", """
SELECT CASE WHEN count(*) > 200 THEN 'unsupported' ELSE 'complete' END AS status, count(*) AS examined, count(*) AS matched,
  CAST(0 AS BIGINT) AS malformed, CASE WHEN count(*) > 200 THEN 0 ELSE count(*) END AS published
FROM (SELECT DISTINCT o_custkey FROM orders)""")
def overflow_refused(t):
    groups = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    out = rel.result_limit(groups, 200)
    return out.status.withColumn("published", rel.gate(out.result, out.status).agg(F.count(F.lit(1))).scalar())


@query("metric_rows", """
WITH g AS (SELECT l_returnflag AS flag, count(*) AS c, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS s,
  max(CAST(l_extendedprice AS DECIMAL(18,2))) AS m FROM lineitem GROUP BY 1)
SELECT flag, 'count' AS metric, round(CAST(c AS DOUBLE), 2) AS value, '' AS unit FROM g
UNION ALL SELECT flag, 'sum_price', round(CAST(s AS DOUBLE), 2), 'USD' FROM g
UNION ALL SELECT flag, 'maximum_price', round(CAST(m AS DOUBLE), 2), 'USD' FROM g""")
def metric_rows(t):
    metrics = [("count", None), ("sum", "price"), ("maximum", "price")]
    out = rel.aggregate_by(render(t.spread("lineitem"), LINE_CELLS), ["flag"], metrics)
    return rel.metric_rows(out, ["flag"], metrics).select("flag", "metric", _d("value", 2), F.coalesce("unit", F.lit("")).alias("unit"))


@query("typed_sort", f"""
WITH {_TYPED}, s AS (SELECT *, {kind_sql(squash_sql('total'))} AS tk, {kind_sql('placed')} AS pk FROM k)
SELECT customer, row_ord, CAST(row_number() OVER (PARTITION BY customer ORDER BY CASE WHEN pk = 'null' THEN 9 ELSE 2 END,
  dt DESC NULLS LAST, CASE WHEN tk = 'null' THEN 9 ELSE 1 END, num NULLS LAST, row_ord) AS BIGINT) AS position FROM s""")
def typed_sort(t):
    ranked = ordering.rank_typed(render(t.spread("orders"), ORDER_CELLS), [("placed", "desc"), ("total", "asc")], "row_ord", ["customer"])
    return ranked.select("customer", "row_ord", F.col("position").cast("long").alias("position"))


@query("groups_in_typed_order", """
SELECT placed, count(*) AS n FROM (SELECT CAST(CAST(o_orderdate AS DATE) AS STRING) AS placed FROM orders) GROUP BY placed""")
def groups_in_typed_order(t):
    out = rel.aggregate_by(render(t.spread("orders"), PLAIN_ORDER), ["placed"], [("count", None)])
    return ordering.sort_groups(out.result, [("placed", "desc")], ["placed"]).select("placed", F.col("count").alias("n"))


@query("top_orders", """
SELECT o_orderkey, round(o_totalprice, 2) AS total FROM orders ORDER BY o_totalprice DESC, o_custkey, o_orderkey LIMIT 50""")
def top_orders(t):
    return ordering.top_k(t.orders, 50, F.desc("o_totalprice"), F.asc("o_custkey"), F.asc("o_orderkey")).select(
        "o_orderkey", F.round("o_totalprice", 2).alias("total"))


@query("top_documents_per_source", """
WITH a AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS s FROM documents),
b AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS position FROM a WHERE s <= 3)
SELECT lang, source, doc_id, CAST(position AS BIGINT) AS position FROM b WHERE position <= 6""")
def top_documents_per_source(t):
    ranked = t.documents.withColumn("_r", F.struct(-F.col("n_chars"), F.col("doc_id")))
    return ordering.top_k_per_source(ranked, ["lang"], "source", F.col("_r"), per=3, total=6).select(
        "lang", "source", "doc_id", F.col("position").cast("long").alias("position"))


@query("latest_messages", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM conversations)
SELECT conv_id, sha256(string_agg(CAST(turn AS STRING) || ':' || role || ':' || text, '|' ORDER BY turn)) AS digest,
  count(*) AS n FROM r WHERE age <= 3 GROUP BY 1""")
def latest_messages(t):
    nested = ordering.latest_n(t.conversations, ["conv_id"], "turn", 3, ["role", "text"])
    line = F.transform("messages", lambda m: F.concat_ws(":", m["turn"].cast("string"), m["role"], m["text"]))
    return nested.select("conv_id", F.sha2(F.array_join(line, "|"), 256).alias("digest"), F.size("messages").cast("long").alias("n"))


# orders as a customer's answers, their lines as claims, each with none to two citations
_CLAIM_LINES = "SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS line FROM lineitem"
_CITATIONS = {"answer_id": "l_orderkey", "claim_ordinal": "line", "ordinal": "i", "block_id": "l_partkey + i"}


@query("latest_answers", f"""
WITH a AS (SELECT o_custkey AS workspace, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey DESC) AS age
  FROM orders QUALIFY age <= 4),
c AS (SELECT l_orderkey, line, l_returnflag || '[' || CASE l_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN CAST(l_partkey + 1 AS STRING)
  ELSE (l_partkey + 1) || ',' || (l_partkey + 2) END || ']' AS said FROM ({_CLAIM_LINES})),
w AS (SELECT l_orderkey, string_agg(said, ';' ORDER BY line) AS claims FROM c GROUP BY 1)
SELECT workspace, o_orderkey AS answer_id, row_number() OVER (PARTITION BY workspace ORDER BY age DESC) AS position, coalesce(claims, '') AS claims
FROM a LEFT JOIN w ON l_orderkey = o_orderkey""")
def latest_answers(t):
    in_order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    lines = t.spread("lineitem").withColumn("line", F.row_number().over(in_order))
    answers = t.orders.selectExpr("o_custkey AS workspace", "o_orderkey AS answer_id", "CAST(o_orderdate AS DATE) AS created")
    claims = lines.selectExpr("l_orderkey AS answer_id", "line AS ordinal", "l_returnflag AS said")
    cites = render(lines.selectExpr("l_orderkey", "line", "l_partkey", "explode(slice(array(1, 2), 1, CAST(l_suppkey % 3 AS INT))) AS i"), _CITATIONS)
    whole = ordering.latest_answers(answers, claims, cites, ["workspace"], ["created", "answer_id"], 4)
    said = F.transform("claims", lambda c: F.concat(c["said"], F.lit("["), F.array_join(F.transform(c["citations"], lambda x: x["block_id"].cast("string")), ","), F.lit("]")))
    return whole.select("workspace", "answer_id", F.col("position").cast("long").alias("position"), F.array_join(said, ";").alias("claims"))


@query("continued_ordinals", """
WITH top AS (SELECT conv_id, max(turn) AS top FROM conversations WHERE role <> 'user' GROUP BY 1)
SELECT c.conv_id, c.turn, CAST(coalesce(top.top, 0) + row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn) AS BIGINT)
  AS ordinal FROM conversations c LEFT JOIN top USING (conv_id) WHERE c.role = 'user'""")
def continued_ordinals(t):
    c = t.conversations
    return ordering.next_ordinals(c.where("role = 'user'"), c.where("role <> 'user'"), ["conv_id"], "turn", F.asc("turn")).select(
        "conv_id", "turn", F.col("ordinal").cast("long").alias("ordinal"))


@query("merged_lanes", """
WITH a AS (SELECT lang AS q, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS r FROM documents),
b AS (SELECT lang AS q, doc_id, row_number() OVER (PARTITION BY lang ORDER BY source, doc_id) AS r FROM documents),
u AS (SELECT q, doc_id, 0 AS lane, r FROM a WHERE r <= 20 UNION ALL SELECT q, doc_id, 1, r FROM b WHERE r <= 20),
f AS (SELECT q, doc_id, min(lane * 1000 + r) AS f FROM u GROUP BY 1, 2)
SELECT q, doc_id, CAST(f // 1000 AS INT) AS lane, CAST(row_number() OVER (PARTITION BY q ORDER BY f, doc_id) AS BIGINT) AS position
FROM f""")
def merged_lanes(t):
    d = t.documents.select(F.col("lang").alias("q"), "doc_id", "n_chars", "source")
    a = ordering.top_k_per(d, ["q"], 20, F.desc("n_chars"), F.asc("doc_id"))
    b = ordering.top_k_per(d, ["q"], 20, F.asc("source"), F.asc("doc_id"))
    return sets.merge_lanes([a, b], ["q"], "doc_id", "rank").withColumn("position", F.col("position").cast("long"))


@query("partition_balance", """
WITH f AS (SELECT d.source, d.doc_id, max(CASE WHEN l.quality = 1 THEN 1 ELSE 0 END) AS i,
  max(CASE WHEN l.toxic = 1 THEN 1 ELSE 0 END) AS x FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1, 2)
SELECT source, count(*) AS candidates, CAST(sum(i) AS BIGINT) AS included, CAST(sum(x) AS BIGINT) AS excluded,
  count_if(i + x = 2) AS overlapping, count_if(i + x = 0) AS missing, CAST(0 AS BIGINT) AS unknown,
  CAST(0 AS BIGINT) AS repeated, count_if(i + x <> 1) = 0 AS holds FROM f GROUP BY 1""")
def partition_balance(t):
    d = t.documents.select("doc_id", "source")
    l = t.labels.join(d, "doc_id")
    return sets.partition_check(d, l.where("quality = 1"), l.where("toxic = 1"), "doc_id", "source")


@query("bag_differences", """
WITH a AS (SELECT l_returnflag AS k, l_linenumber AS v, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2),
e AS (SELECT l_returnflag AS k, l_linenumber AS v, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2)
SELECT coalesce(a.k, e.k) AS k, bool_and(coalesce(a.n, 0) = coalesce(e.n, 0)) AS equal,
  bool_and(coalesce(a.n, 0) >= coalesce(e.n, 0)) AS contains FROM a FULL JOIN e ON a.k = e.k AND a.v = e.v GROUP BY 1""")
def bag_differences(t):
    l = t.lineitem.select(F.col("l_returnflag").alias("k"), F.col("l_linenumber").alias("v"), "l_linestatus")
    return sets.multiset_diff(l.where("l_linestatus = 'O'"), l.where("l_linestatus = 'F'"), ["k"], "v")


@query("order_line_bags", """
WITH b AS (SELECT l_orderkey, list_sort(list(l_linenumber)) AS nums, list_sort(list(DISTINCT l_linenumber)) AS uniq FROM lineitem
  GROUP BY 1)
SELECT l_orderkey, nums = uniq AS equal_bags, len(list_filter(nums, lambda x: x > 4)) = 0 AS subset FROM b""")
def order_line_bags(t):
    b = t.lineitem.groupBy("l_orderkey").agg(
        F.collect_list("l_linenumber").alias("nums"), F.collect_set("l_linenumber").alias("uniq"))
    return b.select("l_orderkey", sets.bags_equal(F.col("nums"), F.col("uniq")).alias("equal_bags"),
                    sets.set_subset(F.col("nums"), F.array(*[F.lit(i) for i in (1, 2, 3, 4)])).alias("subset"))
