"""Reconciling orders, line items and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import reconcile as rec
from factloom.operators import relational as rel
from factloom.plans.registry import query
from factloom.plans.shared import LINE_CELLS, PLAIN_ORDER, render

_SIDES = """l AS (SELECT 'ORD-' || CAST(o_orderkey AS STRING) AS key, count(*) AS n FROM orders GROUP BY 1),
r AS (SELECT 'ORD-' || CAST(l_orderkey AS STRING) AS key, count(*) AS n FROM lineitem GROUP BY 1),
x AS (SELECT key, coalesce(l.n, 0) AS n_left, coalesce(r.n, 0) AS n_right FROM l FULL JOIN r USING (key)),
s AS (SELECT *, CASE WHEN n_right = 0 THEN 'left_only' WHEN n_left = 0 THEN 'right_only' ELSE 'matched' END AS side FROM x)"""


def _orders(t):
    return render(t.spread("orders"), PLAIN_ORDER)


def _lines(t):
    return render(t.spread("lineitem"), LINE_CELLS)


@query("reconciled_keys", f"""WITH {_SIDES}
SELECT key, n_left, n_right, side, CAST(n_left AS STRING) || ':' || CAST(n_right AS STRING) AS cardinality FROM s""")
def reconciled_keys(t):
    return rec.reconcile(_orders(t), _lines(t), "order_id")


@query("reconciliation_audit", f"""WITH {_SIDES}
SELECT CAST(sum(n_left) AS BIGINT) AS left_rows, CAST(sum(n_right) AS BIGINT) AS right_rows,
  count_if(side = 'matched') AS matched_keys, count_if(side = 'left_only') AS unmatched_left,
  count_if(side = 'right_only') AS unmatched_right, count_if(n_left > 1) + count_if(n_right > 1) AS duplicate_key_groups FROM s""")
def reconciliation_audit(t):
    return rec.reconcile_audit(rec.reconcile(_orders(t), _lines(t), "order_id"))


@query("reconciled_measures", """
WITH l AS (SELECT o_orderkey AS k, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(28,10))) AS s FROM orders GROUP BY 1),
r AS (SELECT l_orderkey AS k, count(*) AS n, sum(CAST(l_extendedprice AS DECIMAL(28,10))) AS s FROM lineitem GROUP BY 1)
SELECT 'ORD-' || CAST(k AS STRING) AS key, l.n AS n_left, r.n AS n_right, round(CAST(l.s AS DOUBLE), 2) AS sum_left,
  round(CAST(r.s AS DOUBLE), 2) AS sum_right, round(CAST(l.s - r.s AS DOUBLE), 2) AS difference FROM l JOIN r USING (k)""")
def reconciled_measures(t):
    orders = render(t.spread("orders"), {**PLAIN_ORDER, "total": "'$' || CAST(o_totalprice AS STRING)"})
    lines = render(t.spread("lineitem"), LINE_CELLS)
    out = rec.reconcile_measures(orders, lines, ("order_id", "order_id"), ("total", "price"))
    d = lambda c: F.round(F.col(c).cast("double"), 2).alias(c)
    return rel.gate(out.result, out.status).select("key", "n_left", "n_right", d("sum_left"), d("sum_right"), d("difference"))


@query("measures_with_clashing_units", """SELECT 'unsupported' AS status, CAST(0 AS BIGINT) AS published""")
def measures_with_clashing_units(t):
    orders = render(t.spread("orders"), {**PLAIN_ORDER, "total": "CAST(o_totalprice AS STRING) || ' EUR'"})
    out = rec.reconcile_measures(orders, render(t.spread("lineitem"), LINE_CELLS), ("order_id", "order_id"), ("total", "price"))
    return out.status.select("status").withColumn(
        "published", rel.gate(out.result, out.status).agg(F.count(F.lit(1))).scalar())


@query("all_keys_matched", """
SELECT 'orders' AS quantified, (SELECT count(*) FROM (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey NOT IN
  (SELECT l_orderkey FROM lineitem))) = 0 AS verdict UNION ALL
SELECT 'lines', (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) = 0""")
def all_keys_matched(t):
    orders, lines = _orders(t), render(t.spread("lineitem"), LINE_CELLS)
    a = rec.all_matched(orders, lines, "order_id").select(F.lit("orders").alias("quantified"), "verdict")
    return a.unionByName(rec.all_matched(lines, orders, "order_id").select(F.lit("lines").alias("quantified"), "verdict"))


@query("unmatched_keys", """
SELECT DISTINCT 'ORD-' || CAST(o_orderkey AS STRING) AS key, 'left' AS side FROM orders
WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def unmatched_keys(t):
    return rec.unmatched(_orders(t), _lines(t), "order_id")


@query("looked_up_customers", """
SELECT o.o_orderkey, coalesce(c.c_mktsegment, '') AS segment, CASE WHEN c.c_custkey IS NULL THEN 'unmatched' ELSE 'matched' END
  AS lookup FROM orders o LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING') c ON o.o_custkey = c.c_custkey""")
def looked_up_customers(t):
    orders = t.orders.selectExpr("o_orderkey", "CAST(o_custkey AS STRING) AS cust")
    customers = t.customer.where("c_mktsegment <> 'BUILDING'").selectExpr("CAST(c_custkey AS STRING) AS ck", "c_mktsegment AS segment")
    out = rec.lookup_join(orders, customers, "cust", "ck", ["segment"])
    return rel.gate(out.result, out.status).select("o_orderkey", F.coalesce("segment", F.lit("")).alias("segment"), "lookup")


@query("ambiguous_lookup_refused", """
SELECT 'unsupported' AS status, count(*) AS examined, count_if(o_orderkey IN (SELECT l_orderkey FROM lineitem)) AS matched,
  CAST(0 AS BIGINT) AS malformed FROM orders""")
def ambiguous_lookup_refused(t):
    return rec.lookup_join(_orders(t), render(t.spread("lineitem"), LINE_CELLS), "order_id", "order_id", ["price"]).status


@query("inferred_join_key", """
WITH n AS (SELECT (SELECT count(DISTINCT o_orderkey) FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)) AS overlap,
  (SELECT count(DISTINCT o_orderkey) FROM orders) AS nl, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS nr)
SELECT 'order_id' AS left_key, 'order_id' AS right_key, overlap, round(least(overlap / nl, overlap / nr), 6) AS coverage,
  round(overlap / (nl + nr - overlap), 6) AS jaccard, round(1.0, 6)::DOUBLE AS identifier_ratio FROM n""")
def inferred_join_key(t):
    orders = render(t.spread("orders"), {"order_id": PLAIN_ORDER["order_id"], "status": "o_orderstatus", "row": "CAST(o_custkey AS STRING)"})
    lines = render(t.spread("lineitem"), {"order_id": LINE_CELLS["order_id"], "status": "l_linestatus", "row": "CAST(l_linenumber AS STRING)"})
    r = rec.infer_join_key(orders, lines, [("status", "status"), ("order_id", "order_id"), ("row", "row")])
    f = lambda c: F.round(c, 6).alias(c)
    return r.select("left_key", "right_key", "overlap", f("coverage"), f("jaccard"), f("identifier_ratio"))


@query("inferred_measures", """
SELECT 'common' AS how, 'amount' AS left_measure, 'amount' AS right_measure UNION ALL SELECT 'mentioned', 'total', 'price'""")
def inferred_measures(t):
    a = render(t.spread("orders"), {"order_id": PLAIN_ORDER["order_id"], "amount": "CAST(o_totalprice AS STRING)", "flag": "o_orderstatus"})
    b = render(t.spread("lineitem"), {"order_id": LINE_CELLS["order_id"], "amount": "CAST(l_extendedprice AS STRING)", "flag": "l_linestatus"})
    common = rec.infer_measures(a, b, [("order_id", "order_id"), ("amount", "amount"), ("flag", "flag")])
    c, d = _orders(t).drop("row_ord"), render(t.spread("lineitem"), LINE_CELLS).drop("row_ord")
    named = rec.infer_measures(c, d, [("order_id", "order_id")], (["total"], ["price"]))
    return common.withColumn("how", F.lit("common")).unionByName(named.withColumn("how", F.lit("mentioned")))


@query("equivalent_headers", """
SELECT substr(a.column_name, 3) AS l_name, upper(substr(b.column_name, 3)) || 's' AS r_name FROM (DESCRIBE customer) a JOIN (DESCRIBE supplier) b
  ON substr(a.column_name, 3) = substr(b.column_name, 3)""")
def equivalent_headers(t):
    """Headers of two given tables, without their prefixes; those of the other table in capitals and in the plural."""
    pairs = rec.headers_equivalent([c[2:] for c in t.customer.columns], [c[2:].upper() + "s" for c in t.supplier.columns], t.spark)
    return pairs.select("l_name", "r_name")


@query("duplicated_keys", """
SELECT l_orderkey AS key, count(*) AS n_rows FROM lineitem GROUP BY 1 HAVING count(*) > 1""")
def duplicated_keys(t):
    return rec.duplicate_keys(t.lineitem, "l_orderkey")


@query("blocks_of_ready_files", """
SELECT d.doc_id AS file_id, d.lang AS run_id, d.n_chars FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality = 1""")
def blocks_of_ready_files(t):
    blocks = t.documents.selectExpr("lang AS run_id", "doc_id AS file_id", "n_chars")
    files = t.labels.join(t.documents, "doc_id").selectExpr(
        "lang AS run_id", "doc_id AS file_id", "CASE WHEN quality = 1 THEN 'ready' ELSE 'capped' END AS status")
    return rec.blocks_with_files(blocks, files).select("run_id", "file_id", "n_chars")


@query("latest_order_per_customer", """
SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC,
  o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""")
def latest_order_per_customer(t):
    return rec.latest_per(t.orders.select("o_custkey", "o_orderdate", "o_orderkey", "o_orderpriority"), ["o_custkey"],
                          ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderpriority")
