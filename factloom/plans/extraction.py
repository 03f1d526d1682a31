"""Literals, label/value extraction and question tagging.

The given documents hold few labelled values, so sheets are rendered from part, supplier and orders rows with the same
expressions in Spark and SQL; the checks then compute the expected values from the columns, not from the text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import literals
from factloom.operators import blocks, extract, tables, tagging
from factloom.plans.registry import query
from factloom.session import cut_lineage
from factloom.plans.shared import quoted, render, words_sql

# --- literals in prose -------------------------------------------------------------------------------------------
_DAY = "CAST(CAST(o_orderdate AS DATE) AS STRING)"
_ODD = "o_orderkey % 2 = 1"
_PARTS = [  # fixed words and literals in turn: (text expression, kind, normal form)
    ("'Order '", None, None),
    ("'ORD-' || CAST(o_orderkey AS STRING) || '/A1'", "identifier", "'ORD-' || CAST(o_orderkey AS STRING) || '/A1'"),
    ("' placed '", None, None),
    (_DAY, "date", _DAY),
    ("', paid '", None, None),
    ("'$' || CAST(o_custkey AS STRING) || ',500.50'", "money", "'$ ' || CASE WHEN o_custkey = 0 THEN '' ELSE CAST(o_custkey AS STRING) END || '500.5'"),
    ("' less '", None, None),
    ("CAST(o_orderkey % 90 AS STRING) || '.50 %'", "percent", "CAST(o_orderkey % 90 AS STRING) || '.5%'"),
    ("'; due March '", None, None),
    ("CAST(o_custkey % 28 + 1 AS STRING) || 'th, 1999'", "date", None),
    ("' write c'", None, None),
    ("CAST(o_custkey AS STRING) || '@shop.example.org'", "email", None),
    ("' or https://shop.example.org/o/'", None, None),
    ("CAST(o_orderkey AS STRING)", "url", None),
    ("' about '", None, None),
    ("CAST(o_custkey % 1000 AS STRING)", "number", "CAST(o_custkey % 1000 AS STRING)"),
    ("' crates of v2x and Feb 30, 1999 ~ 12 EUR'", None, None),
]
_PROSE = " || ".join(p[0] for p in _PARTS)
_PROSE_COLS = {"row_ord": "o_orderkey", "text": _PROSE}


def _pos(i: int, back: int = 0) -> str:
    return f"CAST(length({' || '.join(p[0] for p in _PARTS[:i])}) - {back} AS BIGINT)"


_D2 = "CAST(o_custkey % 28 + 1 AS STRING)"
_EXPECTED = [(_pos(1), "'identifier'", _PARTS[1][2]), (_pos(3), "'date'", _DAY), (_pos(5), "'money'", _PARTS[5][2]),
             (_pos(7), "'percent'", _PARTS[7][2]),
             (_pos(9, 6), "'date'", f"'1999-03-' || CASE WHEN length({_D2}) = 1 THEN '0' ELSE '' END || {_D2}"),
             (_pos(11, 1), "'email'", "'c' || CAST(o_custkey AS STRING) || '@shop.example.org'"),
             (_pos(13, 27), "'url'", "'https://shop.example.org/o/' || CAST(o_orderkey AS STRING)"),
             (_pos(15), "'number'", _PARTS[15][2]),
             (f"CAST({_pos(16)} + 23 AS BIGINT)", "'number'", "'30'"),
             (f"CAST({_pos(16)} + 27 AS BIGINT)", "'number'", "'1999'"),
             (f"CAST({_pos(16)} + 34 AS BIGINT)", "'money'", "'EUR 12'")]


@query("prose_literals", " UNION ALL ".join(
    f"SELECT o_orderkey AS row_ord, {s} AS start, {k} AS kind, {n} AS norm FROM orders" for s, k, n in _EXPECTED))
def prose_literals(t):
    d = render(t.spread("orders"), _PROSE_COLS)
    found = d.select("row_ord", F.inline(literals.extract_literals(F.col("text"))))
    return found.select("row_ord", F.col("start").cast("long").alias("start"), "kind", "norm")


@query("document_emails", r"""
SELECT doc_id, count(*) AS n, string_agg(e, ' ' ORDER BY e) AS emails FROM (SELECT doc_id,
  unnest(regexp_extract_all(text, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b')) AS e FROM documents) GROUP BY 1""")
def document_emails(t):
    found = t.spread("documents").select("doc_id", F.explode(literals.extract_literals(F.col("text"))).alias("l")).where("l.kind = 'email'")
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("l.raw")), " ").alias("emails"))


@query("comparable_values", """
SELECT o_orderkey AS row_ord, 'currency' AS kind, '$:' || CASE WHEN o_custkey = 0 THEN '' ELSE CAST(o_custkey AS STRING) END || '500.5' AS norm FROM orders
UNION ALL SELECT o_orderkey, 'percent', CAST(o_orderkey % 90 AS STRING) || '.50%' FROM orders
UNION ALL SELECT o_orderkey, 'date', CAST(CAST(o_orderdate AS DATE) AS STRING) FROM orders
UNION ALL SELECT o_orderkey, 'identifier', 'ord-' || CAST(o_orderkey AS STRING) FROM orders
UNION ALL SELECT o_orderkey, 'status', 'not received' FROM orders WHERE o_orderkey % 2 = 0""")
def comparable_values(t):
    text = ("'Invoice ORD-' || CAST(o_orderkey AS STRING) || ' of ' || CAST(CAST(o_orderdate AS DATE) AS STRING) || ': $' || CAST(o_custkey AS STRING) "
            "|| ',500.50 at ' || CAST(o_orderkey % 90 AS STRING) || '.50 % ' || CASE WHEN o_orderkey % 2 = 0 THEN 'Not received' ELSE 'seen' END")
    d = t.spread("orders").selectExpr("o_orderkey AS row_ord", f"{text} AS text")
    return d.select("row_ord", F.inline(literals.comparable_values(F.col("text")))).select("row_ord", "kind", "norm")


# --- labelled values ---------------------------------------------------------------------------------------------
_NL = "chr(10)"
_REVIEW = "'2024-01-' || CASE WHEN p_size % 28 + 1 < 10 THEN '0' ELSE '' END || CAST(p_size % 28 + 1 AS STRING)"
_PART_SHEET = f" || {_NL} || ".join([
    "'Sheet of part ' || CAST(p_partkey AS STRING)",
    "'The document lists retail price: $' || CAST(p_retailprice AS STRING) || '; Brand = ' || p_brand",
    "'Shelf sizes — ' || CAST(p_size AS STRING) || ' %'",
    "'Type is ' || p_type || '. Name of item was ' || p_name",
    f"'Review date ' || {_REVIEW} || ', as agreed'",
    "'Owner'", "''", "'Team ' || p_type",
    "'17 EUR - handling fee'",
    "'Warehouse | W-' || CAST(p_size AS STRING) || ' | spare'",
    "'Item code: see annex'",
    "'Nothing to see here about pricing or ownership'",
])
_TARGETS = ["price", "brand", "shelf size", "type", "review dates", "owner", "fee", "warehouse", "item"]
_PRICE = "regexp_replace(regexp_replace(CAST(p_retailprice AS STRING), '0+$', ''), '[.]$', '')"
_EXPECTED_VALUES = [
    ("price", "money", f"'$ ' || {_PRICE}"), ("brand", "text", "p_brand"), ("shelf size", "percent", "CAST(p_size AS STRING) || '%'"),
    ("type", "text", "p_type"), ("review dates", "date", _REVIEW), ("owner", "text", "'Team ' || p_type"),
    ("fee", "money", "'EUR 17'"), ("warehouse", "identifier", "'W-' || CAST(p_size AS STRING)"),
]
_EXPECTED_SQL = " UNION ALL ".join(
    f"SELECT p_partkey AS file_id, '{a}' AS target, '{k}' AS kind, {n} AS norm FROM part" for a, k, n in _EXPECTED_VALUES)


def _sheets(t):
    return t.dealt("part").selectExpr("p_partkey AS file_id", "0 AS block_ord", "1 AS line_start", f"{_PART_SHEET} AS text")


def _targets(t, names=_TARGETS):
    return t.spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(i).alias("target_id"), F.lit(n).alias("target")) for i, n in enumerate(names)])))


def _occurrences(t):
    targets = _targets(t)
    return extract.extract_many(_sheets(t), ["file_id", "block_ord"], targets).join(F.broadcast(targets), "target_id")


@query("labelled_values", _EXPECTED_SQL)
def labelled_values(t):
    return _occurrences(t).select("file_id", "target", "kind", "norm")


@query("labelled_value_quotes", """
SELECT p_partkey AS file_id, 'Brand = ' || p_brand AS quote, CAST(strpos(""" + _PART_SHEET + """, 'Brand = ') - 1 AS BIGINT) AS quote_start, CAST(2 AS BIGINT) AS line_no
FROM part""")
def labelled_value_quotes(t):
    found = extract.extract_labeled(_sheets(t), ["file_id", "block_ord"], "brands")
    return found.select("file_id", "quote", F.col("quote_start").cast("long").alias("quote_start"), F.col("line_no").cast("long").alias("line_no"))


@query("next_line_values", """SELECT p_partkey AS file_id, 'Owner' AS label, 'Team ' || p_type AS raw FROM part""")
def next_line_values(t):
    found = extract.extract_labeled(_sheets(t), ["file_id", "block_ord"], "owners")
    return found.where("form = 'next_line'").select("file_id", "label", "raw")


@query("distinct_labelled_values", f"""
WITH v AS ({_EXPECTED_SQL}), k AS (SELECT file_id, target, kind, norm FROM v WHERE target IN ('brand', 'shelf size', 'fee'))
SELECT target, kind, norm, count(*) AS occurrences, count(DISTINCT file_id) AS sources, min(file_id) AS first_source,
  coalesce(list_sort(list(file_id))[2], -1) AS second_source FROM k GROUP BY 1, 2, 3""")
def distinct_labelled_values(t):
    occ = _occurrences(t).where(F.col("target").isin("brand", "shelf size", "fee"))
    out = extract.distinct_values(occ, ["target"], "file_id", ["file_id", "block_ord", "quote_start"])
    return out.select("target", "kind", "norm", "occurrences", "sources", "first_source",
                      F.coalesce("second_source", F.lit(-1)).alias("second_source"))


@query("overflowing_label_values", f"""
WITH v AS ({_EXPECTED_SQL}), u AS (SELECT target, kind, norm, count(*) AS n FROM v WHERE target IN ('brand', 'shelf size', 'fee') GROUP BY ALL),
c AS (SELECT target, count(*) AS uniq, CAST(sum(n) AS BIGINT) AS occurrences FROM u GROUP BY 1)
SELECT target, uniq AS "unique", occurrences, uniq > 60 AS overflowed, CASE WHEN uniq > 60 THEN 0 ELSE uniq END AS given FROM c""")
def overflowing_label_values(t):
    """Requests with more than sixty distinct values give none of them."""
    occ = _occurrences(t).where(F.col("target").isin("brand", "shelf size", "fee"))
    values = cut_lineage(extract.distinct_values(occ, ["target"], "file_id", ["file_id", "block_ord", "quote_start"]))
    given = extract.limited_values(values, ["target"], 60).groupBy("target").agg(F.count(F.lit(1)).alias("given"))
    told = extract.value_overflow(values, ["target"], 60).withColumnRenamed("all_occurrences", "occurrences")
    return told.join(given, "target", "left").withColumn("given", F.coalesce("given", F.lit(0).cast("long")))


@query("ambiguous_label_lines", """
SELECT p_partkey AS file_id, CAST(11 AS BIGINT) AS line_no FROM part""")
def ambiguous_label_lines(t):
    """'Item code: …' states something next to the label, but not a value of it."""
    keys = ["file_id", "block_ord"]
    lines = blocks.source_lines(_sheets(t), keys)
    found = extract.extract_many(_sheets(t), keys, _targets(t, ["item"]))
    return extract.ambiguous_lines(lines, keys, found, "item").select("file_id", F.col("line_no").cast("long").alias("line_no"))


@query("recovered_assignments", """
SELECT p_brand AS source, min('$ ' || """ + _PRICE + """) AS norm FROM part GROUP BY 1 HAVING count(DISTINCT p_retailprice) = 1
UNION ALL SELECT 'all', 'EUR 17' FROM part GROUP BY 1, 2""")
def recovered_assignments(t):
    occ = _occurrences(t).where("target IN ('price', 'fee')").join(t.part.selectExpr("p_partkey AS file_id", "p_brand AS brand").hint("merge"), "file_id")
    asked = occ.withColumn("source", F.when(F.col("target") == "fee", "all").otherwise(F.col("brand")))  # the fee over all parts, the price by brand
    return extract.assignment_recovery(asked, ["target", "source"]).select("source", "norm")


# --- tables in text, vertical lists, artifacts -------------------------------------------------------------------
_GRID = ("'Staff of ' || s_name || chr(10) || '| Project | Lead owner | Fee |' || chr(10) || '|---|---|---|' || chr(10) || '| P-' || CAST(s_suppkey AS STRING) "
         "|| ' | Nation ' || CAST(s_nationkey AS STRING) || ' | $' || CAST(s_acctbal AS STRING) || ' |' || chr(10) || '| Q-' || CAST(s_suppkey AS STRING) "
         "|| ' | nobody | 5% |'")
_BAL = "CASE WHEN s_acctbal < 0 THEN '-' ELSE '' END || regexp_replace(regexp_replace(CAST(abs(s_acctbal) AS STRING), '0+$', ''), '[.]$', '')"


@query("column_values", f"""
SELECT s_suppkey AS file_id, 'P-' || CAST(s_suppkey AS STRING) || ' — Fee' AS label, 'money' AS kind, '$ ' || {_BAL} AS norm FROM supplier
UNION ALL SELECT s_suppkey, 'Q-' || CAST(s_suppkey AS STRING) || ' — Fee', 'percent', '5%' FROM supplier
UNION ALL SELECT s_suppkey, 'P-' || CAST(s_suppkey AS STRING) || ' — Lead owner', 'text', 'Nation ' || CAST(s_nationkey AS STRING) FROM supplier
UNION ALL SELECT s_suppkey, 'Q-' || CAST(s_suppkey AS STRING) || ' — Lead owner', 'text', 'nobody' FROM supplier""")
def column_values(t):
    b = t.spread("supplier").selectExpr("s_suppkey AS file_id", "1 AS line_start", f"{_GRID} AS text")
    rows = tables.detect_text_tables(blocks.source_lines(b, ["file_id"]))
    return extract.extract_column(rows, _targets(t, ["fees", "owner"])).select("file_id", "label", "kind", "norm")


_VERTICAL = ("'Intro of supplier' || chr(10) || 'Agreed limits' || chr(10) || 'Primary' || chr(10) || '$' || CAST(s_suppkey AS STRING) || ',000' || chr(10) || "
             "'Excess' || chr(10) || CAST(s_nationkey AS STRING) || '%' || chr(10) || 'That is all'")


@query("vertical_values", """
SELECT s_suppkey AS file_id, 'Primary — Agreed limits' AS label, '$ ' || CASE WHEN s_suppkey = 0 THEN '0' ELSE CAST(s_suppkey AS STRING) || '000' END AS norm FROM supplier
UNION ALL SELECT s_suppkey, 'Excess — Agreed limits', CAST(s_nationkey AS STRING) || '%' FROM supplier""")
def vertical_values(t):
    b = t.spread("supplier").selectExpr("s_suppkey AS file_id", "1 AS line_start", f"{_VERTICAL} AS text")
    lines = blocks.source_lines(b, ["file_id"])
    return extract.vertical_pairs(lines, ["file_id"], _targets(t, ["limit"])).select("file_id", "label", "norm")


@query("cell_values", """
SELECT p_partkey AS row_ord, 'header' AS form, p_name || ' — Retail price' AS label, '$ ' || """ + _PRICE + """ AS norm FROM part
UNION ALL SELECT p_partkey, 'row', 'ECONOMY — Size', CAST(p_size AS STRING) FROM part WHERE p_type = 'ECONOMY'
UNION ALL SELECT p_partkey, 'row', 'ECONOMY — Retail price', '$ ' || """ + _PRICE + """ FROM part WHERE p_type = 'ECONOMY'""")
def cell_values(t):
    p = t.dealt("part").selectExpr("p_partkey", "p_name AS `Item name`", "p_type AS `Kind`", "CAST(p_size AS STRING) AS `Size`",
                          "'$' || CAST(p_retailprice AS STRING) AS `Retail price`")
    cells = tables.wide_to_cells(p, F.lit("part"), F.col("p_partkey"), ["Item name", "Kind", "Size", "Retail price"])
    found = extract.extract_from_cells(cells, _targets(t, ["price", "economy"]), ["table_id"])
    return found.select("row_ord", "form", "label", "norm")


# --- question log ------------------------------------------------------------------------------------------------
_ASK = ("CASE conv_id % 8 WHEN 0 THEN 'List all orders where price is above 5. ' WHEN 1 THEN 'How many rows per region, sorted by count? ' "
        "WHEN 2 THEN 'Compare revision 1 and revision 2. ' WHEN 3 THEN 'Do all records have an owner? ' WHEN 4 THEN 'Reconcile orders against invoices. ' "
        "WHEN 5 THEN 'Summarize the table. ' WHEN 6 THEN 'What is the largest claim row? ' ELSE '' END || text")


def _said_sql(single: tuple[str, ...], double: tuple[str, ...]) -> str:
    return "(" + " OR ".join([f"list_has_any(w, [{quoted(single)}])", *[f"contains(' ' || array_to_string(w, ' ') || ' ', ' {p} ')" for p in double]]) + ")"


_FLAGS = ", ".join(f"{_said_sql(*said)} AS f_{i}" for i, said in tagging.ASKED.items())
_ANY = lambda names: "(" + " OR ".join(f"f_{n}" for n in names) + ")"
_TAGS = f"""f AS (SELECT *, {_FLAGS}, {_said_sql(tagging.DATA_SETS, ())} AS f_data FROM (
    SELECT conv_id, turn, {words_sql(f"({_ASK})")} AS w FROM conversations WHERE role = 'user')),
g AS (SELECT *, ({_ANY(tagging.SET_WIDE)} OR (f_data AND {_ANY(('exceptions', 'summary'))})) AS complete_data,
    concat_ws(',', {', '.join(f"CASE WHEN f_{i} THEN '{i}' END" for i in tagging.ASKED)}) AS said FROM f),
h AS (SELECT conv_id, turn, CASE WHEN said = '' THEN 'lookup' ELSE said END AS intents, CASE WHEN f_compare OR f_join THEN 'mixed'
    WHEN complete_data AND {_ANY(tagging.TABULAR)} THEN 'structured' WHEN f_list THEN 'exhaustive' ELSE 'direct' END AS mode, complete_data FROM g)"""


def _tagged(t):
    """User turns as they are, every eighth conversation each with another opening sentence."""
    return tagging.tag_questions(t.conversations.where("role = 'user'").selectExpr("conv_id", "turn", f"{_ASK} AS question"), "question")


@query("tagged_questions", f"WITH {_TAGS} SELECT conv_id, turn, intents, mode, complete_data FROM h")
def tagged_questions(t):
    return _tagged(t).select("conv_id", "turn", F.array_join("intents", ",").alias("intents"), "mode", F.col("needs_complete_data").alias("complete_data"))


@query("question_mix", f"WITH {_TAGS} SELECT mode, intents, count(*) AS n FROM h GROUP BY 1, 2")
def question_mix(t):
    return _tagged(t).groupBy("mode", F.array_join("intents", ",").alias("intents")).agg(F.count(F.lit(1)).alias("n"))
