"""Frames rendered from the given tables with the same expressions in Spark and in the checking SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame

from factloom.functions import vocab


def as_list(cols: dict[str, str]) -> list[str]:
    return [f"{expr} AS {name}" for name, expr in cols.items()]


def select_sql(cols: dict[str, str], source: str) -> str:
    return f"SELECT {', '.join(as_list(cols))} FROM {source}"


def render(df: DataFrame, cols: dict[str, str]) -> DataFrame:
    return df.selectExpr(*as_list(cols))


# orders as the text cells of a hand-kept sheet: blanks, null words, currency forms, several date styles
_D = "CAST(o_orderdate AS DATE)"
ORDER_CELLS = {
    "row_ord": "o_orderkey",
    "order_id": "'ORD-' || CAST(o_orderkey AS STRING)",
    "customer": "CASE WHEN o_custkey % 50 = 0 THEN 'n/a' ELSE CAST(o_custkey AS STRING) END",
    "status": "CASE WHEN o_orderstatus = 'F' THEN 'Yes' WHEN o_orderstatus = 'O' THEN 'no' ELSE o_orderstatus END",
    "total": "CASE WHEN o_orderkey % 97 = 0 THEN '-' WHEN o_orderkey % 3 = 0 THEN '$' || CAST(o_totalprice AS STRING) "
             "WHEN o_orderkey % 3 = 1 THEN CAST(o_totalprice AS STRING) || ' USD' "
             "ELSE '  USD ' || CAST(o_totalprice AS STRING) || '  ' END",
    "placed": f"CASE WHEN o_orderkey % 89 = 0 THEN 'unknown' WHEN o_orderkey % 2 = 0 THEN CAST({_D} AS STRING) "
              f"ELSE CAST(month({_D}) AS STRING) || '/' || CAST(day({_D}) AS STRING) || '/' || "
              f"CAST(year({_D}) AS STRING) END",
    "priority": "o_orderpriority",
}

LINE_CELLS = {
    "row_ord": "l_orderkey * 10 + l_linenumber",
    "order_id": "'ORD-' || CAST(l_orderkey AS STRING)",
    "quantity": "CASE WHEN l_orderkey % 101 = 0 THEN '' ELSE CAST(l_quantity AS STRING) END",
    "price": "'$' || CAST(l_extendedprice AS STRING)",
    "discount": "CAST(l_discount AS STRING)",
    "tax": "CAST(l_tax AS STRING)",
    "flag": "l_returnflag",
    "shipped": "CAST(CAST(l_shipdate AS DATE) AS STRING)",
}

PLAIN_ORDER = {
    "row_ord": "o_orderkey",
    "order_id": "'ORD-' || CAST(o_orderkey AS STRING)",
    "total": "CAST(o_totalprice AS STRING)",
    "placed": "CAST(CAST(o_orderdate AS DATE) AS STRING)",
    "priority": "o_orderpriority",
    "status": "o_orderstatus",
}


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def squash_sql(v: str) -> str:
    return f"trim(regexp_replace(coalesce({v}, ''), '\\s+', ' ', 'g'))"


def date_sql(v: str) -> str:
    return (
        f"CAST(CASE WHEN regexp_full_match({v}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN try_strptime({v}, '%Y-%m-%d') "
        f"WHEN regexp_full_match({v}, '[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}') THEN try_strptime({v}, '%m/%d/%Y') "
        f"WHEN regexp_full_match({v}, '[0-9]{{4}} [0-9]{{1,2}} [0-9]{{1,2}}') THEN try_strptime({v}, '%Y %m %d') "
        f"WHEN regexp_full_match({v}, '[0-9]{{1,2}} [0-9]{{1,2}} [0-9]{{4}}') THEN try_strptime({v}, '%m %d %Y') END AS DATE)"
    )


_NUM = r"(?i)([$€£]|USD|CAD|EUR|GBP)? ?([+-]?(?:[0-9]+(?:[, ][0-9]{3})*)?(?:\.[0-9]+)?) ?(%|USD|CAD|EUR|GBP)?"


def kind_sql(v: str) -> str:
    """Kind of a squashed cell."""
    return (
        f"CASE WHEN lower({v}) IN ({quoted(vocab.NULL_WORDS)}) THEN 'null' "
        f"WHEN lower({v}) IN ({quoted(vocab.TRUE_WORDS + vocab.FALSE_WORDS)}) THEN 'boolean' "
        f"WHEN {date_sql(v)} IS NOT NULL THEN 'date' "
        f"WHEN (regexp_full_match({v}, '[A-Za-z0-9][A-Za-z0-9_.:/-]*') AND regexp_matches({v}, '[0-9]') "
        f"AND regexp_matches({v}, '[A-Za-z]')) OR regexp_full_match({v}, '0[0-9]+') THEN 'identifier' "
        f"WHEN regexp_full_match({v}, '{_NUM}') AND regexp_matches({v}, '[0-9]') THEN 'number' ELSE 'text' END"
    )


def num_sql(v: str) -> str:
    return f"TRY_CAST(regexp_replace(regexp_extract({v}, '^{_NUM}$', 2), '[, ]', '', 'g') AS DECIMAL(28,10))"


def unit_sql(v: str) -> str:
    pre, suf = f"upper(regexp_extract({v}, '^{_NUM}$', 1))", f"upper(regexp_extract({v}, '^{_NUM}$', 3))"
    return (f"CASE WHEN {suf} <> '' THEN {suf} WHEN {pre} = '$' THEN 'USD' WHEN {pre} = '€' THEN 'EUR' "
            f"WHEN {pre} = '£' THEN 'GBP' WHEN {pre} <> '' THEN {pre} END")


def words_sql(text: str) -> str:
    """Folded word tokens of a text (documents hold composed letters only)."""
    return rf"regexp_extract_all(replace(lower({text}), 'ß', 'ss'), '[\p{{L}}\p{{N}}]+')"


def key_sql(text: str) -> str:
    return f"array_to_string({words_sql(text)}, ' ')"


def long_words_sql(text: str) -> str:
    """Tokens of two characters and more, or digits."""
    return rf"list_filter({words_sql(text)}, lambda x: length(x) >= 2 OR regexp_full_match(x, '\p{{Nd}}+'))"


def forms_sql(t: str) -> str:
    """Equivalent forms of one token, as a list."""
    alpha = rf"regexp_full_match({t}, '\p{{L}}+')"
    n = f"length({t})"
    ies = f"({alpha} AND {n} > 4 AND {t} LIKE '%ies')"
    es = f"({alpha} AND {n} > 4 AND {t} LIKE '%es' AND {t} NOT LIKE '%ies')"
    s3 = f"({alpha} AND {n} = 3 AND regexp_matches({t}, '[^aeiou]s$'))"
    sx = (f"({alpha} AND {n} > 3 AND {t} LIKE '%s' AND NOT {ies} AND NOT {es} "
          f"AND NOT regexp_matches({t}, '(ss|is|us|ws)$'))")
    ed = f"({alpha} AND {n} > 4 AND {t} LIKE '%ed')"
    hiss = f"({es} AND regexp_matches({t}, '(sses|xes|zes|ches|shes|ses)$'))"
    return (
        f"list_distinct(list_filter([{t}, CASE WHEN {s3} OR {sx} OR {es} THEN {t}[:-2] END, "
        f"CASE WHEN {ed} THEN {t}[:-3] END, CASE WHEN {ed} THEN {t}[:-2] END, "
        f"CASE WHEN {ies} THEN {t}[:-4] || 'y' END, CASE WHEN {hiss} THEN {t}[:-3] END], lambda x: x IS NOT NULL))"
    )
