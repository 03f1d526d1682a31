"""Complete-data operators over string tables: typed filter, aggregate, list, universal check, fail-closed status.

An operator returns an ``Outcome``: the result, the contributing rows, and one status row. Nothing is collected;
``gate`` lets the result through only when its status is ``complete``.
"""

from __future__ import annotations

import operator
from functools import lru_cache, reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import vocab
from factloom.functions.text import covered, let, norm_key, search_words, stop
from factloom.functions.typing import NUM, PLAIN_DATE, PLAIN_DOLLARS, PLAIN_NUMBER, cell_as, compare_typed, condition, is_null_cell, keyed_cells, number_cell, sure_kind, typed_cell

COMPARISONS = {"eq": operator.eq, "ne": operator.ne, "gt": operator.gt, "ge": operator.ge, "lt": operator.lt, "le": operator.le}
Predicate = tuple  # (column, op) | (column, op, literal) | (column, op, F.col(other))


class Outcome(NamedTuple):
    result: DataFrame
    audit: DataFrame
    status: DataFrame


@lru_cache(maxsize=1024)
def _typed_literal(value: str):
    """A literal typed once, by the same rules as the cells (a one-row local relation; no job runs over data)."""
    spark = SparkSession.active()
    return spark.createDataFrame([(value,)], "v string").select(typed_cell(F.col("v")).alias("t")).first().t


def _operand(value) -> Column:
    if isinstance(value, Column):
        return typed_cell(value)
    t = _typed_literal(str(value))
    types = {"kind": "string", "raw": "string", "unit": "string", "num": NUM, "dt": "date", "bool": "boolean"}
    return F.struct(*[F.lit(t[n]).cast(d).alias(n) for n, d in types.items()])


def predicate(pred: Predicate) -> Column:
    if len(pred) < 3:
        null = is_null_cell(F.col(pred[0]))
        return {"is_null": null, "not_null": ~null}[pred[1]]
    kind = sure_kind(pred[2])
    general = condition(cell_as(F.col(pred[0]), kind), pred[1], _operand(pred[2]), kind)
    if isinstance(pred[2], Column):
        # two plain numbers have no units and are compared in generated code
        both = F.col(pred[0]).rlike(PLAIN_NUMBER) & pred[2].rlike(PLAIN_NUMBER)
        return F.when(both, F.coalesce(COMPARISONS[pred[1]](F.col(pred[0]).try_cast(NUM), pred[2].try_cast(NUM)), F.lit(False))).otherwise(general)
    if kind not in ("number", "date"):
        return general
    # cells in their plainest form are compared in generated code, without being typed first
    cell, literal = F.col(pred[0]), _typed_literal(str(pred[2]))
    if kind == "number" and literal.num is not None:
        value = F.lit(literal.num).cast(NUM)
        return (F.when(cell.rlike(PLAIN_NUMBER), F.coalesce(COMPARISONS[pred[1]](cell.try_cast(NUM), value), F.lit(False)))
                .when(cell.rlike(PLAIN_DOLLARS), F.lit(literal.unit in (None, "USD"))
                      & F.coalesce(COMPARISONS[pred[1]](F.substring(cell, 2, 40).try_cast(NUM), value), F.lit(False)))
                .otherwise(general))
    if kind == "date" and literal.dt is not None:
        return F.when(cell.rlike(PLAIN_DATE), F.coalesce(COMPARISONS[pred[1]](F.try_to_date(cell, "yyyy-MM-dd"), F.lit(literal.dt)), F.lit(False))).otherwise(general)
    return general


def _cost(pred: Predicate) -> int:
    """Null tests first, then literals of a sure kind, then words and column pairs; a false one spares the rest."""
    return 0 if len(pred) < 3 else 1 if sure_kind(pred[2]) else 2


def all_of(preds: list[Predicate]) -> Column:
    return reduce(lambda a, b: a & b, [predicate(p) for p in sorted(preds, key=_cost)], F.lit(True))


def where_typed(df: DataFrame, preds: list[Predicate]) -> DataFrame:
    """Rows for which every predicate holds; nulls and incomparable cells never match."""
    return df.where(all_of(preds))


def validate_predicates(df: DataFrame, preds: list[Predicate]) -> DataFrame:
    """Per predicate: can its operand be compared with at least one non-null cell of the column? One pass."""
    checks = []
    for p in preds:
        kind = sure_kind(p[2]) if len(p) > 2 else None
        left = cell_as(F.col(p[0]), kind)
        usable = (left["kind"] != "null") if len(p) < 3 else compare_typed(left, _operand(p[2]), kind).isNotNull()
        checks.append(usable)
    flags = df.select(*[c.alias(f"p{i}") for i, c in enumerate(checks)])
    wide = flags.agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in flags.columns])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("predicate"), F.lit(p[0]).alias("column"), F.lit(p[1]).alias("op"),
                 F.col(f"p{i}").alias("comparable"))
        for i, p in enumerate(preds)
    ])))


def gate(result: DataFrame, status: DataFrame) -> DataFrame:
    """The result if its one status row says ``complete``, otherwise no row at all."""
    return result.where(status.select("status").scalar() == F.lit("complete"))


def _status(frame: DataFrame, unsupported: Column, malformed: Column, examined: Column, matched: Column) -> DataFrame:
    return frame.select(
        F.when(malformed > 0, "incomplete").when(unsupported, "unsupported").otherwise("complete").alias("status"),
        examined.cast("long").alias("examined"),
        matched.cast("long").alias("matched"),
        malformed.cast("long").alias("malformed"),
    )


def aggregate_by(
    df: DataFrame,
    keys: list[str],
    metrics: list[tuple[str, str | None]],
    where: list[Predicate] | None = None,
    order: str | None = None,
    limit: int | None = None,
    malformed: Column | None = None,
) -> Outcome:
    """Grouped (or, without keys, global) metrics over number cells only.

    ``metrics`` are ``(count|sum|average|minimum|maximum, column)``. One shuffle: rows are pre-aggregated per
    (matched?, keys) and both the result and the status are read from that small table. Any group without a
    number, with mixed units, or with a number beyond the decimal makes the whole answer ``unsupported``; more
    than ``limit`` outputs do so too, nothing is cut off. Rows labelled as totals are left out of groups.
    """
    hit = all_of(where or [])
    columns = sorted({c for _, c in metrics if c})
    typed = df.select(
        hit.alias("_hit"),
        *[F.when(hit, F.col(k)).alias(k) for k in keys],
        *[number_cell(F.col(c)).alias(f"_t_{c}") for c in columns],
        (F.coalesce(malformed, F.lit(False)) if malformed is not None else F.lit(False)).alias("_bad_row"),
        *( [F.col(order).alias("_ord")] if order else [] ),
    )
    if keys:
        total_row = reduce(lambda a, b: a | b, [norm_key(F.col(k)).isin(*vocab.TOTAL_LABELS) for k in keys])
        typed = typed.withColumn("_total", F.coalesce(total_row, F.lit(False)))
    else:
        typed = typed.withColumn("_total", F.lit(False))
    good = F.col("_hit") & ~F.col("_bad_row")
    aggs = [F.count(F.lit(1)).alias("_rows"), F.count_if("_bad_row").alias("_bad")]
    for c in columns:
        t = F.col(f"_t_{c}")
        number = good & (t["kind"] == "number")
        unit = F.when(number, F.coalesce(t["unit"], F.lit("")))
        num = F.when(number, t["num"])
        aggs += [
            F.count_if(number).alias(f"_n_{c}"),
            F.count_if(number & t["num"].isNull()).alias(f"_over_{c}"),
            F.min(unit).alias(f"_ulo_{c}"),
            F.max(unit).alias(f"_uhi_{c}"),
            F.sum(num).alias(f"sum_{c}"),
            F.avg(num).alias(f"average_{c}"),
            F.min(num).alias(f"minimum_{c}"),
            F.max(num).alias(f"maximum_{c}"),
        ]
    if order:
        aggs += [F.min("_ord").alias("first_ord"), F.max("_ord").alias("last_ord")]
    groups = typed.groupBy("_hit", "_total", *keys).agg(*aggs)
    live = F.col("_hit") & ~F.col("_total")
    failing = [
        (F.col(f"_n_{c}") == 0) | (F.col(f"_over_{c}") > 0) | (F.col(f"_ulo_{c}") != F.col(f"_uhi_{c}"))
        for c in columns
    ]
    fails = reduce(lambda a, b: a | b, failing, F.lit(False))
    outputs = F.count_if(live) * len(metrics)
    too_many = outputs > limit if limit is not None else F.lit(False)
    # a global aggregate over no matching row still has one (failing or zero) result
    empty = (F.count_if(live) == 0) if (not keys and columns) else F.lit(False)
    totals = groups.agg(
        F.coalesce(F.bool_or(live & fails) | too_many | empty, F.lit(False)).alias("u"),
        F.coalesce(F.sum("_bad"), F.lit(0)).alias("b"),
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("e"),
        F.coalesce(F.sum(F.when(F.col("_hit"), F.col("_rows"))), F.lit(0)).alias("m"),
    )
    status = _status(totals, F.col("u"), F.col("b"), F.col("e"), F.col("m"))
    picks = []
    for op, c in metrics:
        if op == "count":
            picks.append((F.col("_rows") - F.col("_bad")).alias("count"))
        else:
            picks.append(F.col(f"{op}_{c}"))
    units = [F.when(F.col(f"_ulo_{c}") != "", F.col(f"_ulo_{c}")).alias(f"unit_{c}") for c in columns]
    extra = [F.col("first_ord"), F.col("last_ord")] if order else []
    result = groups.where(live).select(*keys, *picks, *units, *extra)
    audit = df.where(hit)
    if keys:
        audit = audit.where(~F.coalesce(
            reduce(lambda a, b: a | b, [norm_key(F.col(k)).isin(*vocab.TOTAL_LABELS) for k in keys]), F.lit(False)))
    return Outcome(result, audit, status)


def metric_rows(outcome: Outcome, keys: list[str], metrics: list[tuple[str, str | None]]) -> DataFrame:
    """One row per (group, metric): label, value and unit, from the wide result of ``aggregate_by``."""
    cells = []
    for op, c in metrics:
        name = "count" if op == "count" else f"{op}_{c}"
        unit = F.lit(None).cast("string") if op == "count" else F.col(f"unit_{c}")
        cells.append(F.struct(F.lit(name).alias("metric"), F.col(name).cast("decimal(38,10)").alias("value"),
                              unit.alias("unit")))
    return outcome.result.select(*keys, F.inline(F.array(*cells)))


def extrema_rows(df: DataFrame, column: str, how: str = "maximum", by: list[str] | None = None) -> DataFrame:
    """All rows tied at the extremum of a number column, per group; ``is_single`` marks an unshared winner.

    The extremum is aggregated first (map-side combined) and joined back, so no group is ever sorted or held in
    one task.
    """
    by = by or []
    num = number_cell(F.col(column))["num"]
    numbered = df.withColumn("_num", num).where(F.col("_num").isNotNull())
    best = F.max if how == "maximum" else F.min
    if by:
        peaks = numbered.groupBy(*[F.col(k).alias(f"_k_{k}") for k in by], ).agg(best("_num").alias("_peak"))
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in by])
        hits = numbered.join(peaks, same & (F.col("_num") == F.col("_peak")))
        counts = hits.groupBy(*[F.col(k).alias(f"_c_{k}") for k in by]).agg(F.count(F.lit(1)).alias("_ties"))
        joined = hits.join(counts, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_c_{k}")) for k in by]))
        return joined.withColumn("is_single", F.col("_ties") == 1).drop(
            "_num", "_peak", "_ties", *[f"_k_{k}" for k in by], *[f"_c_{k}" for k in by])
    peak = numbered.agg(best("_num").alias("_peak"))
    hits = numbered.where(F.col("_num") == peak.scalar())
    return hits.withColumn("is_single", hits.agg(F.count(F.lit(1))).scalar() == 1).drop("_num")


def contributors(df: DataFrame, keys: list[str], order: str, where: list[Predicate] | None = None) -> DataFrame:
    """Per group: number of contributing rows with the first and the last one as representatives."""
    return where_typed(df, where or []).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("contributors"),
        F.min(order).alias("first_ord"),
        F.max(order).alias("last_ord"),
    )


def complete_check(df: DataFrame, column: str, preds: list[Predicate] | None = None,
                   malformed: Column | None = None) -> Outcome:
    """Do all rows satisfy the predicates (or, without any, have a value in ``column``)?

    "Not satisfied" includes null. A malformed row means the question cannot be decided: no verdict.
    """
    ok = all_of(preds) if preds else predicate((column, "not_null"))
    bad = F.coalesce(malformed, F.lit(False)) if malformed is not None else F.lit(False)
    flagged = df.withColumn("_ok", ok).withColumn("_bad", bad)
    tally = flagged.agg(
        F.count_if(~F.col("_bad")).alias("examined"),
        F.count_if(~F.col("_bad") & ~F.col("_ok")).alias("failures"),
        F.count_if("_bad").alias("malformed"),
    )
    status = _status(tally, F.lit(False), F.col("malformed"), F.col("examined"), F.col("examined") - F.col("failures"))
    verdict = tally.select((F.col("failures") == 0).alias("verdict"), "failures", "examined")
    return Outcome(verdict, flagged.where(~F.col("_bad") & ~F.col("_ok")).drop("_ok", "_bad"), status)


def result_limit(result: DataFrame, limit: int, per_row: int = 1) -> Outcome:
    """Refuse (never truncate) a result of more than ``limit`` outputs."""
    tally = result.agg((F.count(F.lit(1)) * per_row).alias("n"))
    status = _status(tally, F.col("n") > limit, F.lit(0), F.col("n"), F.col("n"))
    return Outcome(result, result, status)


def project_rows(df: DataFrame, identity: str, columns: list[str]) -> DataFrame:
    """One line of text per row, identity column first, blanks shown as ``null``."""
    ordered = [identity, *[c for c in columns if c != identity]]
    parts = [F.concat(F.lit(f"{c}: "), F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) == "", F.lit("null"))
                      .otherwise(F.col(c))) for c in ordered]
    return df.select("*", F.concat_ws("; ", *parts).alias("rendered"))


def project_cells(df: DataFrame, identity: str, columns: list[str]) -> DataFrame:
    """One output per (row, column)."""
    cells = [F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c), F.lit("null")).alias("value")) for c in columns]
    return df.select(F.col(identity).alias("identity"), F.inline(F.array(*cells)))


def rank_identity_columns(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """Columns by (distinct share + identifier share) of their non-null cells; position breaks ties.

    Exact distinct counts are taken over an unpivoted, partially aggregated (column, key) table, so one shuffle
    serves every column and no hot value is collected; ``approximate`` swaps in a sketch.
    """
    cells = df.select(F.posexplode(F.array(*[F.col(c) for c in columns])).alias("position", "value"))
    live = keyed_cells(cells, "value", "position").where(~F.col("null"))
    if approximate:
        stats = live.groupBy("position").agg(
            F.count(F.lit(1)).alias("n"), F.approx_count_distinct("key").alias("d"), F.sum("ident").alias("i"))
    else:
        stats = (live.groupBy("position", "key").agg(F.count(F.lit(1)).alias("n"), F.sum("ident").alias("i"))
                 .groupBy("position").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("d"), F.sum("i").alias("i")))
    names = F.array(*[F.lit(c) for c in columns])
    return stats.select(
        F.get(names, F.col("position")).alias("column"), F.col("position"),
        (F.col("d") / F.col("n") + F.col("i") / F.col("n")).alias("score"),
    ).orderBy(F.desc("score"), "position")


def row_label(columns: list[str], ordinal: Column) -> Column:
    """Human label of a row: its first identifier or text cell, else its number."""
    def pick(name: str) -> Column:
        return let(typed_cell(F.col(name)), lambda x: F.when(
            x["kind"].isin("identifier", "text"), F.concat(F.lit(f"{name} "), x["raw"])))

    return F.coalesce(*[pick(c) for c in columns], F.concat(F.lit("Row "), ordinal.cast("string")))


def lookup_cell(df: DataFrame, request_keys: list[str], column: str, asked: str | None = None, said: str | None = None) -> DataFrame:
    """One cell per request, only where exactly one row answers it; otherwise the request yields nothing.

    With ``asked`` (the request in words) and ``said`` (what the row and its source say), the row must also hold at least half of the request's
    content words, generic ones (``vocab.REQUEST_NOISE``) left aside.

    ``df`` holds candidate rows already joined to their requests. Counting and picking happen in one combine-able
    aggregate, so a request with very many candidate rows costs no more than its partial counts.
    """
    about, words = F.lit(True), []
    if asked is not None and said is not None:
        wanted = stop(F.array_distinct(search_words(F.coalesce(F.col("_hit.asked"), F.lit("")))), (*vocab.QUERY_STOP_WORDS, *vocab.REQUEST_NOISE))
        about = let(wanted, lambda w: 2 * covered(w, search_words(F.coalesce(F.col("_hit.said"), F.lit("")))) >= F.size(w))
        words = [F.col(asked).alias("asked"), F.col(said).alias("said")]
    # words are compared behind the aggregate, where one row is left of the few requests that have one answer
    found = df.groupBy(*request_keys).agg(
        F.count(F.lit(1)).alias("_rows"), F.max(F.struct(F.col(column).alias("value"), *words)).alias("_hit")).where("_rows = 1")
    return found.where(~is_null_cell(F.col("_hit.value")) & about).select(*request_keys, F.col("_hit.value").alias("value"))
