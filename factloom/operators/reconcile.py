"""Key reconciliation between two tables: full outer, universal, lookup, key and measure inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import key_words, token_forms
from factloom.functions.typing import is_number_cell, keyed_cells, number_cell
from factloom.operators.relational import Outcome, _status


def _side(df: DataFrame, key: str, prefix: str, measure: str | None = None) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias(f"n_{prefix}")]
    df = df.select(F.coalesce(F.col(key), F.lit("")).alias("key"),
                   *([number_cell(F.col(measure)).alias("_t")] if measure else []))
    if measure:
        t = F.col("_t")
        number = t["kind"] == "number"
        unit = F.when(number, F.coalesce(t["unit"], F.lit("")))
        aggs += [F.sum(F.when(number, t["num"])).alias(f"sum_{prefix}"),
                 F.count_if(number & t["num"].isNull()).alias(f"over_{prefix}"),
                 F.min(unit).alias(f"ulo_{prefix}"), F.max(unit).alias(f"uhi_{prefix}")]
    return df.groupBy("key").agg(*aggs)


def reconcile(left: DataFrame, right: DataFrame, left_key: str, right_key: str | None = None) -> DataFrame:
    """Full outer match on the raw key text: case counts, and a blank is a key that matches blanks.

    Both sides are reduced to one row per key before they meet, so a key with a third of all rows arrives as one
    number and the join never multiplies rows.
    """
    pair = _side(left, left_key, "left").join(_side(right, right_key or left_key, "right"), "key", "full_outer")
    n_left, n_right = F.coalesce("n_left", F.lit(0)), F.coalesce("n_right", F.lit(0))
    return pair.select(
        "key", n_left.alias("n_left"), n_right.alias("n_right"),
        F.when(n_right == 0, "left_only").when(n_left == 0, "right_only").otherwise("matched").alias("side"),
        F.concat_ws(":", n_left.cast("string"), n_right.cast("string")).alias("cardinality"),
    )


def reconcile_audit(reconciled: DataFrame) -> DataFrame:
    """One row: rows, matched and unmatched keys, duplicate-key groups counted on each side."""
    return reconciled.agg(
        F.coalesce(F.sum("n_left"), F.lit(0)).alias("left_rows"),
        F.coalesce(F.sum("n_right"), F.lit(0)).alias("right_rows"),
        F.count_if(F.col("side") == "matched").alias("matched_keys"),
        F.count_if(F.col("side") == "left_only").alias("unmatched_left"),
        F.count_if(F.col("side") == "right_only").alias("unmatched_right"),
        (F.count_if(F.col("n_left") > 1) + F.count_if(F.col("n_right") > 1)).alias("duplicate_key_groups"),
    )


def reconcile_measures(left: DataFrame, right: DataFrame, key: tuple[str, str],
                       measure: tuple[str, str]) -> Outcome:
    """Per matched key the two sums and their difference; a side without a number or mixed units refuses all."""
    pair = _side(left, key[0], "left", measure[0]).join(
        _side(right, key[1], "right", measure[1]), "key", "inner")
    unusable = (
        F.col("sum_left").isNull() | F.col("sum_right").isNull()
        | (F.col("over_left") > 0) | (F.col("over_right") > 0)
        | (F.col("ulo_left") != F.col("uhi_left")) | (F.col("ulo_right") != F.col("uhi_right"))
        | (F.col("ulo_left") != F.col("ulo_right"))
    )
    result = pair.select(
        "key", "n_left", "n_right", "sum_left", "sum_right",
        (F.col("sum_left") - F.col("sum_right")).alias("difference"),
        F.when(F.col("ulo_left") != "", F.col("ulo_left")).alias("unit"))
    tally = pair.agg(F.coalesce(F.bool_or(unusable), F.lit(False)).alias("u"),
                     F.coalesce(F.sum(F.col("n_left") + F.col("n_right")), F.lit(0)).alias("e"),
                     F.count(F.lit(1)).alias("m"))
    return Outcome(result, pair, _status(tally, F.col("u"), F.lit(0), F.col("e"), F.col("m")))


def unmatched(left: DataFrame, right: DataFrame, left_key: str, right_key: str | None = None) -> DataFrame:
    """Keys found on one side only, with that side. Both sides go into one grouping, so a task holds each of its keys once and joins nothing."""
    both = left.select(F.coalesce(F.col(left_key), F.lit("")).alias("key"), F.lit(1).alias("_side")).unionByName(
        right.select(F.coalesce(F.col(right_key or left_key), F.lit("")).alias("key"), F.lit(2).alias("_side")))
    sides = both.groupBy("key").agg(F.bit_or("_side").alias("_sides"))
    return sides.where("_sides < 3").select("key", F.when(F.col("_sides") == 1, "left").otherwise("right").alias("side"))


def all_matched(left: DataFrame, right: DataFrame, left_key: str, right_key: str | None = None) -> DataFrame:
    """Is every left key present on the right? Right-only keys are reported but do not fail the answer."""
    return unmatched(left, right, left_key, right_key).agg(
        (F.count_if(F.col("side") == "left") == 0).alias("verdict"),
        F.count_if(F.col("side") == "left").alias("missing_left_keys"),
        F.count_if(F.col("side") == "right").alias("right_only_keys"),
    )


def lookup_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, columns: list[str]) -> Outcome:
    """Left outer lookup, one output per left row, refused when a key in use has several right rows.

    The right side is reduced to one row per key (any row, plus the count) before the join, so duplicates
    cannot multiply the left side; unused duplicates do no harm.
    """
    one = right.groupBy(F.coalesce(F.col(right_key), F.lit("")).alias("_key")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min(F.struct(*[F.col(c) for c in columns])).alias("_hit"))
    joined = left.withColumn("_key", F.coalesce(F.col(left_key), F.lit(""))).join(one, "_key", "left")
    result = joined.select(
        *left.columns, *[F.col(f"_hit.{c}").alias(c) for c in columns],
        F.when(F.col("_n").isNull(), "unmatched").otherwise("matched").alias("lookup"))
    tally = joined.agg(F.coalesce(F.max("_n") > 1, F.lit(False)).alias("u"),
                       F.count(F.lit(1)).alias("e"), F.count("_n").alias("m"))
    return Outcome(result, joined.where("_n > 1").select(*left.columns),
                   _status(tally, F.col("u"), F.lit(0), F.col("e"), F.col("m")))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def headers_equivalent(left: list[str], right: list[str], spark) -> DataFrame:
    """Column pairs whose names have equally many tokens, pairwise equivalent. Works on names only."""
    l = spark.createDataFrame([(i, h) for i, h in enumerate(left)], "l_pos int, l_name string")
    r = spark.createDataFrame([(i, h) for i, h in enumerate(right)], "r_pos int, r_name string")
    l = l.withColumn("lt", key_words(F.col("l_name"))).withColumn("n", F.size("lt"))
    r = r.withColumn("rt", key_words(F.col("r_name"))).withColumn("n", F.size("rt"))
    same = F.forall(F.zip_with("lt", "rt", lambda a, b: F.arrays_overlap(token_forms(a), token_forms(b))), lambda x: x)
    return l.join(r, "n").where(same & (F.col("n") > 0)).select("l_pos", "l_name", "r_pos", "r_name")


def infer_join_key(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """The pair of columns that best connects two tables, or no row when none overlaps or the best is tied.

    Every column is unpivoted to distinct cells, and these to distinct (pair, normalised value); overlap and union come
    from one grouped pass over both sides, never from comparing rows with rows.
    """
    def cells(df: DataFrame, side: int) -> DataFrame:
        return df.select(F.posexplode(F.array(*[F.col(p[side]).cast("string") for p in pairs])).alias("pair", "v")).withColumn("side", F.lit(side))

    # equal cells are typed once
    sides = [F.max(F.when(F.col("side") == i, 1).otherwise(0)).alias(name) for i, name in enumerate(("in_l", "in_r"))]
    raw = cells(left, 0).unionByName(cells(right, 1)).groupBy("pair", "v").agg(*sides, F.count(F.lit(1)).alias("cells"))
    typed = keyed_cells(raw, "v", "pair", "in_l", "in_r", "cells").withColumn("value", F.when(~F.col("null"), F.col("key")))
    per_value = typed.groupBy("pair", "value").agg(
        F.max("in_l").alias("in_l"), F.max("in_r").alias("in_r"), F.sum(F.col("ident") * F.col("cells")).alias("ident"), F.sum("cells").alias("cells"))
    live = F.col("value").isNotNull()
    both_sides = live & (F.col("in_l") == 1) & (F.col("in_r") == 1)
    stats = per_value.groupBy("pair").agg(
        F.count_if(both_sides).alias("overlap"),
        F.count_if(live & (F.col("in_l") == 1)).alias("nl"),
        F.count_if(live & (F.col("in_r") == 1)).alias("nr"),
        F.count_if(live).alias("nu"),
        F.sum("ident").alias("ident"), F.sum("cells").alias("cells"))
    scored = stats.where("overlap > 0").select(
        "pair", F.struct(
            F.col("overlap").alias("overlap"),
            F.least(F.col("overlap") / F.col("nl"), F.col("overlap") / F.col("nr")).alias("coverage"),
            (F.col("overlap") / F.col("nu")).alias("jaccard"),
            (F.col("ident") / F.col("cells")).alias("identifier_ratio")).alias("score"))
    # one row per pair of columns is left, so they are ranked in one array and both tables are read once
    ranked = scored.agg(F.sort_array(F.collect_list(F.struct("score", "pair")), asc=False).alias("_r"))
    first = F.get("_r", F.lit(0))
    winners = ranked.where(F.size(F.filter("_r", lambda x: x["score"] == first["score"])) == 1).select(first["pair"].alias("pair"), first["score"].alias("score"))
    lefts = F.array(*[F.lit(p[0]) for p in pairs])
    rights = F.array(*[F.lit(p[1]) for p in pairs])
    return winners.select(
        F.get(lefts, F.col("pair")).alias("left_key"), F.get(rights, F.col("pair")).alias("right_key"), "score.*")


def numeric_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Which columns hold at least one number cell, in one pass."""
    cells = df.select(*[is_number_cell(F.col(c).cast("string")).alias(c) for c in columns])
    flags = cells.agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in columns])
    return flags.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(i).alias("position"), F.col(c).alias("numeric"))
        for i, c in enumerate(columns)])))


def infer_measures(left: DataFrame, right: DataFrame, common: list[tuple[str, str]],
                   mentioned: tuple[list[str], list[str]] = ((), ())) -> DataFrame:
    """The measure pair: the one mentioned numeric column of each side, else the only common numeric pair."""
    ln = numeric_columns(left, left.columns).where("numeric")
    rn = numeric_columns(right, right.columns).where("numeric")
    by_name = (
        ln.where(F.col("column").isin(*mentioned[0])) if mentioned[0] else ln.limit(0)
    ).agg(F.count(F.lit(1)).alias("nl"), F.min("column").alias("left_measure"), F.lit(1).alias("k")).join(
        (rn.where(F.col("column").isin(*mentioned[1])) if mentioned[1] else rn.limit(0)).agg(
            F.count(F.lit(1)).alias("nr"), F.min("column").alias("right_measure"), F.lit(1).alias("k")), "k")
    named = by_name.where("nl = 1 AND nr = 1").select("left_measure", "right_measure", F.lit(1).alias("choice"))
    spark = left.sparkSession
    names = spark.createDataFrame(common, "l string, r string")
    shared = names.join(ln.select(F.col("column").alias("l")), "l").join(rn.select(F.col("column").alias("r")), "r")
    one = shared.agg(F.count(F.lit(1)).alias("n"), F.min("l").alias("left_measure"), F.min("r").alias("right_measure"))
    lone = one.where("n = 1").select("left_measure", "right_measure", F.lit(2).alias("choice"))
    w = Window.orderBy("choice")  # at most two rows exist here
    return named.unionByName(lone).withColumn("rn", F.row_number().over(w)).where("rn = 1").select(
        "left_measure", "right_measure")


def blocks_with_files(blocks: DataFrame, files: DataFrame) -> DataFrame:
    """Blocks of ready files; the run is part of the key on both sides, so runs never see each other's text."""
    return blocks.join(files.where(F.col("status") == "ready"), ["run_id", "file_id"])


def latest_per(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Newest whole row per key by one combine-able aggregate."""
    rest = [c for c in df.columns if c not in key]
    newest = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return newest.select(*key, "_row.*")
