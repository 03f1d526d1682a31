"""Sorting of mixed-kind columns and top-k selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import norm_key
from factloom.functions.typing import typed_cell


def sort_columns(column: str, direction: str = "asc") -> list[Column]:
    """Sort keys of one mixed column (typed as ``_t_<column>``): nulls last in both directions, each kind by its own order.

    Kinds that cannot be compared have no order between them; they are kept apart (numbers, dates, booleans, words)
    so that the result is a total, repeatable order.
    """
    t = F.col(f"_t_{column}")
    rank = (
        F.when(t["kind"] == "null", 9).when(t["kind"] == "number", 1).when(t["kind"] == "date", 2)
        .when(t["kind"] == "boolean", 3).otherwise(4)
    )
    word = F.when(t["kind"].isin("identifier", "text"), norm_key(t["raw"]))
    pieces = [t["num"], t["dt"], t["bool"], word]
    turn = (lambda c: c.desc_nulls_last()) if direction == "desc" else (lambda c: c.asc_nulls_last())
    return [rank.asc(), *[turn(p) for p in pieces]]


def sort_typed(df: DataFrame, order: list[tuple[str, str]], tiebreak: str) -> DataFrame:
    keys = [k for column, direction in order for k in sort_columns(column, direction)]
    return _typed(df, order).orderBy(*keys, F.col(tiebreak)).select(*df.columns)


def _typed(df: DataFrame, order: list[tuple[str, str]]) -> DataFrame:
    return df.withColumns({f"_t_{c}": typed_cell(F.col(c)) for c, _ in order})


def rank_typed(df: DataFrame, order: list[tuple[str, str]], tiebreak: str, partition: list[str],
               name: str = "position") -> DataFrame:
    """Position of a row in that order inside its partition."""
    keys = [k for column, direction in order for k in sort_columns(column, direction)]
    w = Window.partitionBy(*partition).orderBy(*keys, F.col(tiebreak))
    return _typed(df, order).withColumn(name, F.row_number().over(w)).select(*df.columns, name)


def sort_groups(result: DataFrame, group_columns: list[tuple[str, str]], among: list[str]) -> DataFrame:
    """Grouped output ordered by typed group columns; ordering by anything else is refused."""
    outside = [c for c, _ in group_columns if c not in among]
    if outside:
        raise ValueError(f"only group columns can order groups, not {outside}")
    keys = [k for column, direction in group_columns for k in sort_columns(column, direction)]
    return _typed(result, group_columns).orderBy(*keys, *[F.lower(F.col(c)) for c in among]).select(*result.columns)


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """Global top k by the given order (planned as take-ordered, no full sort)."""
    return df.orderBy(*order).limit(k)


def top_k_per(df: DataFrame, partition: list[str], k: int, *order: Column, name: str = "rank") -> DataFrame:
    """Top k per partition; rows beyond k are dropped map-side by the window group limit before the shuffle."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def top_k_per_source(df: DataFrame, query: list[str], source: str, rank: Column, per: int,
                     total: int) -> DataFrame:
    """At most ``per`` rows of a source and ``total`` rows of a query, best ranks first."""
    capped = top_k_per(df, [*query, source], per, rank, name="_in_source")
    return top_k_per(capped, query, total, rank, name="position").drop("_in_source")


def latest_n(messages: DataFrame, partition: list[str], ordinal: str, n: int, payload: list[str]) -> DataFrame:
    """Newest ``n`` rows per partition, handed back oldest first as one nested array (n is small by contract)."""
    if not 1 <= n <= 20:
        raise ValueError("n must be between 1 and 20")
    newest = top_k_per(messages, partition, n, F.desc(ordinal), name="_age")
    return newest.groupBy(*partition).agg(
        F.array_sort(F.collect_list(F.struct(ordinal, *payload))).alias("messages"))


def latest_answers(answers: DataFrame, claims: DataFrame, citations: DataFrame, partition: list[str], age: list[str], n: int, answer: str = "answer_id") -> DataFrame:
    """Newest ``n`` answers per partition (by the columns ``age``, the last of which sets ties apart), each with its claims and their citations nested in
    order. ``position`` 1 is the oldest of them.

    ``claims`` has ``answer`` and ``ordinal`` (once in an answer), ``citations`` has ``answer``, ``claim_ordinal`` and ``ordinal``; their further columns are carried along.
    The answers are chosen first, so that claims and citations of older ones are dropped before anything is put together.
    """
    if not 1 <= n <= 20:
        raise ValueError("n must be between 1 and 20")
    newest = top_k_per(answers, partition, n, *[F.desc(c) for c in age], name="_age")
    wanted = newest.select(answer)
    carried = [c for c in citations.columns if c not in (answer, "claim_ordinal", "ordinal")]
    cited = citations.join(wanted, answer, "left_semi").groupBy(answer, F.col("claim_ordinal").alias("ordinal")).agg(
        F.array_sort(F.collect_list(F.struct("ordinal", *carried))).alias("citations"))
    said = [c for c in claims.columns if c not in (answer, "ordinal")]
    none = F.array().cast(cited.schema["citations"].dataType)
    whole = claims.join(wanted, answer, "left_semi").join(cited, [answer, "ordinal"], "left").groupBy(answer).agg(
        F.array_sort(F.collect_list(F.struct("ordinal", *said, F.coalesce("citations", none).alias("citations")))).alias("claims"))
    empty = F.array().cast(whole.schema["claims"].dataType)
    out = newest.join(whole, answer, "left").withColumn("claims", F.coalesce("claims", empty))
    oldest_first = Window.partitionBy(*partition).orderBy(F.desc("_age"))
    return out.withColumn("position", F.row_number().over(oldest_first)).drop("_age")


def next_ordinals(new: DataFrame, existing: DataFrame, partition: list[str], ordinal: str, *order: Column) -> DataFrame:
    """Number new rows per partition, continuing after the highest existing ordinal."""
    tops = existing.groupBy(*partition).agg(F.max(ordinal).alias("_top"))
    w = Window.partitionBy(*partition).orderBy(*order)
    numbered = new.withColumn("_n", F.row_number().over(w))
    joined = numbered.join(tops, partition, "left")
    return joined.withColumn("ordinal", F.coalesce(F.col("_top"), F.lit(0)) + F.col("_n")).drop("_top", "_n")
