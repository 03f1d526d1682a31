"""Tagging a log of questions with what they ask for: word and phrase sets over each question's tokens, no parser and no planner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import words

#: For each intent the words that show it, and the phrases of two words.
ASKED: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "aggregate": (("average", "count", "counts", "highest", "largest", "lowest", "maximum", "mean", "minimum", "smallest", "sum", "total", "totals"),
                  ("how many", "how much", "number of")),
    "compare": (("compare", "compared", "comparison", "conflict", "conflicting", "conflicts", "contradict", "differ", "difference", "differences", "versus", "vs"), ()),
    "completeness": (("complete", "completeness"), ("are all", "did all", "do all", "does every", "has every", "have all", "is every")),
    "exceptions": (("anomalies", "anomaly", "duplicate", "duplicates", "exception", "exceptions", "missing", "outlier", "outliers", "unmatched", "violation", "violations"), ()),
    "filter": (("above", "after", "before", "below", "except", "excluding", "exceeding", "exceeds", "where", "without"),
               ("at least", "at most", "greater than", "less than", "more than")),
    "group": (("breakdown", "grouped", "per"), ("break down", "for each", "group by")),
    "join": (("against", "join", "joined", "link", "match", "reconcile", "unmatched"), ()),
    "list": (("all", "each", "enumerate", "every", "list", "lists"), ()),
    "order": (("ascending", "chronological", "descending", "ordered", "sort", "sorted"), ("order by",)),
    "summary": (("overview", "summarise", "summarize", "summary"), ()),
}
#: Words for a set of data as a whole.
DATA_SETS = ("data", "dataset", "datasets", "file", "files", "record", "records", "row", "rows", "source", "sources", "table", "tables")
#: Intents that only all of the data can answer; the others need it if they speak of a set of data.
SET_WIDE = ("aggregate", "completeness", "filter", "group", "join", "list", "order")
#: Intents that rows and columns answer rather than text.
TABULAR = ("aggregate", "completeness", "exceptions", "filter", "group", "order", "summary")


def _says(tokens: Column, line: Column, single: tuple[str, ...], double: tuple[str, ...]) -> Column:
    found = F.arrays_overlap(tokens, F.array(*map(F.lit, single)))
    for phrase in double:
        found = found | line.contains(f" {phrase} ")
    return found


def tag_questions(log: DataFrame, question: str) -> DataFrame:
    """Adds ``intents`` (sorted array; ``lookup`` if there is no other), ``mode`` and ``needs_complete_data`` to every question. A null or empty question
    is a lookup."""
    tokens, line = F.col("_tokens"), F.col("_line")
    read = log.withColumn("_tokens", words(F.coalesce(F.col(question), F.lit("")))).withColumn("_line", F.concat(F.lit(" "), F.array_join("_tokens", " "), F.lit(" ")))
    flagged = read.withColumns({f"_{i}": _says(tokens, line, *said) for i, said in ASKED.items()} | {"_data": _says(tokens, line, DATA_SETS, ())})

    def any_of(names: tuple[str, ...]) -> Column:
        return F.greatest(*[F.col(f"_{n}") for n in names])

    intents = F.array_compact(F.array(*[F.when(F.col(f"_{i}"), F.lit(i)) for i in ASKED]))
    whole = any_of(SET_WIDE) | (F.col("_data") & any_of(("exceptions", "summary")))
    mode = (F.when(any_of(("compare", "join")), "mixed").when(whole & any_of(TABULAR), "structured").when(F.col("_list"), "exhaustive").otherwise("direct"))
    return flagged.withColumns({"intents": F.when(F.size(intents) == 0, F.array(F.lit("lookup"))).otherwise(intents), "mode": mode,
                                "needs_complete_data": whole}).select(*log.columns, "intents", "mode", "needs_complete_data")
