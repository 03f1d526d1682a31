"""Questions about headers and values: which columns match a phrase, which tables fit together, what is mentioned."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import vocab
from factloom.functions.text import key_words, norm_key, search_words, token_forms


def mention_join(texts: DataFrame, text_id: str, table: DataFrame, row_id: str, columns: list[str],
                 body: str = "text") -> DataFrame:
    """Which cell values of ``table`` occur in a text as whole words (two characters or more)?

    Values become key phrases, texts become word n-grams of just the lengths that occur among the phrases, and the
    two meet in an equi-join; a column-name mention that swallows the value does not count. The longest phrase length
    is read once (a single number) to know which n-grams to make.
    """
    cells = table.select(F.col(row_id), F.inline(F.array(*[
        F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("v")) for c in columns])))
    phrases = (cells.withColumn("phrase", norm_key(F.col("v"))).where(F.char_length("phrase") >= 2)
               .withColumn("n", F.size(F.split("phrase", " "))).select(row_id, "col", "phrase", "n"))
    lengths = phrases.groupBy("n").agg(F.count(F.lit(1)).alias("c"))
    sizes = lengths.agg(F.array_sort(F.collect_set("n")).alias("sizes"))  # distinct small integers
    grams = texts.select(text_id, key_words(F.col(body)).alias("w")).withColumn("sizes", sizes.scalar())
    grams = grams.select(text_id, "w", F.explode("sizes").alias("n")).where(F.col("n") <= F.size("w"))
    spans = grams.select(text_id, "n", F.explode(F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.size("w") - F.col("n") + 1),
        lambda i: F.array_join(F.slice(F.col("w"), i, F.col("n")), " ")))).alias("phrase"))
    return spans.join(phrases, ["phrase", "n"]).select(text_id, row_id, "col", "phrase").distinct()


def column_scores(headers: DataFrame, phrases: DataFrame) -> DataFrame:
    """Score of a header against a phrase, for the pairs that share at least one word form.

    Whole header inside the phrase: 8 plus its words; an ``... id`` header whose entity word is mentioned: 12; all
    meaningful words mentioned: their number. Candidates come from an equi-join on word forms, so headers and
    phrases with nothing in common never meet.
    """
    h = headers.select("header").distinct().withColumn("ht", key_words(F.col("header"))).withColumn(
        "hkey", norm_key(F.col("header")))
    p = phrases.select("phrase").distinct().withColumn("pt", key_words(F.col("phrase"))).withColumn(
        "pkey", norm_key(F.col("phrase")))
    h_forms = h.select("header", "ht", "hkey", F.posexplode("ht").alias("i", "tok")).select(
        "header", "ht", "hkey", "i", F.explode(token_forms(F.col("tok"))).alias("form"))
    p_forms = p.select("phrase", "pkey", F.explode(F.array_distinct("pt")).alias("tok")).select(
        "phrase", "pkey", F.explode(token_forms(F.col("tok"))).alias("form")).distinct()
    met = h_forms.join(p_forms, "form").groupBy("header", "phrase").agg(
        F.first("ht").alias("ht"), F.first("hkey").alias("hkey"), F.first("pkey").alias("pkey"),
        F.collect_set("i").alias("hit"))  # positions of one header: bounded by its words
    meaning = F.filter(F.transform("ht", lambda t, i: F.struct(t.alias("t"), i.alias("i"))),
                       lambda s: ~s["t"].isin(*vocab.COLUMN_STOP_WORDS))
    inside = F.concat(F.lit(" "), F.col("pkey"), F.lit(" ")).contains(F.concat(F.lit(" "), F.col("hkey"), F.lit(" ")))
    score = (
        F.when(inside, F.size("ht") + 8)
        .when((F.size("ht") >= 2) & F.element_at("ht", -1).isin("id", "identifier") & F.array_contains("hit", 0), 12)
        .when((F.size(meaning) > 0) & F.forall(meaning, lambda s: F.array_contains(F.col("hit"), s["i"])), F.size(meaning))
        .otherwise(0)
    )
    return met.select("header", "phrase", score.cast("long").alias("score")).where("score > 0")


def match_tables(headers: DataFrame, phrases: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Score of each table against each phrase: the sum of its column scores, plus 4 per label found in the phrase."""
    per_column = column_scores(headers, phrases).join(headers, "header").select("table_id", "phrase", "score")
    if labels is not None:
        hits = mention_join(phrases.select("phrase", F.col("phrase").alias("text")), "phrase",
                            labels.withColumn("label_row", F.monotonically_increasing_id()), "label_row", ["label"])
        hits = hits.join(labels.withColumn("phrase2", norm_key(F.col("label"))), F.col("phrase2") == hits["phrase"])
        per_column = per_column.unionByName(hits.select("table_id", "phrase", F.lit(4).cast("long").alias("score")))
    return per_column.groupBy("table_id", "phrase").agg(F.sum("score").alias("score"))


def compatible_tables(headers: DataFrame) -> DataFrame:
    """Per table a hash of its ordered header keys and how many tables share it. Headers per table are few."""
    keyed = headers.withColumn("k", norm_key(F.col("header")))
    per = keyed.groupBy("table_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("position", "header", "k"))), lambda s: s["k"]), "|").alias("hk"))
    per = per.select("table_id", F.sha2("hk", 256).alias("header_hash"))
    sizes = per.groupBy("header_hash").agg(F.count(F.lit(1)).alias("compatible"))
    return per.join(sizes, "header_hash")


def tables_to_union(scored: DataFrame, headers: DataFrame, request: list[str], slack: int = 1) -> DataFrame:
    """For each request the table with the highest score (of equals the one with the smallest id) and every other whose score is at most ``slack`` lower
    and whose ordered header keys are the same: ``request, table_id, score``."""
    j = scored.join(compatible_tables(headers).select("table_id", "header_hash"), "table_id")
    tops = j.groupBy(*request).agg(F.max("score").alias("_top"))
    lead = j.join(tops, request).where("score = _top").groupBy(*request, "_top").agg(F.min_by("header_hash", "table_id").alias("_hash"))
    near = j.join(lead, request).where((F.col("header_hash") == F.col("_hash")) & (F.col("score") >= F.col("_top") - slack))
    return near.select(*request, "table_id", "score")


def union_tables(tables: list[DataFrame]) -> DataFrame:
    """Union by position of tables whose normalised headers agree in order; others are refused."""
    first = [" ".join(c.replace("_", " ").casefold().split()) for c in tables[0].columns]
    for other in tables[1:]:
        if [" ".join(c.replace("_", " ").casefold().split()) for c in other.columns] != first:
            raise ValueError(f"headers differ: {tables[0].columns} and {other.columns}")
    return reduce(lambda a, b: a.union(b), tables)


def duplicate_headers(headers: DataFrame) -> DataFrame:
    """Tables in which two headers normalise to the same key."""
    return (headers.select("table_id", norm_key(F.col("header")).alias("header_key"))
            .groupBy("table_id", "header_key").agg(F.count(F.lit(1)).alias("n_headers")).where("n_headers > 1"))


#: Tokens of a question that one number holds as bits.
BITS = 64


def distinct_matches(found: DataFrame, queries: DataFrame, query: str, keys: list[str], form: str, forms: Callable[[Column], Column], tokens: str, name: str) -> DataFrame:
    """Per question and ``keys`` the number of distinct tokens with one of their forms in ``found``, for pairs that share any.

    A token is a bit by its place among the question's, and bits are combined before the shuffle, so no set of tokens is kept. A question of more tokens than a
    number has bits takes several numbers; how many the longest takes is asked first.
    """
    own = queries.groupBy(query).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(tokens)))).alias("toks"))
    numbers = (own.agg(F.max(F.size("toks"))).first()[0] or 1) // BITS + 1
    asked = own.select(query, F.posexplode("toks").alias("place", "tok"))
    asked = asked.select(query, F.floor(F.col("place") / BITS).alias("_number"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place") % BITS).alias("_bit"),
                         F.explode(forms(F.col("tok"))).alias(form))
    hits = found.join(asked, form).groupBy(query, *keys)
    held = [F.coalesce(F.bit_count(F.bit_or(F.when(F.col("_number") == i, F.col("_bit")))), F.lit(0)) for i in range(numbers)]
    return hits.agg(reduce(lambda a, b: a + b, held).cast("long").alias(name))


def token_coverage(texts: DataFrame, text_id: str, queries: DataFrame, query_id: str, body: str = "text",
                   tokens: str = "tokens") -> DataFrame:
    """Number of query tokens with an equivalent token in the text, for pairs that share at least one."""
    t = texts.select(text_id, F.explode(F.array_distinct(F.flatten(F.transform(
        F.array_distinct(search_words(F.col(body))), token_forms)))).alias("form"))
    return distinct_matches(t, queries, query_id, [text_id], "form", token_forms, tokens, "coverage")
