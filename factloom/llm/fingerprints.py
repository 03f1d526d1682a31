"""Document fingerprints: bottom-k sketches of word shingles, in DataFrame functions only.

A sketch is the sorted array of the ``k`` smallest distinct 64-bit hashes of a text's shingles. The sketch of a union is the bottom k of the
sketches' union, so parts of a document or a corpus are sketched apart and merged. Fewer than ``k`` hashes make the sketch the whole set, and
every estimate exact.

Defined results: a null text counts as empty; a text without words has an empty sketch; fewer words than a shingle make one shingle of them
all. Two empty sketches are alike (1.0), an empty one and another are not (0.0). Rows with a null id stand after all others; rows that share an
id follow each other by their text, and their successor is the row after them.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from factloom.llm.registry import query, table

SHINGLE = 5
SKETCH = 128
_BLANK = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """Words of a text without regard to case; none for a null or blank text."""
    bare = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(_BLANK))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def shingle_hashes(tokens: Column, width: int = SHINGLE) -> Column:
    """Distinct hashes of the shingles; ``tokens`` should be a plain column, as it is read for every shingle. Absent words are left out of a hash."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(tokens) - width, F.lit(0)))
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(tokens, i + k) for k in range(width)]))
    return F.when(F.size(tokens) > 0, F.array_distinct(hashes)).otherwise(F.array().cast("array<bigint>"))


def bottom(hashes: Column, k: int = SKETCH) -> Column:
    return F.slice(F.sort_array(hashes), 1, k)


def merged(a: Column, b: Column, k: int = SKETCH) -> Column:
    """Sketch of the union of what two sketches stand for."""
    return bottom(F.array_union(a, b), k)


def resemblance(a: Column, b: Column, k: int = SKETCH) -> Column:
    """Estimated share of common shingles in the union."""
    union = merged(a, b, k)
    return F.when(F.size(union) == 0, 1.0).otherwise(F.size(F.array_intersect(F.array_intersect(a, b), union)) / F.size(union))


def distinct_count(a: Column, k: int = SKETCH) -> Column:
    """Estimated number of distinct shingles: exact below ``k``, else from how low the k-th hash lies."""
    share = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = SKETCH) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` has too; 1.0 if ``a`` has none."""
    union = distinct_count(merged(a, b, k), k)
    common = resemblance(a, b, k) * union
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), common / distinct_count(a, k)))


def as_text(sketch: Column) -> Column:
    """16 hexadecimal digits for each hash."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def fingerprinted(df: DataFrame, text: str = "text", out: str = "sketch", width: int = SHINGLE, k: int = SKETCH) -> DataFrame:
    """All rows and columns, with the sketch of the text as column ``out``."""
    tokens = f"{out}__tokens"
    with_words = df.withColumn(tokens, words(F.col(text)))
    return with_words.withColumn(out, bottom(shingle_hashes(F.col(tokens), width), k)).drop(tokens)


def merged_by(df: DataFrame, keys: list[str], sketch: str = "sketch", k: int = SKETCH) -> DataFrame:
    """One sketch for each key. Every task passes on at most ``k`` hashes of a key, so a key with most of the rows needs no large group."""
    hashes = df.select(*keys, F.explode_outer(sketch).alias("__hash")).distinct()
    by_key = Window.partitionBy(*keys).orderBy(F.col("__hash").asc_nulls_last())
    low = hashes.withColumn("__n", F.row_number().over(by_key)).where(F.col("__n") <= k)
    return low.groupBy(*keys).agg(F.sort_array(F.collect_list("__hash")).alias(sketch))


def _constant(values: list, kind: str) -> Column:
    """A constant array, folded once while the query is planned."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def with_next_text(df: DataFrame, key: str, text: str, ranges: int | None = None) -> tuple[DataFrame, WindowSpec]:
    """Rows dealt out into ranges of descending ``key`` (a whole number), and the window in which ``lead`` gives a row's successor; the last row
    is followed by the first.

    Each range holds a copy (``__ghost``) of the first row of the range after it, so no range depends on another and nothing is ordered in one
    task. The bounds and the first key of each range are all that comes to the driver: two numbers for each range.
    """
    wanted = ranges or 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / wanted for i in range(1, wanted)] or [0.5]
    bounds = sorted(set(df.agg(F.percentile_approx(key, shares, max(10_000, 10 * wanted)).alias("b")).first()["b"] or []))
    step = max(1, math.isqrt(len(bounds)))
    blocks = _constant([bounds[i:i + step] for i in range(0, len(bounds), step)] or [[]], "array<array<bigint>>")
    value = F.col(key)

    def below(array: Column) -> Column:
        return F.size(F.filter(array, lambda b: b < value))

    # a key's range is the number of bounds below it: whole blocks first, then the rest inside one block; null keys come last of all, in range -1
    dealt = df.withColumn("__block", below(_constant(bounds[step - 1::step], "array<bigint>"))).withColumn(
        "__range", F.when(value.isNull(), -1).otherwise(
            F.col("__block") * step + F.coalesce(below(F.get(blocks, F.col("__block"))), F.lit(0)))).drop("__block")
    firsts = {r[0]: r[1] for r in dealt.groupBy("__range").agg(F.max(key)).collect()}
    order = sorted(firsts, reverse=True)
    before = {r: order[i - 1] for i, r in enumerate(order)}
    numbers = range(-1, max(order, default=-1) + 1)
    at = F.col("__range") + 1
    is_first = F.get(_constant([firsts.get(r) for r in numbers], "array<bigint>"), at).eqNullSafe(value)
    home = F.struct(F.col("__range").alias("r"), F.lit(False).alias("ghost"))
    away = F.struct(F.get(_constant([before.get(r) for r in numbers], "array<int>"), at).alias("r"), F.lit(True).alias("ghost"))
    rows = dealt.withColumn("__place", F.explode(F.when(is_first, F.array(home, away)).otherwise(F.array(home))))
    rows = rows.withColumns({"__range": F.col("__place.r"), "__ghost": F.col("__place.ghost")}).drop("__place")
    return rows, Window.partitionBy("__range").orderBy("__ghost", F.col(key).desc_nulls_last(), F.col(text).asc_nulls_first())


def edit_report(docs: DataFrame, width: int = SHINGLE, k: int = SKETCH, ranges: int | None = None) -> DataFrame:
    """One row for each document: its sketch, the sketch of its text with the last half replaced by the start of the next document, the likeness
    of both, and its likeness to the next document. Texts are dealt out once."""
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows, window = with_next_text(plain, "doc_id", "text", ranges)
    rows = rows.withColumns({"next_text": F.lead("text").over(window), "n_chars": F.char_length("text").cast("bigint")})
    edited = F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 2 as int)), substring(coalesce(next_text, ''), 1, cast(n_chars div 2 as int)))")
    rows = fingerprinted(rows.withColumn("edited", edited).drop("next_text"), "text", "own", width, k)
    rows = fingerprinted(rows.withColumn("edited_sha256", F.sha2("edited", 256)), "edited", "changed", width, k).drop("edited")
    rows = rows.withColumn("next_own", F.lead("own").over(window)).where(~F.col("__ghost"))
    return rows.select("doc_id", "n_chars", "edited_sha256", "own", "changed", resemblance(F.col("own"), F.col("changed"), k).alias("near_edited"),
                       resemblance(F.col("own"), F.col("next_own"), k).alias("near_next"), distinct_count(F.col("own"), k).alias("n_shingles"))


@query("op1_document_fingerprints")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's fingerprint against its edited text and its neighbour."""
    report = edit_report(table(spark, folder, "documents"))
    return report.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"),
                         as_text(F.col("changed")).alias("edited_fingerprint"), "near_edited", "near_next", "n_shingles")
