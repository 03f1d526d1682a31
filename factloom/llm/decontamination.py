"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A seed is a fixed mask over neighbouring tokens; only the positions marked 1 are hashed, so a seed still hits where tokens at the other positions were
replaced. All windows of test items and of training texts are hashed under every mask and joined. ``MASKS`` are for items of ``LONG`` tokens and more,
``SHORT_MASKS`` for shorter ones; a mask that no item needs is left out. Together they hit nearly every item with a fifth of its tokens replaced (tested
by enumeration). A hit is confirmed if the item lies in the text from its first to its last token with at least ``SIMILAR`` of them equal, or, so that a
part of an item is found as well, if the run of aligned tokens around the hit is at least ``LONG`` tokens and ``SIMILAR`` equal; the run is extended to both sides while
that raises its score (equal tokens less ``SIMILAR`` of its length), by ``REACH`` tokens at most.

A Bloom filter over the item hashes, whose size the number of item hashes fixes and ``MOST_BITS`` bounds, keeps training windows that can't hit
out of the join; it never drops one that can. It also holds the first two compared tokens of the masks, so that most windows cost one look-up. Texts are cut
into pieces of ``PIECE`` windows, whose tokens are read in generated code, one window after the other, so what a task holds is bounded by the hits of a piece, not by those
of a text times its length. Texts themselves are not shuffled: a window that may hit carries its neighbourhood as 32-bit token hashes.

Defined results: null or empty texts and items match nothing; items of fewer than ``WHOLE`` tokens are no evidence and match nothing; equal items
each match; rows that share a ``doc_id`` count as one document; a null ``doc_id`` is a value of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.fingerprints import _constant
from factloom.llm.registry import query, table

#: Fixed masks of six compared tokens for long items, of four for items below ``LONG`` tokens, of three for items of three.
MASKS = ("11101011", "110100111", "111111", "111001101")
SHORT_MASKS = ("1111", "11011", "11101", "10111")
TINY_MASKS = ("111",)
LONG = 12
#: Tokens by which a hit is extended to each side.
REACH = 18
#: Windows of one piece of a text. A window that may hit carries its piece, never its whole text.
PIECE = 256
SIMILAR = 0.8
#: Tokens of an item from which it is searched for.
WHOLE = 3
MOST_BITS = 1 << 22


def masks_of(length: int) -> tuple[str, ...]:
    """The masks under which an item of this length is hashed."""
    return MASKS if length >= LONG else SHORT_MASKS if length > 3 else TINY_MASKS


def words(text: Column) -> Column:
    """The words of a text, without regard to case and punctuation; only the first and the last may be empty."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")


def compared(mask: str) -> list[int]:
    return [k for k, c in enumerate(mask) if c == "1"]


def seed(at: Column, mask: str) -> Column:
    """Hash of the window of ``words`` that begins at ``at`` under a mask."""
    return F.xxhash64(F.lit(mask), *[F.get("words", at + k) for k in compared(mask)])


def start(at: Column, step: int) -> Column:
    """Hash of the first two compared tokens of a window, which are ``step`` apart."""
    return F.xxhash64(F.lit(step), F.get("words", at), F.get("words", at + step))


def steps(masks: list[str]) -> list[int]:
    return sorted({compared(m)[1] for m in masks})


def pieces(texts: DataFrame, masks: list[str], *keep: str) -> DataFrame:
    """A row for each ``PIECE`` windows of ``words``: ``words``, the tokens of these windows and as many to both sides as a hit compares; ``own``, the place of the first
    window; ``origin``, the place of the first token in the text, not counting an empty word before it."""
    blank = (F.get("words", F.lit(0)) == "").cast("int")  # a text that begins with a sign has an empty word first
    beyond = max(map(len, masks)) - 1 + REACH

    def piece(at: Column) -> Column:
        first = F.greatest(at - REACH, F.lit(0))
        return F.struct((first - blank).alias("origin"), (at - first).alias("own"), F.slice("words", first + 1, at - first + PIECE + beyond).alias("words"))

    # no text is without a word, an empty one at least; the outer form keeps Spark from splitting texts once more to see whether there is any
    cut = F.explode_outer(F.transform(F.sequence(F.lit(0), F.size("words") - 1, F.lit(PIECE)), piece)).alias("p")
    return texts.select(*keep, cut).select(*keep, "p.origin", "p.own", "p.words")


def windows(rows: DataFrame, masks: list[str], *keep: str) -> DataFrame:
    """A row for each window and mask: ``at``, ``seed``, ``span``, besides ``words`` and ``keep``."""
    seeds = F.array(*[F.struct(seed(F.col("at"), m).alias("seed"), F.lit(len(m)).alias("span")) for m in masks])
    return rows.select("words", "at", *keep, F.explode(seeds).alias("s")).select("words", "at", *keep, "s.seed", "s.span")


def _filter_of(hashes: DataFrame) -> tuple[list[int], int]:
    """Bits of the hashes (column ``h``), 64 to a number, and the number of bits: about 16 for each hash, rounded up to a power of two."""
    hashes = hashes.distinct()
    count = hashes.count()
    bits = 1 << 10
    while bits < min(16 * count, MOST_BITS):
        bits *= 2
    both = hashes.select(F.explode(F.array(*_probes(F.col("h"), bits))).alias("bit"))
    cells = both.groupBy(F.shiftright("bit", 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).collect()
    words_ = [0] * (bits // 64)
    for cell, value in cells:
        words_[cell] = value
    return words_, bits


def _probes(h: Column, bits: int) -> list[Column]:
    return [h.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(h, 34).bitwiseAND(F.lit(bits - 1))]


def item_words(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """``item_id, words, length`` of the items that are searched for."""
    return items.select(F.col(item).alias("item_id"), F.filter(words(F.col(text)), lambda w: w != "").alias("words")).withColumn(
        "length", F.size("words")).where(F.col("length") >= WHOLE)


def item_seeds(items: DataFrame) -> DataFrame:
    """One row for each seed of each item: ``seed, span, at`` and the item."""
    placed = items.select("item_id", "length", "words", F.posexplode("words").alias("at", "word"))
    parts = []
    for masks, here in ((MASKS, F.col("length") >= LONG), (SHORT_MASKS, F.col("length").between(4, LONG - 1)), (TINY_MASKS, F.col("length") == 3)):
        parts.append(windows(placed.where(here), list(masks), "item_id", "length").where(F.col("at") + F.col("span") <= F.col("length")))
    return parts[0].union(parts[1]).union(parts[2])


def item_index(seeds: DataFrame) -> DataFrame:
    """The seed, its item, and the hashes of the item tokens around it that a hit there compares."""
    first = F.greatest(F.col("at") - REACH, F.lit(0))
    near = F.slice("words", first + 1, F.col("at") - first + F.col("span") + REACH)
    return seeds.select("seed", "item_id", "span", "length", (F.col("at") - first).alias("before"), first.alias("item_from"),
                        F.transform(near, lambda w: F.hash(w)).alias("item_toks")).distinct()


def _extended(same: Column, start: Column, step: int, similar: float) -> Column:
    """Length, equal tokens and score of the best extension, over the tokens (1: equal) from ``start`` on; the longest of equally good ones."""
    part = F.slice(same, start + 1, F.size(same)) if step > 0 else F.reverse(F.slice(same, 1, start))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("eq"), F.lit(0).alias("best_n"), F.lit(0).alias("best_eq"), F.lit(0.0).alias("best"))

    def longer(a: Column, x: Column) -> Column:
        n, eq = a["n"] + 1, a["eq"] + x
        score = F.round(eq - similar * n, 6)
        better = score >= a["best"]
        return F.struct(n.alias("n"), eq.alias("eq"), F.when(better, n).otherwise(a["best_n"]).alias("best_n"),
                        F.when(better, eq).otherwise(a["best_eq"]).alias("best_eq"), F.when(better, score).otherwise(a["best"]).alias("best"))

    return F.aggregate(part, zero, longer)


def contaminated(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id",
                 item_text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """One row for each document and item that share a passage: ``doc_id, item_id, similarity`` (share of equal tokens in the item or the best run),
    ``first_token, last_token`` (of the confirmed runs, in the document) and ``n_hits``."""
    searched = item_words(items, item, item_text)
    kinds = searched.agg(*[F.coalesce(F.bool_or(c), F.lit(False)) for c in (F.col("length") >= LONG, F.col("length").between(4, LONG - 1), F.col("length") == 3)]).first()
    masks = [m for group, used in zip((MASKS, SHORT_MASKS, TINY_MASKS), kinds, strict=True) if used for m in group] or list(MASKS)
    seeds = item_seeds(searched)
    starts = seeds.select(F.explode(F.array(*[start(F.col("at"), k) for k in steps(masks)])).alias("h"))
    cells, bits = _filter_of(seeds.select(F.col("seed").alias("h")).union(starts))
    table_ = _constant(cells, "array<bigint>")

    def held(h: Column) -> Column:
        tests = [F.getbit(F.get(table_, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1 for p in _probes(h, bits)]
        return tests[0] & tests[1]

    split = docs.select(F.col(doc).alias("doc_id"), words(F.col(text)).alias("words"))
    begun = F.lit(False)
    for k in steps(masks):
        begun = begun | held(start(F.col("at"), k))
    last = F.least(F.col("own") + PIECE, F.size("words")) - 1
    placed = pieces(split, masks, "doc_id").select("doc_id", "origin", "words", F.explode(F.sequence("own", last)).alias("at")).where(begun)
    hits = windows(placed, masks, "doc_id", "origin").where(held(F.col("seed")))
    first = F.greatest(F.col("at") - REACH, F.lit(0))
    near = hits.select("doc_id", "seed", (F.col("at") - first).alias("in_near"), (first + F.col("origin")).alias("near_from"), F.transform(
        F.slice("words", first + 1, F.col("at") - first + F.col("span") + REACH), lambda w: F.hash(w)).alias("near"))
    joined = near.join(item_index(seeds), "seed")
    same = F.transform("item_toks", lambda t, i: F.when((F.col("offset") + i >= 0) & (F.get("near", F.col("offset") + i) == t), 1).otherwise(0))
    runs = joined.withColumn("offset", F.col("in_near") - F.col("before")).withColumn("same", same)
    runs = runs.withColumn("left", _extended(F.col("same"), F.col("before"), -1, similar)).withColumn(
        "right", _extended(F.col("same"), F.col("before") + F.col("span"), 1, similar))
    total = lambda cells: F.aggregate(cells, F.lit(0), lambda a, x: a + x)
    length = F.col("left.best_n") + F.col("span") + F.col("right.best_n")
    equal = F.col("left.best_eq") + total(F.slice("same", F.col("before") + 1, F.col("span"))) + F.col("right.best_eq")
    inside = (F.col("item_from") == 0) & (F.size("same") == F.col("length")) & (F.col("offset") >= 0) & (F.col("offset") + F.col("length") <= F.size("near"))
    run = F.struct((equal / length).alias("similarity"), length.alias("n"), (F.col("before") - F.col("left.best_n")).alias("start"))
    whole = F.struct((total(F.col("same")) / F.col("length")).alias("similarity"), F.col("length").alias("n"), F.lit(0).alias("start"))
    found = F.when((length >= LONG) & (equal / length >= similar), run).when(inside & (whole["similarity"] >= similar), whole)
    judged = runs.withColumn("found", found).where(F.col("found").isNotNull())
    from_token = F.col("near_from") + F.col("offset") + F.col("found.start")
    return judged.groupBy("doc_id", "item_id").agg(
        F.max("found.similarity").alias("similarity"), F.greatest(F.min(from_token), F.lit(0)).alias("first_token"),
        (F.max(from_token + F.col("found.n")) - 1).alias("last_token"), F.count("*").alias("n_hits"))


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents, all columns, that share no passage with an item."""
    found = contaminated(docs, items).select(F.col("doc_id").alias("__found")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["__found"]), "left_anti")


@query("op2_benchmark_decontamination")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """All documents against all benchmark items."""
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
