"""N-gram Jaccard join by grouped prefixes, and the components its links make.

A document is the set of its distinct word shingles, as 64-bit hashes. Equal sets collapse into one member first. A fixed-size table counts roughly
how many documents hold each hash; every set is ordered from rare to common, and its first ``n - ceil(s * n) + 1`` hashes are its prefix: sets that
are similar enough share a hash of their prefixes. Members with the same prefix and size make one group. Groups that share a prefix hash are
compared by size and by the place of the hash, which bounds the overlap; what is left is expanded to members, compared by how much their prefixes have in
common, and at last the whole sets of the remaining pairs are intersected.

Groups of near copies aren't paired off: for every prefix hash all groups meet the one where it comes first, and once these links have made
components, only members of different components that share a prefix hash are compared. No link that would join two components is left out.

Two Bloom filters (``repeats``) keep prefix hashes that only one document has out of the shuffle; a plain one picks the documents whose sets are
needed for verification. Both, and the table of counts, have a fixed size and change only how much is compared, never the result.

Defined results: a null text, or one without words, has the empty set, and links with nothing; fewer words than a shingle make one shingle of them
all; rows that share an id are one document, linked by any of its texts; rows with a null id link with nothing and have a null component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.components import components
from factloom.llm.registry import query, table
from factloom.llm.repeats import FILTER_BITS, held, places, repeat_filter, seen_filter
from factloom.llm.shared import mapped, summed_tables, written
from factloom.llm.wordhash import _mix, shingle_sets

WIDTH = 3
PERCENT = 90
#: Cells of the table that counts hashes roughly.
COUNTERS = 1 << 21

#: Bits of the filters of this operator; see ``repeats``.
PREFIX_BITS = 2 * FILTER_BITS

_SLOT = np.uint64(64 - COUNTERS.bit_length() + 1)


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> _SLOT).astype(np.int64)


def rough_counts(texts: DataFrame, width: int) -> np.ndarray:
    """How many documents hold a hash of each cell."""

    def fill(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(COUNTERS, np.int64)
        for rows in batches:
            sets = shingle_sets(rows.column(0).to_pylist(), width)
            if sets:
                total += np.bincount(_cells(np.concatenate(sets)), minlength=COUNTERS)
        return total

    counts = summed_tables(texts.select("text"), fill, COUNTERS)
    return np.minimum(counts, 2**32 - 1).astype(np.uint32)


_PREFIX = {"n": pa.int32(), "same": pa.binary(), "alike": pa.binary(), "prefix": pa.binary()}


def prefixes(texts: DataFrame, counts: np.ndarray, width: int, percent: int) -> DataFrame:
    """``doc_id, n`` (size of the set), ``same`` (digest of the set), ``alike`` (digest of prefix and size) and ``prefix`` (hashes, rare first)."""
    shared = texts.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            sizes, same, alike, first = [], [], [], []
            for found in shingle_sets(rows.column(1).to_pylist(), width):
                n = len(found)
                order = np.lexsort((found, shared.value[_cells(found)]))
                prefix = found[order[:n - (percent * n + 99) // 100 + 1]].tobytes() if n else b""
                sizes.append(n)
                same.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                alike.append(hashlib.blake2b(prefix + n.to_bytes(8, "little"), digest_size=16).digest())
                first.append(prefix)
            columns = [pa.array(v, t) for v, t in zip((sizes, same, alike, first), _PREFIX.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column(0), *columns], names=["doc_id", *_PREFIX])

    kind = dict(texts.dtypes)["doc_id"]
    return mapped(texts.select("doc_id", "text"), run, f"doc_id {kind}, n int, same binary, alike binary, prefix binary")


def shared_hashes(first: DataFrame, bits: int) -> DataFrame:
    """The prefix as ``toks``, an array of (token, place), without hashes that a single document holds."""

    def hashes_of(rows: pa.RecordBatch) -> Iterator[np.ndarray]:
        for blob in rows.column(0).to_pylist():
            yield np.frombuffer(blob, np.uint64)

    again = first.sparkSession.sparkContext.broadcast(repeat_filter(first.select("prefix"), hashes_of, bits))

    @F.pandas_udf("array<struct<token:bigint,place:int>>")
    def kept(prefix: pd.Series) -> pd.Series:
        out = []
        for blob in prefix:
            tokens = np.frombuffer(blob, np.uint64)
            at = np.flatnonzero(held(again.value, places(tokens, bits)))
            out.append([{"token": int(t), "place": int(p)} for t, p in zip(tokens[at].view(np.int64), at, strict=True)])
        return pd.Series(out)

    return first.select("doc_id", "n", "same", "alike", kept("prefix").alias("toks"))


def may_link(a_n: Column, a_place: Column, b_n: Column, b_place: Column, percent: int) -> Column:
    """Whether sets of these sizes, with their first common hash at these places, can still overlap enough."""
    needed = (a_n + b_n).cast("bigint") * percent  # overlap * (100 + percent) has to reach it
    sizes = (F.least(a_n, b_n).cast("bigint") * 100) >= F.greatest(a_n, b_n).cast("bigint") * percent
    return sizes & (F.least(a_n - a_place, b_n - b_place).cast("bigint") * (100 + percent) >= needed)


def plausible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` whose prefixes have enough hashes in common. Of the set whose prefix ends first in the common order, only what follows its prefix
    can meet hashes besides, so the overlap is at most the prefixes' common hashes and the longer remainder."""
    side = sets.select("rep", "n", F.transform("toks", lambda t: t["token"]).alias("tokens"))
    a = side.select(F.col("rep").alias("a"), F.col("n").alias("a_n"), F.col("tokens").alias("a_tokens"))
    b = side.select(F.col("rep").alias("b"), F.col("n").alias("b_n"), F.col("tokens").alias("b_tokens"))
    both = pairs.join(a, "a").join(b, "b")
    rest = F.floor((F.lit(percent) * F.greatest("a_n", "b_n") + 99) / 100) - 1
    most = F.size(F.array_intersect("a_tokens", "b_tokens")) + rest
    return both.where(most * (100 + percent) >= (F.col("a_n") + F.col("b_n")).cast("bigint") * percent).select("a", "b")


def linked(texts: DataFrame, pairs: DataFrame, width: int, percent: int, bits: int) -> DataFrame:
    """The pairs ``a, b`` of ids whose sets are similar enough. Only documents in a pair give up their sets."""
    session = texts.sparkSession
    pairs = written(pairs, "pairs")
    if pairs.isEmpty():
        return pairs
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b"))

    def hashes_of(rows: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield _mix(rows.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))

    wanted = session.sparkContext.broadcast(seen_filter(ids, hashes_of, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            numbers = rows.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            hit = pa.array(np.flatnonzero(held(wanted.value, places(_mix(numbers.view(np.uint64)), bits))))
            if len(hit):
                sets = [s.tobytes() for s in shingle_sets(rows.column(1).take(hit).to_pylist(), width)]
                yield pa.RecordBatch.from_arrays([rows.column(0).take(hit), pa.array(sets, pa.binary())], names=["doc_id", "set"])

    sets = written(mapped(texts.where(F.col("doc_id").isNotNull()), run, "doc_id bigint, set binary"), "sets")

    @F.pandas_udf("boolean")
    def similar(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(left, right, strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            common = len(np.intersect1d(x, y, assume_unique=True))
            out.append(common * 100 >= percent * (len(x) + len(y) - common))
        return pd.Series(out, dtype=bool)

    one = sets.select(F.col("doc_id").alias("a"), F.col("set").alias("a_set"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("set").alias("b_set"))
    both = pairs.join(two, "b").join(one, "a")
    return written(both.where(similar("a_set", "b_set")).select("a", "b").distinct(), "linked")


def jaccard_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, bits: int = PREFIX_BITS) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row: the size of its set and the smallest id that links reach from it."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    first = written(prefixes(texts, rough_counts(texts, width), width, percent), "prefixes")
    usable = first.where((F.col("n") > 0) & F.col("doc_id").isNotNull())

    # equal sets collapse into their smallest id; then equal prefixes and sizes into groups
    alone = shared_hashes(usable, bits).groupBy("same").agg(
        F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("alike").alias("alike"), F.first("toks").alias("toks"))
    alone = written(alone, "sets-once")
    groups = written(alone.groupBy("alike").agg(F.min("rep").alias("grp"), F.first("n").alias("n"), F.first("toks").alias("toks")), "groups")
    members = written(alone.join(groups.select("alike", "grp"), "alike").select("rep", "grp"), "members")
    index = written(groups.select("grp", "n", F.explode("toks").alias("t")).select("grp", "n", "t.token", "t.place"), "index")

    # every group of a hash meets the one where the hash comes first
    leads = (index.groupBy("token").agg(F.count("*").alias("held"), F.min(F.struct("place", "n", "grp")).alias("lead"))
             .where(F.col("held") > 1).select("token", F.col("lead.place").alias("l_place"), F.col("lead.n").alias("l_n"), F.col("lead.grp").alias("l_grp")))
    leads = written(leads, "leads")
    stars = (index.join(leads, "token").where((F.col("grp") != F.col("l_grp")) & may_link(F.col("n"), F.col("place"), F.col("l_n"), F.col("l_place"), percent))
             .select(F.col("l_grp").alias("a"), F.col("grp")).distinct())
    pairs = members.join(stars, "grp").select("a", F.col("rep").alias("b")).union(members.where("rep != grp").select(F.col("grp").alias("a"), F.col("rep").alias("b")))
    # an id with several texts is one document
    several = first.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("same").alias("lo"), F.max("same").alias("hi")).where("lo != hi")
    own = (usable.join(several.select("doc_id"), "doc_id").join(alone.select("same", "rep"), "same")
           .select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a != b").distinct())
    known = written(linked(texts, plausible(pairs.distinct(), alone, percent), width, percent, bits).union(own), "known")
    found = components(known)

    # members of different components that share a hash: all against those outside the component of the hash's first member
    labelled = members.join(found, F.col("rep") == F.col("node"), "left").select("rep", "grp", F.coalesce("label", "rep").alias("label"))
    entries = written(index.join(labelled, "grp").select("token", "place", "n", "rep", "label"), "entries")
    mixed = (entries.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min(F.struct("place", "n", "rep", "label")).alias("lead"))
             .where("lo != hi").select("token", F.col("lead.label").alias("main")))
    mixed = written(entries.join(written(mixed, "mixed"), "token"), "mixed-entries")
    here = mixed.where(F.col("label") != F.col("main")).select("token", *[F.col(c).alias(f"o_{c}") for c in ("place", "n", "rep", "label")])
    across = (here.join(mixed, "token").where((F.col("label") != F.col("o_label")) & may_link(F.col("n"), F.col("place"), F.col("o_n"), F.col("o_place"), percent))
              .select(F.least("rep", "o_rep").alias("a"), F.greatest("rep", "o_rep").alias("b")).distinct())
    late = linked(texts, plausible(across, alone, percent), width, percent, bits)
    if not late.isEmpty():
        found = components(known.union(late))
    rep = alone.select("same", "rep")
    out = first.join(rep, "same", "left").join(found, F.col("rep") == F.col("node"), "left")
    alone_id = F.when(F.col("n") > 0, F.coalesce("label", "rep", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), alone_id).alias("component_id"))


def one_of_each(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The documents, all columns, without those that links join to a document with a smaller id."""
    gone = jaccard_components(docs, width, percent).where("doc_id != component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(written(gone, "near-copies"), F.col("doc_id") == F.col("__gone"), "left_anti")


@query("op10_ngram_jaccard_join")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Components of all documents."""
    return jaccard_components(table(spark, folder, "documents"))
