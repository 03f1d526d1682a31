"""Prefix trie of conversations in minimal-perfect-hash node tables.

A prefix of a conversation has a 128-bit digest: the exclusive or of a hash of every turn with its place. Conversations are dealt out by id in shards of bounded
size. A shard enumerates the distinct digests of its prefixes, gives each a slot by a minimal perfect hash (levels of bit arrays: what stands alone in a level is
placed, the rest goes on to the next), and every look-up compares the digest stored in the slot, so no foreign digest is taken for a member. Counts and smallest
members are scattered into flat arrays by slot. The tables of all shards meet once, by digest: a prefix that very many conversations share is one row
for each shard. Every node is owned by one of the shards that hold it; there its own weight is added in, weights run up the parent-slot arrays in depth
order, and the shards' sums meet by digest again.

Turns are ranked without a window over a whole conversation: they are sorted by ranges of (id, turn), counted inside the partitions, and a range adds the counts of
the ranges before it. Conversations longer than ``SEGMENT`` turns are cut: every segment is in a shard of its level with the digest of what precedes it, levels
are worked off from the deepest up, and what hangs below a segment is added at its last node. Ids of the conversations that end in a node are sorted by range and
joined to long strings in parallel; one task then hashes the strings of a node in order.

Defined results: turns go by ``turn``, nulls first, ties by role, then by a hash of the text; repeated rows are turns of their own; null roles and texts are
empty; rows without a ``conv_id`` belong to no conversation; an empty table has no node, not even a root; two digests that are equal for
prefixes of different depth, parent or length end the job with an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.registry import query, table
from factloom.llm.shared import batch, in_batches, mapped, written

#: Turns of a segment, rows of a shard (a segment more at most), ids that are joined to one string.
SEGMENT = 1 << 13
SHARD = 1 << 16
PIECE = 1 << 15
#: Conversations of a block begin like its first one.
BLOCK = 100
HEAD = 6


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Slots:
    """A minimal perfect hash of distinct digests, given as two arrays of 64-bit numbers: each has a slot from 0 to their number less one."""

    def __init__(self, a: np.ndarray, b: np.ndarray) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        left, placed = np.arange(len(a)), 0
        while len(left):
            size = 2 * len(left) + 1
            at = self._at(a[left], b[left], len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            self.levels.append((alone, np.cumsum(alone) - 1 + placed))
            placed += int(alone.sum())
            left = left[~alone[at]]
        self.a, self.b = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        slots = self._slots(a, b)
        self.a[slots], self.b[slots] = a, b
        if placed != len(a) or (self.of(a, b) != slots).any():
            raise ValueError("digests are not distinct")

    @staticmethod
    def _at(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        seed = np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        return (_mixed(_mixed(a.view(np.uint64) ^ seed) + b.view(np.uint64)) % np.uint64(size)).astype(np.int64)

    def _slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out, left = np.full(len(a), -1, np.int64), np.arange(len(a))
        for level, (alone, slots) in enumerate(self.levels):
            at = self._at(a[left], b[left], level, len(alone))
            out[left] = np.where(alone[at], slots[at], -1)
            left = left[~alone[at]]
        return out

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slots of digests; -1 for one that is no member."""
        slots = self._slots(a, b)
        known = (slots >= 0) & (self.a[slots] == a) & (self.b[slots] == b) if len(self.a) else np.zeros(len(a), bool)
        return np.where(known, slots, -1)


_NODE = {"kind": pa.int32(), "level": pa.int32(), "shard": pa.int64(), "slot": pa.int64(), "parent_slot": pa.int64(), "a": pa.int64(), "b": pa.int64(),
         "pa": pa.int64(), "pb": pa.int64(), "depth": pa.int64(), "chars": pa.int64(), "n": pa.int64(), "conv_id": pa.int64()}
NODE = "kind int, level int, shard bigint, slot bigint, parent_slot bigint, a bigint, b bigint, pa bigint, pb bigint, depth bigint, chars bigint, n bigint, conv_id bigint"
TREE, ENDS = 0, 1


def node_table(rows: dict[str, np.ndarray], level: int, shard: int) -> Iterator[pa.RecordBatch]:
    """The nodes of one shard by slot, and (id, last node) of the conversations that end in it. ``rows`` are turns in order of conversation and depth."""
    conv, depth, x1, x2 = rows["conv_id"], rows["d"], rows["x1"], rows["x2"]
    starts = np.flatnonzero(np.concatenate(([True], conv[1:] != conv[:-1])))
    run = np.cumsum(np.bincount(starts, minlength=len(conv))) - 1
    digests = []
    for x, carry in ((x1, rows["c1"]), (x2, rows["c2"])):
        so_far = np.bitwise_xor.accumulate(x)
        before = (so_far ^ x)[starts] ^ carry[starts]
        digests.append(so_far ^ before[run])
    a, b = digests
    ends = rows["last"]
    yield batch(_NODE, **_columns(int(ends.sum()), kind=ENDS, level=level, shard=shard, a=a[ends], b=b[ends], conv_id=conv[ends]))
    said = depth > 0
    pa_, pb_ = (a ^ x1)[said], (b ^ x2)[said]
    a, b, conv_of, deep, chars = a[said], b[said], conv[said], depth[said], rows["chars"][said]
    if level == 0:  # the root, in every conversation
        zero = np.zeros(len(starts), np.int64)
        a, b, pa_, pb_, deep, chars = (np.concatenate((zero, c)) for c in (a, b, pa_, pb_, deep, chars))
        conv_of = np.concatenate((conv[starts], conv_of))
    order = np.lexsort((b, a))
    new = np.concatenate(([True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])))
    slots = Slots(a[order][new], b[order][new])
    size = len(slots.a)
    slot = slots.of(a, b)
    low = np.full(size, np.iinfo(np.int64).max)
    np.minimum.at(low, slot, conv_of)
    flat = {}
    for name, column in (("pa", pa_), ("pb", pb_), ("depth", deep), ("chars", chars)):
        flat[name] = np.zeros(size, np.int64)
        flat[name][slot] = column
        if (flat[name][slot] != column).any():
            raise ValueError("two prefixes have one digest")
    parent = np.where(flat["depth"] > 0, slots.of(flat["pa"], flat["pb"]), -1)
    yield batch(_NODE, **_columns(size, kind=TREE, level=level, shard=shard, slot=np.arange(size), parent_slot=parent, a=slots.a, b=slots.b,
                                  n=np.bincount(slot, minlength=size), conv_id=low, **flat))


def _columns(size: int, **given) -> dict:
    return {k: np.broadcast_to(np.asarray(given.get(k, 0)), (size,)) for k in _NODE}


_TURN = ("seg", "conv_id", "d", "x1", "x2", "c1", "c2", "chars", "last")


def shard_tables(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Turns in order of (segment, conversation, depth) cut into shards of one level and of ``most`` rows or a segment more."""
    held: list[dict[str, np.ndarray]] = []
    count, number = 0, TaskContext.get().partitionId() << 32

    def cut(rows: dict[str, np.ndarray], everything: bool) -> tuple[list[dict], dict]:
        changes = np.flatnonzero((rows["conv_id"][1:] != rows["conv_id"][:-1]) | (rows["seg"][1:] != rows["seg"][:-1])) + 1
        end = len(rows["seg"]) if everything else int(changes[-1]) if len(changes) else 0
        levels = [0, *(k for k in changes if k < end and rows["seg"][k] != rows["seg"][k - 1]), end]
        parts = [{k: v[i:j] for k, v in rows.items()} for i, j in zip(levels, levels[1:], strict=False) if j > i]
        return parts, {k: v[end:] for k, v in rows.items()}

    def flush(everything: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, count, number
        if not held:
            return
        parts, rest = cut({k: np.concatenate([h[k] for h in held]) for k in _TURN}, everything)
        for part in parts:
            yield from node_table(part, int(part["seg"][0]), number)
            number += 1
        held, count = ([rest], len(rest["seg"])) if len(rest["seg"]) else ([], 0)

    for b in batches:
        if not b.num_rows:
            continue
        held.append({k: b.column(i).to_numpy(zero_copy_only=False) for i, k in enumerate(_TURN)})
        count += b.num_rows
        if count >= most:
            yield from flush(False)
    yield from flush(True)


def ranked(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conv_id, part, local, k1, k2, chars`` of every turn, with its place ``local`` inside its range, and ``conv_id, part, before, total``: turns of the
    conversation in earlier ranges and in all."""
    empty = F.lit("")
    role, text = F.coalesce("role", empty), F.coalesce("text", empty)
    small = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"), F.xxhash64(F.lit(1), role, text).alias("k1"),
        F.xxhash64(F.lit(2), role, text).alias("k2"), F.char_length(text).cast("bigint").alias("chars"))
    ordered = small.repartitionByRange("conv_id", "turn", F.left("role", F.lit(32)), "k1").sortWithinPartitions("conv_id", "turn", "role", "k1", "k2")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        current, seen = None, 0
        for b in batches:
            conv = b.column(0).to_numpy()
            if not len(conv):
                continue
            starts = np.flatnonzero(np.concatenate(([conv[0] != current], conv[1:] != conv[:-1])))
            first = np.full(len(conv), -seen, np.int64)
            first[starts] = starts
            first = np.maximum.accumulate(first)
            local = np.arange(len(conv)) - first
            current, seen = conv[-1], int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(conv), part, np.int32)), pa.array(local), *b.columns[1:]],
                                             names=["conv_id", "part", "local", "k1", "k2", "chars"])

    turns = written(mapped(ordered.select("conv_id", "k1", "k2", "chars"), placed, "conv_id bigint, part int, local bigint, k1 bigint, k2 bigint, chars bigint"), "turns")
    by = Window.partitionBy("conv_id")
    spans = turns.groupBy("conv_id", "part").agg(F.count("*").alias("n")).select(
        "conv_id", "part", (F.sum("n").over(by.orderBy("part")) - F.col("n")).alias("before"), F.sum("n").over(by).alias("total"))
    return turns, written(spans, "spans")


def rebuilt(conversations: DataFrame, block: int = BLOCK, head: int = HEAD) -> tuple[DataFrame, int]:
    """Turns of all rebuilt conversations, ``conv_id, d, k1, k2, chars, n_turns`` (one row with ``d`` 0 for a conversation without turns), and the most turns of any.
    A conversation c takes the first h turns, h = crc32(c) % ``head``, from the conversation that its block of ``block`` ids begins with."""
    turns, spans = ranked(conversations)
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % head).cast("int")
    own = spans.where("before = 0").select("conv_id", "total", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % block).alias("base"))
    first = turns.where((F.col("conv_id") % block == 0) & (F.col("local") < head)).join(spans, ["conv_id", "part"]).withColumn("at", F.col("before") + F.col("local"))
    heads = first.where(F.col("at") < head).groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("at", "k1", "k2", "chars"))).alias("head"))
    taken = F.when(F.col("head").isNull(), F.array().cast(heads.schema["head"].dataType)).otherwise(F.slice("head", F.lit(1), F.col("h")))
    convs = own.join(heads, "base", "left").select("conv_id", "h", "total", taken.alias("head"))
    convs = written(convs.withColumn("n_turns", F.size("head") + F.greatest(F.col("total") - F.col("h"), F.lit(0))), "conversations")
    info = spans.join(convs.select("conv_id", "h", "n_turns", F.size("head").alias("shift")), "conv_id").drop("total")
    at = F.col("before") + F.col("local") - F.col("h")
    after = turns.join(info, ["conv_id", "part"]).where(at >= 0).select("conv_id", (at + F.col("shift") + 1).alias("d"), "k1", "k2", "chars", "n_turns")
    begun = convs.select("conv_id", "n_turns", F.posexplode("head").alias("p", "t")).select(
        "conv_id", (F.col("p") + 1).cast("bigint").alias("d"), "t.k1", "t.k2", "t.chars", "n_turns")
    zero = F.lit(0).cast("bigint")
    silent = convs.where("n_turns = 0").select("conv_id", zero.alias("d"), zero.alias("k1"), zero.alias("k2"), zero.alias("chars"), "n_turns")
    return after.union(begun).union(silent), convs.agg(F.coalesce(F.max("n_turns"), zero)).first()[0]


def tables(turns: DataFrame, longest: int, segment: int, most: int) -> DataFrame:
    """The node tables of all shards, ``NODE``."""
    def hashed(seed: int) -> Column:
        return F.when(F.col("d") > 0, F.xxhash64(F.lit(seed), "d", "k1", "k2")).otherwise(F.lit(0))

    seg = F.floor(F.greatest(F.col("d") - 1, F.lit(0)) / segment).cast("int")
    rows = turns.select(seg.alias("seg"), "conv_id", "d", hashed(1).alias("x1"), hashed(2).alias("x2"), "chars", (F.col("d") == F.col("n_turns")).alias("last"), "n_turns")
    if longest > segment:
        rows = written(rows, "turns")
        before = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
        whole = rows.where(F.col("n_turns") > segment).groupBy("conv_id", "seg").agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))
        carry = whole.select("conv_id", "seg", *[F.coalesce(F.bit_xor(x).over(before), F.lit(0)).alias(c) for x, c in (("x1", "c1"), ("x2", "c2"))])
        rows = rows.join(carry, ["conv_id", "seg"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("c1", "c2")})
    else:
        rows = rows.withColumns({c: F.lit(0).cast("bigint") for c in ("c1", "c2")})
    dealt = rows.select(*_TURN).repartition("conv_id", "seg").sortWithinPartitions("seg", "conv_id", "d")
    return written(mapped(dealt, lambda batches: shard_tables(batches, most), NODE), "node-tables")


_SUMS = {"a": pa.int64(), "b": pa.int64(), "pa": pa.int64(), "pb": pa.int64(), "hangs": pa.bool_(), "n_leaves": pa.int64(), "saved": pa.int64(), "conv_id": pa.int64(),
         "depth": pa.int64(), "parent_conv_id": pa.int64(), "n_convs": pa.int64(), "n_children": pa.int64()}
SUMS = ("a bigint, b bigint, pa bigint, pb bigint, hangs boolean, n_leaves bigint, saved bigint, conv_id bigint, depth bigint, parent_conv_id bigint, "
        "n_convs bigint, n_children bigint")


def accumulated(t: pa.Table) -> pa.Table:
    """One shard: weights of the nodes it owns, and what hangs below, run up the parent slots, deepest nodes first. Every slot gives its sums; those owned also give
    what is known of the node. ``hangs``: the parent is in another shard."""
    column = {c: t[c].to_numpy() for c in t.column_names}
    order = np.argsort(column["slot"])
    column = {c: v[order] for c, v in column.items()}
    parent, depth, own = column["parent_slot"], column["depth"], column["owner"] == column["shard"]
    leaves = np.where(own & (column["n_children"] == 0), 1, 0) + column["hung_leaves"]
    saved = np.where(own, (column["n_convs"] - 1) * column["chars"], 0) + column["hung_saved"]
    by_depth = np.argsort(-depth, kind="stable")
    by_depth = by_depth[parent[by_depth] >= 0]
    cuts = np.flatnonzero(np.diff(depth[by_depth])) + 1
    for nodes in np.split(by_depth, cuts):
        np.add.at(leaves, parent[nodes], leaves[nodes])
        np.add.at(saved, parent[nodes], saved[nodes])
    known = {"conv_id": column["low"], "depth": depth, "n_convs": column["n_convs"], "n_children": column["n_children"]}
    out = {k: pa.array(v, pa.int64(), mask=~own) for k, v in known.items()}
    out["parent_conv_id"] = pa.array(column["low"][parent], pa.int64(), mask=~own | (parent < 0))
    out |= {k: pa.array(column[k]) for k in ("a", "b", "pa", "pb")}
    out |= {"hangs": pa.array((parent < 0) & (depth > 0)), "n_leaves": pa.array(leaves), "saved": pa.array(saved)}
    return pa.table({k: out[k] for k in _SUMS})


def summed(nodes: DataFrame, levels: int) -> DataFrame:
    """Every node once, but for the ids that end in it."""
    tree = nodes.where(F.col("kind") == TREE)
    node = written(tree.groupBy("a", "b").agg(F.sum("n").alias("n_convs"), F.min("conv_id").alias("low"), F.min("shard").alias("owner"), F.max("depth").alias("depth"),
                                              F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.max("pa").alias("pa_"), F.max("chars").alias("c"), F.min("chars").alias("c_")), "nodes")
    clash = F.when((F.col("pa") != F.col("pa_")) | (F.col("c") != F.col("c_")), F.raise_error(F.lit("two prefixes have one digest"))).otherwise(F.col("owner"))
    children = node.where("depth > 0").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
    known = node.select("a", "b", "n_convs", "low", clash.cast("bigint").alias("owner")).join(children, ["a", "b"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    placed = tree.select("level", "shard", "slot", "parent_slot", "a", "b", "pa", "pb", "depth", "chars").join(known, ["a", "b"])
    zero = F.lit(0).cast("bigint")
    if levels:
        placed = written(placed, "placed")
    parts, hanging = None, None
    for level in range(levels, -1, -1):
        here = placed.where(F.col("level") == level)
        if hanging is None:
            here = here.withColumns({"hung_leaves": zero, "hung_saved": zero})
        else:
            at = (F.col("a") == F.col("ha")) & (F.col("b") == F.col("hb")) & (F.col("shard") == F.col("owner"))
            here = here.join(hanging, at, "left").drop("ha", "hb").withColumns({c: F.coalesce(c, zero) for c in ("hung_leaves", "hung_saved")})
        part = here.groupBy("shard").applyInArrow(accumulated, SUMS)
        if levels:
            part = written(part, "sums")
            hanging = part.where("hangs").groupBy(F.col("pa").alias("ha"), F.col("pb").alias("hb")).agg(F.sum("n_leaves").alias("hung_leaves"), F.sum("saved").alias("hung_saved"))
        parts = part if parts is None else parts.unionByName(part)
    most = {c: F.max(c).alias(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "pa", "pb")}
    out = parts.groupBy("a", "b").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"), *most.values())
    if levels:  # the parent of a segment's first node is in another shard
        above = node.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("low").alias("above"))
        out = out.join(above, ["pa", "pb"], "left").withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "above")))
    return out


_ENDS = {"a": pa.int64(), "b": pa.int64(), "first": pa.int64(), "ids": pa.string(), "sha256": pa.string()}


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list, bool]]:
    """(a, b, values, new): neighbouring rows of one node, within a batch; ``new`` where the node differs from that of the rows before."""
    current = None
    for b in batches:
        if not b.num_rows:
            continue
        x, y = b.column(0).to_numpy(), b.column(1).to_numpy()
        cuts = [0, *(np.flatnonzero((x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1), len(x)]
        values = b.column(2).to_pylist()
        for i, j in zip(cuts, cuts[1:], strict=False):
            key = (int(x[i]), int(y[i]))
            yield *key, values[i:j], key != current
            current = key


def ended(nodes: DataFrame, piece: int = PIECE) -> DataFrame:
    """``a, b, ends_sha256`` of the nodes in which conversations end."""
    rows = nodes.where(F.col("kind") == ENDS).select("a", "b", "conv_id")
    ordered = rows.repartitionByRange("a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """A node wholly inside a partition is hashed at once; one at an edge, or with very many ids, leaves strings of at most ``piece`` ids."""
        edge, key, ids = True, None, []

        def strings(whole: bool) -> tuple:
            text = ",".join(map(str, ids))
            return (*key, ids[0], None, hashlib.sha256(text.encode()).hexdigest()) if whole else (*key, ids[0], text, None)

        for a, b, values, new in _runs(batches):
            if new and key is not None:
                if ids:
                    yield strings(not edge)
                edge, ids = False, []
            key = (a, b)
            ids += values
            while len(ids) > piece:
                edge, rest = True, ids[piece:]
                ids = ids[:piece]
                yield strings(False)
                ids = rest
        if ids:
            yield strings(False)

    kind = "a bigint, b bigint, first bigint, ids string, sha256 string"
    parts = written(mapped(ordered, lambda batches: in_batches(joined(batches), _ENDS), kind), "ends")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        digest, key = None, None
        for a, b, values, new in _runs(batches):
            if new:
                if key is not None:
                    yield *key, 0, None, digest.hexdigest()
                digest, key = hashlib.sha256(), (a, b)
            for k, text in enumerate(values):
                digest.update(("" if new and k == 0 else ",").encode() + text.encode())
        if key is not None:
            yield *key, 0, None, digest.hexdigest()

    edges = parts.where("sha256 IS NULL").repartition("a", "b").sortWithinPartitions("a", "b", "first").select("a", "b", "ids")
    return parts.where("sha256 IS NOT NULL").union(mapped(edges, lambda batches: in_batches(hashed(batches), _ENDS), kind)).select("a", "b", F.col("sha256").alias("ends_sha256"))


def trie(conversations: DataFrame, block: int = BLOCK, head: int = HEAD, segment: int = SEGMENT, most: int = SHARD) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations."""
    turns, longest = rebuilt(conversations, block, head)
    nodes = tables(turns, longest, segment, most)
    out = summed(nodes, max(0, longest - 1) // segment).join(ended(nodes), ["a", "b"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


_SQL = """
WITH turns AS (
  SELECT conv_id, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS said,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(said ORDER BY place) AS turns FROM turns GROUP BY conv_id),
heads AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten([[((ascii(ch) >> k) & 1)::BIGINT for k in range(8)] for ch in string_split(conv_id::VARCHAR, '')])),
    lambda c, bit: xor(c >> 1, 3988292384 * (xor(c, bit) & 1))), 4294967295) % 6 AS h FROM own),
whole AS (
  SELECT c.conv_id, list_concat(list_slice(coalesce(b.turns, []), 1, c.h), list_slice(c.turns, c.h + 1, len(c.turns))) AS turns
  FROM heads c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 100),
prefixes AS (
  SELECT conv_id, d, len(turns) AS n, sha256(list_slice(turns, 1, d)::JSON::VARCHAR) AS node, CASE WHEN d > 0 THEN length(turns[d].t) ELSE 0 END AS chars
  FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM whole)),
nodes AS (
  SELECT node, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (d = n), '')) AS ends_sha256
  FROM prefixes GROUP BY node),
linked AS (SELECT c.*, p.node AS parent FROM nodes c LEFT JOIN prefixes p ON p.conv_id = c.conv_id AND p.d = c.depth - 1),
children AS (SELECT parent AS node, count(*) AS n_children FROM linked WHERE parent IS NOT NULL GROUP BY parent),
weighed AS (SELECT l.*, coalesce(n_children, 0) AS n_children FROM linked l LEFT JOIN children USING (node)),
below AS (
  SELECT p.node, sum(CASE WHEN w.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((w.n_convs - 1) * w.chars) AS saved_tokens
  FROM weighed w JOIN prefixes p ON p.conv_id = w.conv_id AND p.d <= w.depth GROUP BY p.node)
SELECT w.conv_id, CAST(w.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, w.n_convs, CAST(w.n_children AS BIGINT) AS n_children,
  CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, w.ends_sha256
FROM weighed w JOIN below b USING (node) LEFT JOIN nodes p ON p.node = w.parent"""


@query("op11_conversation_trie", _SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """The trie of all conversations, each rebuilt on the first turns of its block."""
    return trie(table(spark, folder, "conversations"))
