"""Hard-negative mining over a secondary sort of packed pair scores.

Every anchor is scored against every row, block by block: blocks of anchors meet blocks of rows, both of bounded size and dealt by hash, so that neither a
common label nor a common vector makes one larger. Of its pairs a block passes on, for each anchor, only the first ``most`` that could be returned: in the
first round of the anchor's own label (candidates for positives), in the second, when the positives are known, of other labels for each positive's
window. A pair beyond those stands behind ``most`` others of its block, so none that counts is lost.

The pairs that remain are packed into keys (anchor; descending score, positives before negatives of the same score; id), dealt out by anchor and sorted
inside the partitions (``repartition`` and ``sortWithinPartitions``, the DataFrame form of repartitionAndSortWithinPartitions). An iterator walks them:
a positive opens a window, a negative goes to every open window that it still belongs to, and nothing of an anchor is held but its open windows.

Defined results: rows with a null id, label or vector, or with any null or non-finite component, take no part; repeated rows (equal id, label and vector) count
once; rows that share an id but not the rest each count, and each is an anchor of its own where the id is one; an anchor's other rows have another id;
of two vectors the shorter one has zeros behind its end; a score beyond 2^55 either way counts as 2^55; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.registry import query, table
from factloom.llm.shared import in_batches, mapped, written

#: Rows and anchors of a block on average, bytes of a block's vectors, and anchors whose scores are held at once.
ROWS = 1 << 12
ANCHORS = 1 << 11
BLOCK_BYTES = 1 << 25
TILE = 1 << 8
#: Positives of an anchor and negatives of a positive.
MOST = 5
#: Least share of the positive's score, in hundredths.
LEAST = 80
LIMIT = 1 << 55


def usable(rows: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id, label, q``: the rows that take part, once each; ``q`` holds floor(scale * x) of each component as an integral double."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(whole)
    exact = F.lit(2.0 ** 52 / scale)  # larger doubles have no digits behind the point after scaling

    def floored(x: Column) -> Column:
        scaled = x.cast("double") * F.lit(float(scale))
        return F.when(F.abs(x.cast("double")) < exact, F.floor(scaled).cast("double")).otherwise(scaled)

    return kept.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.transform("embedding", floored).alias("q")).dropDuplicates()


def matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length, shorter vectors filled up with zeros."""
    parts = vectors.combine_chunks()
    sizes = np.diff(parts.offsets.to_numpy())
    flat = parts.flatten().to_numpy(zero_copy_only=False)
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integral doubles as exact integers within ``LIMIT``."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(width, 1) < 2.0 ** 53:
        return np.rint(a @ b.T).astype(np.int64)  # every partial sum is exact
    whole = [[int(x) for x in row] for row in a], [[int(x) for x in row] for row in b]
    return np.array([[max(-LIMIT, min(LIMIT, sum(map(int.__mul__, x, y)))) for y in whole[1]] for x in whole[0]], np.int64)


def first_of(scores: np.ndarray, at: np.ndarray, most: int) -> np.ndarray:
    """Of the places ``at`` (ascending by id) the first ``most`` by descending score, then id; in no order."""
    if len(at) <= most:
        return at
    here = scores[at]
    least = np.partition(here, len(here) - most)[len(here) - most]
    above, level = at[here > least], at[here == least]
    return np.concatenate((above, level[:most - len(above)]))


_PAIR = {"anchor_id": pa.int64(), "anchor_no": pa.int64(), "packed": pa.int64(), "id": pa.int64()}
PAIR = "anchor_id bigint, anchor_no bigint, packed bigint, id bigint"
BY_PAIR = ["anchor_id", "anchor_no", "packed", "id"]


def packed(score, negative: bool):
    """Ascending as scores descend; a positive before a negative of the same score."""
    return (LIMIT - score) * 2 + int(negative)


def score_of(key: int) -> int:
    return LIMIT - (key >> 1)


def block_pairs(anchors: pa.Table, rows: pa.Table, most: int, least: int) -> pa.Table:
    """The pairs that a block passes on. Without the anchors' positive scores: the first of the same label. With them: the first of other labels for each window."""
    order = np.argsort(rows["vec_id"].to_numpy(), kind="stable")
    ids, labels, vectors = rows["vec_id"].to_numpy()[order], rows["label"].to_numpy()[order], matrix(rows["q"])[order]
    anchor_ids, anchor_nos, anchor_labels = (anchors[c].to_numpy() for c in ("anchor_id", "anchor_no", "label"))
    windows = anchors["windows"].to_pylist() if "windows" in anchors.column_names else None
    anchor_vectors = matrix(anchors["q"])
    found: list[tuple[np.ndarray, ...]] = []
    for start in range(0, len(anchor_ids), TILE):
        tile = products(anchor_vectors[start:start + TILE], vectors)
        for k, scores in enumerate(tile, start):
            other = ids != anchor_ids[k]
            if windows is None:
                chosen = first_of(scores, np.flatnonzero(other & (labels == anchor_labels[k])), most)
            else:
                strange = np.flatnonzero(other & (labels != anchor_labels[k]))
                said = scores[strange] * 100
                parts = [first_of(scores, strange[(said <= 100 * w) & (said >= least * w)], most) for w in set(windows[k])]
                chosen = np.unique(np.concatenate(parts)) if parts else strange[:0]
            found.append((np.full(len(chosen), anchor_ids[k]), np.full(len(chosen), anchor_nos[k]), packed(scores[chosen], windows is not None), ids[chosen]))
    columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [[]] * len(_PAIR)
    return pa.table({name: pa.array(c, kind) for (name, kind), c in zip(_PAIR.items(), columns, strict=True)})


def scored_pairs(anchors: DataFrame, rows: DataFrame, counts: tuple[int, int, int], most: int, least: int) -> DataFrame:
    """``PAIR`` of all blocks. ``counts``: rows, anchors and the length of the longest vector."""
    n_rows, n_anchors, width = counts
    fit = max(1, BLOCK_BYTES // (8 * max(1, width)))
    row_blocks, anchor_blocks = -(-n_rows // min(ROWS, fit)), -(-n_anchors // min(ANCHORS, fit))
    blocks = row_blocks * anchor_blocks
    spread = min(blocks, max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks // 64))

    def dealt(df: DataFrame, own: Column, all_of: int, factor: int, own_factor: int) -> DataFrame:
        block = F.explode(F.transform(F.sequence(F.lit(0), F.lit(all_of - 1)), lambda k: k * factor + own * own_factor)).alias("block")
        return df.select("*", block).repartition(spread, "block")

    left = dealt(anchors, F.pmod("anchor_no", F.lit(anchor_blocks)), row_blocks, 1, row_blocks)
    right = dealt(rows, F.pmod(F.xxhash64("vec_id", "label", "q"), F.lit(row_blocks)), anchor_blocks, row_blocks, 1)
    return left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(lambda a, r: block_pairs(a, r, most, least), PAIR)


def _sorted(pairs: DataFrame) -> DataFrame:
    return pairs.select(*BY_PAIR).repartition("anchor_id", "anchor_no").sortWithinPartitions(*BY_PAIR)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, int]]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def first_pairs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple]:
    """The first ``most`` pairs of each anchor in sorted pairs."""
    current, seen = None, 0
    for pair in _pairs(batches):
        seen = seen + 1 if pair[:2] == current else 1
        current = pair[:2]
        if seen <= most:
            yield pair


def windowed(batches: Iterator[pa.RecordBatch], most: int, least: int) -> Iterator[tuple]:
    """(anchor, positive, rank, negative and both scores) from sorted pairs: only the open windows of one anchor are held."""
    current, open_windows = None, []
    for anchor_id, anchor_no, key, other in _pairs(batches):
        if (anchor_id, anchor_no) != current:
            current, open_windows = (anchor_id, anchor_no), []
        score = score_of(key)
        if not key & 1:
            open_windows.append([other, score, 0])
            continue
        open_windows = [w for w in open_windows if w[2] < most and least * w[1] <= 100 * score]
        for w in open_windows:
            if score <= w[1]:  # a window of a negative score is empty
                w[2] += 1
                yield anchor_id, w[0], w[2], other, w[1], score


_MINED = {"anchor_id": pa.int64(), "positive_id": pa.int64(), "rank": pa.int32(), "negative_id": pa.int64(), "positive_score": pa.int64(), "negative_score": pa.int64()}
MINED = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def mined(rows: DataFrame, every: int = 100, most: int = MOST, least: int = LEAST, scale: int = 256) -> DataFrame:
    """The hard negatives of the rows whose ``vec_id`` is divisible by ``every``, ``MINED``."""
    spark = rows.sparkSession
    kept = written(usable(rows, scale), "vectors")
    is_anchor = F.col("vec_id") % every == 0
    counts = kept.agg(F.count("*"), F.count_if(is_anchor), F.coalesce(F.max(F.size("q")), F.lit(0))).first()
    if not counts[1]:
        return spark.createDataFrame([], MINED)
    anchors = kept.where(is_anchor).select(F.col("vec_id").alias("anchor_id"), F.xxhash64("vec_id", "label", "q").alias("anchor_no"),
                                          F.col("label").alias("label"), F.col("q").alias("q"))  # columns of their own, as both sides come from one table
    near = _sorted(scored_pairs(anchors, kept, tuple(counts), most, least))
    positives = written(mapped(near, lambda batches: in_batches(first_pairs(batches, most), _PAIR), PAIR), "positives")
    # at most `most` to an anchor
    windows = positives.groupBy("anchor_id", "anchor_no").agg(F.collect_list(F.lit(LIMIT) - F.shiftright("packed", 1)).alias("windows"))
    strange = scored_pairs(anchors.join(windows, ["anchor_id", "anchor_no"]), kept, tuple(counts), most, least)
    return mapped(_sorted(positives.unionByName(strange)), lambda batches: in_batches(windowed(batches, most, least), _MINED), MINED)


_SQL = """
WITH used AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM used a JOIN used b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (SELECT * FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, p.id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank,
  n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN pairs n USING (anchor_id) WHERE NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
QUALIFY row_number() OVER (PARTITION BY anchor_id, p.id ORDER BY n.score DESC, n.id) <= 5"""


@query("op12_hard_negatives", _SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Five hard negatives for each of five positives of every hundredth vector, where one label in seven ids is off by one."""
    off = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(table(spark, folder, "embeddings").select("vec_id", off.alias("label"), "embedding"))
