"""Stored vector index: a trained coarse quantiser with inverted lists, searched by a few lists a question and ranked exactly inside them.

The quantiser is fitted on a bounded sample (``SAMPLE`` vectors to a list, those with the lowest hash of their id); every vector is put into the list of
its nearest centroid. The index is a folder of three tables: ``lists`` (partitioned by list), ``centroids``, and ``recall``, which holds the number of probed lists and
the recall measured with it against the exact search. Lists are gathered into chunks of bounded size, and a question goes once to each chunk with the lists it
probes there, not once to each list; a list that holds a third of all vectors is split into blocks, and so are the questions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.ordering import top_k_per
from factloom.operators.search import _HITS, BLOCK_ROWS, _best, _unit, blocks_of, vector_search

#: Sampled vectors to a list, rounds of the fit, lists at most (bounds what every task holds), and the recall that is asked for.
SAMPLE = 64
ROUNDS = 12
MOST_LISTS = 4096
RECALL = 0.9
#: Standard errors by which the recall over the asked questions has to lie above the wanted one.
MARGIN = 3
#: Similarities to centroids held at once, and rows passed on at once: however many lists there are and are probed, a task's Python holds no more.
SIMS = 1 << 18
PLACED_ROWS = 1 << 12
#: Hits of a group held at once before only the best of each question are kept.
HITS_HELD = 1 << 21


@dataclass(frozen=True)
class VectorIndex:
    """An index by its folder."""

    spark: SparkSession
    folder: str
    dims: int

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    @property
    def lists(self) -> DataFrame:
        return self.spark.read.schema("vec_id bigint, embedding array<float>, list int").parquet(f"{self.folder}/lists")

    @property
    def centroids(self) -> np.ndarray:
        """By list number; at most ``MOST_LISTS`` rows."""
        return np.array([r["centroid"] for r in self._table("centroids").orderBy("list").collect()])

    @property
    def probes(self) -> int:
        return self._table("recall").first()["probes"]

    @property
    def recall(self) -> float:
        return self._table("recall").first()["recall"]


def fitted(sample: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of unit vectors by cosine: seeds spread over the sample, then rounds of assigning and averaging. A list without vectors takes the one that
    fits its own list least."""
    seeds = [0]
    near = sample @ sample[0]
    while len(seeds) < min(lists, len(sample)):
        seeds.append(int(np.argmin(near)))
        near = np.maximum(near, sample @ sample[seeds[-1]])
    centroids = sample[seeds]
    for _ in range(rounds):
        sims = sample @ centroids.T
        own = sims.argmax(axis=1)
        total = np.zeros_like(centroids)
        np.add.at(total, own, sample)
        empty = np.flatnonzero(np.bincount(own, minlength=len(centroids)) == 0)
        if len(empty):
            total[empty] = sample[np.argsort(sims.max(axis=1), kind="stable")[:len(empty)]]
        centroids = _unit(total)
    return centroids


def _usable(df: DataFrame, key: str, dims: int) -> DataFrame:
    """Vectors of the right length, all components finite."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(F.col(key).isNotNull() & (F.size("embedding") == dims) & finite).select(F.col(key).alias(key), F.col("embedding").alias("embedding"))


def _nearest(df: DataFrame, key: str, centroids: np.ndarray, most: int, held: np.ndarray | None = None, k: int = 0) -> DataFrame:
    """``key, embedding, list, place`` for the ``most`` lists nearest to each vector, the nearest at place 1; with ``held``, the number of vectors in each
    list, for as many more as it takes to reach ``k`` vectors."""
    most = min(most, len(centroids))
    step = max(1, SIMS // len(centroids))

    def placed(f: pd.DataFrame) -> Iterator[pd.DataFrame]:
        sims = np.round(_unit(np.stack(f["embedding"].to_numpy()).astype(np.float64)) @ centroids.T, 9)
        if held is None and most == 1:
            row, place, own = np.arange(len(f)), np.zeros(len(f), np.int64), sims.argmax(axis=1)
        else:
            order = np.argsort(-sims, axis=1, kind="stable")
            wanted = np.broadcast_to(np.arange(order.shape[1]) < most, order.shape)
            if held is not None:
                wanted = wanted | (np.cumsum(held[order], axis=1) - held[order] < k)
            row, place = np.nonzero(wanted)
            own = order[row, place]
        for begin in range(0, len(row), PLACED_ROWS):
            cut = slice(begin, begin + PLACED_ROWS)
            yield f.iloc[row[cut]].assign(list=own[cut].astype(np.int32), place=(place[cut] + 1).astype(np.int32))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for begin in range(0, len(f), step):
                yield from placed(f.iloc[begin:begin + step])

    return df.select(key, F.col("embedding").cast("array<float>").alias("embedding")).mapInPandas(place, f"{key} long, embedding array<float>, list int, place int")


def build_index(vectors: DataFrame, folder: str, dims: int, lists: int | None = None, wanted: float = RECALL, k: int = 10, questions: int = 256) -> VectorIndex:
    """Index ``(vec_id, embedding)`` below ``folder``. ``lists``: unset, the square root of the number of vectors. As many lists are probed as
    the ``questions`` vectors with the lowest hash need for a recall of ``wanted`` against the exact search over all vectors; that number and the recall are stored."""
    spark = vectors.sparkSession
    good = _usable(vectors, "vec_id", dims)
    count = good.count()
    number = lists or max(1, min(MOST_LISTS, round(count ** 0.5)))
    by_hash = good.orderBy(F.xxhash64("vec_id"), "vec_id")
    sample = by_hash.limit(SAMPLE * number).toPandas()  # SAMPLE * MOST_LISTS vectors at most
    centroids = fitted(_unit(np.stack(sample["embedding"].to_numpy()).astype(np.float64)), number) if len(sample) else np.zeros((1, dims))
    spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centroids)], "list int, centroid array<double>").coalesce(1).write.parquet(f"{folder}/centroids")
    # a list is written by as many tasks as it has blocks
    dealt = _nearest(good, "vec_id", centroids, 1).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-count // (BLOCK_ROWS * 16))))))
    dealt.repartition("list", "block").select("vec_id", "embedding", "list").write.partitionBy("list").parquet(f"{folder}/lists")
    index = VectorIndex(spark, folder, dims)
    asked = by_hash.limit(questions).select(F.col("vec_id").alias("query_id"), "embedding")
    probes, recall = tuned(index, asked, vector_search(good, asked, k, dims), wanted)
    spark.createDataFrame([(probes, recall, questions, k)], "probes int, recall double, questions int, k int").coalesce(1).write.parquet(f"{folder}/recall")
    return index


def tuned(index: VectorIndex, asked: DataFrame, exact: DataFrame, wanted: float) -> tuple[int, float]:
    """The least number of probed lists whose recall over the asked questions is above the wanted one by ``MARGIN`` standard errors, as other questions
    may do worse than these, and that recall. An exact hit is found if and only if its list is probed, as ranking inside
    the lists is exact; so the places of the hits' lists among the lists of their question, one count for each list, tell the recall of any number."""
    lists = len(index.centroids)
    places = _nearest(_usable(asked, "query_id", index.dims), "query_id", index.centroids, lists).select("query_id", "list", "place")
    hits = exact.select("query_id", "vec_id").join(index.lists.select("vec_id", "list"), "vec_id").join(places, ["query_id", "list"])
    per_question = hits.groupBy("query_id", "place").count().toPandas()  # the asked questions times their exact hits at most
    found = per_question.pivot_table(index="query_id", columns="place", values="count", fill_value=0).reindex(columns=range(1, lists + 1), fill_value=0)
    shares = found.to_numpy(dtype=np.float64).cumsum(axis=1)
    if not len(shares):
        return 1, 1.0
    shares /= shares[:, -1:]
    mean = shares.mean(axis=0)
    margin = MARGIN * shares.std(axis=0) / len(shares) ** 0.5
    place = int(np.argmax(mean - margin >= wanted)) if (mean - margin >= wanted).any() else lists - 1
    return place + 1, float(mean[place])


def _wanted(sims: np.ndarray, most: int, held: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Lists by similarity for each row, and which of them are probed: the first ``most``, and as many more as it takes to reach ``k`` vectors."""
    order = np.argsort(-sims, axis=1, kind="stable")
    return order, (np.arange(order.shape[1]) < most) | (np.cumsum(held[order], axis=1) - held[order] < k)


def chunked(counts: np.ndarray, most: int) -> np.ndarray:
    """Chunk of each list: lists in order, together at most ``most`` vectors; a larger list has a chunk of its own."""
    chunk, at, total = np.zeros(len(counts), np.int32), 0, 0
    for number, n in enumerate(counts.tolist()):
        if total and total + n > most:
            at, total = at + 1, 0
        chunk[number], total = at, total + n
    return chunk


def _asked(df: DataFrame, centroids: np.ndarray, most: int, held: np.ndarray, k: int, chunk: np.ndarray) -> DataFrame:
    """``query_id, vector, chunk, lists``: each question once for each chunk in which it probes lists."""
    step = max(1, SIMS // len(centroids))

    def placed(f: pd.DataFrame) -> Iterator[pd.DataFrame]:
        order, wanted = _wanted(np.round(_unit(np.stack(f["embedding"].to_numpy()).astype(np.float64)) @ centroids.T, 9), most, held, k)
        row, place = np.nonzero(wanted)
        own = order[row, place].astype(np.int32)
        met = row * (int(chunk.max()) + 1) + chunk[own]
        sort = np.argsort(met, kind="stable")
        first = np.flatnonzero(np.diff(met[sort], prepend=-1))
        lists = np.split(own[sort], first[1:])
        row, part = row[sort][first], chunk[own[sort][first]]
        for begin in range(0, len(row), PLACED_ROWS):
            cut = slice(begin, begin + PLACED_ROWS)
            f_cut = f.iloc[row[cut]]
            yield pd.DataFrame({"query_id": f_cut["query_id"].to_numpy(), "vector": f_cut["embedding"].to_numpy(), "chunk": part[cut], "lists": lists[cut]})

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for begin in range(0, len(f), step):
                yield from placed(f.iloc[begin:begin + step])

    return df.select("query_id", F.col("embedding").cast("array<float>").alias("embedding")).mapInPandas(
        place, "query_id long, vector array<float>, chunk int, lists array<int>")


def probed(vectors: pd.DataFrame, questions: pd.DataFrame, k: int) -> pd.DataFrame:
    """Top ``k`` for each question of a block among the vectors (``vec_id, vector, list``) of a chunk that lie in the lists it probes (``lists``)."""
    none = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "similarity": np.zeros(0)})
    if not len(vectors) or not len(questions):
        return none
    ids, q_ids = vectors["vec_id"].to_numpy(), questions["query_id"].to_numpy()
    v, q = (_unit(np.stack(f["vector"].to_numpy()).astype(np.float64)) for f in (vectors, questions))
    asked = np.concatenate(questions["lists"].to_numpy())
    rows = np.repeat(np.arange(len(questions)), questions["lists"].map(len).to_numpy())
    sort = np.argsort(asked, kind="stable")
    asked, rows = asked[sort], rows[sort]

    def best(found: list[pd.DataFrame]) -> pd.DataFrame:
        ranked = pd.concat(found).sort_values(["query_id", "similarity", "vec_id"], ascending=[True, False, True])
        return ranked.groupby("query_id").head(k)

    found, held = [none], 0
    for number, where in vectors.groupby("list").indices.items():
        mine = rows[np.searchsorted(asked, number):np.searchsorted(asked, number, side="right")]
        if len(mine):
            found.append(_best(q_ids[mine], q[mine], ids[where], v[where], k))
            held += len(found[-1])
        if held > HITS_HELD:
            found, held = [best(found)], 0
    return best([f for f in found if len(f)] or [none])


def index_search(index: VectorIndex, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """Top ``k`` by cosine similarity among the vectors of the probed lists, ``query_id, vec_id, similarity, rank``; similarities are exact. A question whose
    probed lists hold fewer than ``k`` vectors goes on to its next lists, so it gets ``k`` results if there are so many vectors. What is shuffled grows with the
    chunks and the blocks of questions, not with the lists probed, and so do the hits: a group passes on ``k`` of each question."""
    held = index.lists
    centroids = index.centroids
    counts = np.zeros(len(centroids), dtype=np.int64)
    for row in held.groupBy("list").count().collect():  # at most MOST_LISTS rows
        counts[row["list"]] = row["count"]
    good = _usable(queries, "query_id", index.dims)
    q_blocks = blocks_of(good.count(), index.dims)
    total = int(counts.sum())
    most = max(1, -(-total // blocks_of(total, index.dims)))
    chunk = chunked(counts, most)
    sizes = np.bincount(chunk, weights=counts).astype(np.int64)
    blocks = index.spark.createDataFrame([(i, int(c), max(1, -(-int(sizes[c]) // most))) for i, c in enumerate(chunk)], "list int, chunk int, v_blocks int")
    left = held.join(F.broadcast(blocks), "list").select(
        "chunk", "list", F.col("vec_id").alias("vec_id"), F.col("embedding").alias("vector"),
        F.pmod(F.xxhash64("vec_id"), F.col("v_blocks")).cast("int").alias("vb"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"))
    asked = _asked(good, centroids, probes or index.probes, counts, k, chunk)
    right = asked.join(F.broadcast(blocks.select("chunk", "v_blocks").distinct()), "chunk").select(
        "chunk", "query_id", "vector", "lists", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).cast("int").alias("qb"),
        F.explode(F.sequence(F.lit(0), F.col("v_blocks") - 1)).alias("vb"))
    hits = left.groupBy("chunk", "vb", "qb").cogroup(right.groupBy("chunk", "vb", "qb")).applyInPandas(lambda v, q: probed(v, q, k), _HITS)
    return top_k_per(hits, ["query_id"], k, F.desc("similarity"), F.asc("vec_id"))


def recall_of(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact hits that were found; 1 without any."""
    hit = found.select("query_id", "vec_id", F.lit(1).alias("hit"))
    return exact.join(hit, ["query_id", "vec_id"], "left").agg(F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(1.0))).first()[0]
