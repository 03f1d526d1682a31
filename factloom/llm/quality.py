"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network with calibrated probabilities.

Tokens are runs of letters, of digits and of other signs, hashed into ``BUCKETS``; each is followed by a marker of its kind, case
and length, or of repeating one of the two tokens before it. Every bucket has a fixed sparse random index vector; its context vector is the sum of the index vectors of the tokens around it, counted over all documents
in integers, so the sum does not depend on how rows lie. A word's vector is its index vector beside its scaled context vector, a document's vector
the mean over its tokens. The network learns from a bounded sample of labelled rows (``SAMPLE``: those with the lowest hash of their id); a fifth of the
sample is held back to fit the temperature.

Defined results: a null or empty text has the zero vector and gets a score like any other; labels that are null or whose document is missing teach
nothing; an id with several labels teaches each of them; without labels of both kinds the score is the smoothed share of label 1, 0.5 without any.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.registry import query, table
from factloom.llm.shared import bounded_batches, summed_tables
from factloom.llm.wordhash import _BYTE, _mix, _powers

BUCKETS = 1 << 13
MARKERS = 32
WIDTH = 64
NONZERO = 2
REACH = 2
SAMPLE = 20_000
HIDDEN = 32
EPOCHS = 60
#: Scores from here on count as good.
THRESHOLD = 0.3

_CLASS = np.full(256, 3, np.uint8)  # 0 blank, 1 letter, 2 digit, 3 other
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
for _a, _b, _c in ((65, 91, 1), (97, 123, 1), (128, 256, 1), (48, 58, 2)):
    _CLASS[_a:_b] = _c
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1


def token_ids(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every token and marker of all texts in order, and the number of the text that each belongs to."""
    blobs = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join([*blobs, b""]), np.uint8)
    kinds = _CLASS[data]
    before = np.concatenate(([0], kinds[:-1])) if len(kinds) else kinds
    starts = np.flatnonzero((kinds != 0) & (kinds != before))
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    changes = np.flatnonzero(kinds != before)
    following = np.searchsorted(changes, starts, side="right")
    ends = np.append(changes, len(data))[following]
    lengths = ends - starts
    inside = np.flatnonzero(kinds)
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    within = np.arange(len(inside)) - np.repeat(first, lengths)
    letters = data[inside]
    lower = np.where(_UPPER[letters] == 1, letters + 32, letters).astype(np.uint8)
    with np.errstate(over="ignore"):
        hashes = _mix(np.add.reduceat(_BYTE[lower] * _powers(int(lengths.max()))[within], first))
    upper = np.add.reduceat(_UPPER[letters], first)
    kind = kinds[starts].astype(np.int64)
    case = np.where(kind == 1, np.minimum(upper, 2), kind + 1)
    owners = np.searchsorted(np.cumsum([len(b) + 1 for b in blobs]), starts, side="right")
    for back in (1, 2):  # a token said again at once, or with one sign in between
        case[back:] = np.where((hashes[back:] == hashes[:-back]) & (owners[back:] == owners[:-back]), 5, case[back:])
    size = np.searchsorted([2, 4, 8, 16], lengths, side="right")
    out = np.empty(2 * len(starts), np.int64)
    out[0::2] = (hashes % np.uint64(BUCKETS - MARKERS)).astype(np.int64)
    out[1::2] = BUCKETS - MARKERS + case * 5 + size
    return out, np.repeat(owners, 2)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero entries of each bucket's index vector."""
    draw = np.random.default_rng(20240)
    return draw.integers(0, WIDTH, (BUCKETS, NONZERO)), draw.choice([-1.0, 1.0], (BUCKETS, NONZERO))


def context_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """For each bucket the sum of the index vectors of all tokens within ``REACH`` of it, over all documents."""

    def fill(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        spots, signs = index_vectors()
        total = np.zeros(BUCKETS * WIDTH)
        for rows in batches:
            ids, owners = token_ids(rows.column(0).to_pylist())
            for off in range(1, REACH + 1):
                near = owners[off:] == owners[:-off]
                left, right = ids[:-off][near], ids[off:][near]
                for a, b in ((left, right), (right, left)):
                    cells = (a[:, None] * WIDTH + spots[b]).ravel()
                    total += np.bincount(cells, signs[b].ravel(), len(total))
        return total.astype(np.int64)

    return summed_tables(docs.select(text), fill, BUCKETS * WIDTH).reshape(BUCKETS, WIDTH)


def word_vectors(contexts: np.ndarray) -> np.ndarray:
    spots, signs = index_vectors()
    own = np.zeros((BUCKETS, WIDTH), np.float32)
    np.add.at(own, (np.arange(BUCKETS)[:, None], spots), signs)
    scale = np.linalg.norm(contexts.astype(float), axis=1, keepdims=True)
    return np.concatenate((own, contexts / np.maximum(scale, 1.0)), axis=1).astype(np.float32)


def pooled(texts: list[str | None], vectors: np.ndarray) -> np.ndarray:
    """Mean word vector of each text; zero for a text without tokens."""
    ids, owners = token_ids(texts)
    counts = np.bincount(owners * BUCKETS + ids, minlength=len(texts) * BUCKETS).reshape(len(texts), BUCKETS).astype(np.float32)
    return counts @ vectors / np.maximum(counts.sum(axis=1, keepdims=True), 1)


@dataclass
class Network:
    """Standardised input, one hidden layer of tanh units, one output, a temperature; ``constant`` stands in where nothing can be learned."""

    mean: np.ndarray
    spread: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0
    constant: float | None = None

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.spread @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Network:
    """Adam on the log loss over four fifths of the rows, then the temperature with the least log loss on the rest."""
    width = x.shape[1]
    draw = np.random.default_rng(seed)
    blank = Network(np.zeros(width), np.ones(width), draw.normal(0, 1 / np.sqrt(width), (width, HIDDEN)), np.zeros(HIDDEN), draw.normal(0, 0.3, HIDDEN), 0.0)
    if len(np.unique(y)) < 2:
        blank.constant = float((y.sum() + 1) / (len(y) + 2))
        return blank
    order = draw.permutation(len(y))
    held_back, fit = order[: len(y) // 5], order[len(y) // 5:]
    net = blank
    net.mean, net.spread = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-3
    params = [net.w1, net.b1, net.w2, np.array([net.b2])]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    xs = (x - net.mean) / net.spread
    for _ in range(EPOCHS):
        for part in np.array_split(draw.permutation(fit), max(1, len(fit) // 128)):
            hidden = np.tanh(xs[part] @ params[0] + params[1])
            error = (1 / (1 + np.exp(-np.clip(hidden @ params[2] + params[3][0], -30, 30))) - y[part]) / len(part)
            back = error[:, None] * params[2] * (1 - hidden**2)
            grads = [xs[part].T @ back + 1e-3 * params[0], back.sum(axis=0), hidden.T @ error + 1e-3 * params[2], np.array([error.sum()])]
            step += 1
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= 0.003 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    if len(held_back):
        z, t = net.logits(x[held_back]), y[held_back]
        net.temperature = float(min(np.geomspace(0.25, 8, 61), key=lambda k: np.logaddexp(0, np.where(t > 0, -z, z) / k).mean()))
    return net


def may_learn(doc_id: Column) -> Column:
    """Rows whose labels may be used: those whose crc32 of the id, as text, is no multiple of 5; none with a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, Network]:
    """Word vectors over all documents, and the network trained on at most ``sample`` labelled ones."""
    spark = docs.sparkSession
    vectors = word_vectors(context_vectors(docs))
    usable = labels.select(F.col("doc_id").alias("__id"), F.col("quality").cast("int").alias("__label")).where(
        F.col("__label").isin(0, 1) & F.col("__id").isNotNull() & may_learn(F.col("__id")))
    chosen = F.broadcast(usable.orderBy(F.xxhash64("__id"), "__id", "__label").limit(sample))  # `sample` rows at most
    shared = spark.sparkContext.broadcast(vectors)
    bounded_batches(spark)

    @F.pandas_udf("array<float>")
    def vector(texts: pd.Series) -> pd.Series:
        return pd.Series(list(pooled(list(texts), shared.value)))

    taught = docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("__id"))
    rows = taught.select("doc_id", "__label", vector("text").alias("v")).orderBy("doc_id", "__label").limit(sample).collect()
    x = np.array([r["v"] for r in rows], float).reshape(len(rows), 2 * WIDTH)
    return vectors, train(x, np.array([r["__label"] for r in rows], float))


def scored(docs: DataFrame, vectors: np.ndarray, network: Network, out: str = "score", text: str = "text") -> DataFrame:
    """All rows and columns, and the probability of label 1 as ``out``."""
    shared = docs.sparkSession.sparkContext.broadcast((vectors, network))
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        table_, net = shared.value
        return pd.Series(net.probabilities(pooled(list(texts), table_)).astype(float))

    return docs.withColumn(out, score(F.col(text)))


@query("op8_quality_classifier")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """A score for every whole document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    vectors, network = fitted(docs, table(spark, folder, "labels"))
    return scored(docs, vectors, network).select("doc_id", (~may_learn(F.col("doc_id"))).alias("held_out"), "score",
                                                 (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
