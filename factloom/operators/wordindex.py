"""A stored inverted index: posting blocks by word, read by the words asked, ranked inside bounded groups.

Texts are dealt by their id into parts of a bounded size. A posting block is a word with the sorted ids of one part's texts that hold it, so a word that stands in
every text has as many blocks as there are parts, none larger than a part. Blocks are stored in buckets by word, sorted by word inside their files: a search opens the
buckets its words fall into and, by the minima and maxima of the files, little besides them.

A search deals its questions into blocks and sends each to every part. A group is one part's posting blocks of asked words with one block of questions; it
passes on its best ``k`` a question, so what is shuffled last is questions times parts times ``k``, however often a word occurs. Inside a group
words are taken from the rarest on; once the texts outside of those seen can't reach the ``k``-th any more, more frequent words only count for these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.text import search_forms, search_words, token_forms, words
from factloom.operators.ordering import top_k_per

#: Texts of a part on average, questions of a block on average, and folders of a stored index.
PART_ROWS = 1 << 14
QUESTION_ROWS = 1 << 10
BUCKETS = 64
#: Asked words up to which they are sent to every task.
SENT_WORDS = 1 << 18


def text_words(text: Column) -> Column:
    """The words of a text, as the lexical search compares them."""
    return F.array_distinct(words(text))


def text_forms(text: Column) -> Column:
    """The forms of a text's longer words, as token coverage compares them."""
    return F.array_distinct(F.flatten(F.transform(F.array_distinct(search_words(text)), token_forms)))


def bucket_of(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def build_index(texts: DataFrame, text_id: str, found: Column, folder: str) -> DataFrame:
    """Writes the posting blocks of ``found`` (an array of words for each text) below ``folder`` and returns them. ``text_id`` is an integer; texts without an id
    are left out, texts that share one are one text."""
    usable = texts.where(F.col(text_id).isNotNull()).select(F.col(text_id).cast("long").alias("id"), found.alias("words"))
    parts = max(1, -(-usable.count() // PART_ROWS))
    part = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    pairs = usable.select("id", part.alias("part"), F.explode("words").alias("word"))
    blocks = pairs.groupBy("word", "part").agg(F.sort_array(F.collect_set("id")).alias("ids")).withColumn("bucket", bucket_of(F.col("word")))
    (blocks.repartition("bucket", F.pmod("part", F.lit(-(-parts // 16)))).sortWithinPartitions("bucket", "word", "part")
     .write.partitionBy("bucket").parquet(folder))
    return open_index(texts.sparkSession, folder)


def open_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("word string, part int, ids array<bigint>, bucket int").parquet(folder)


def counted(asked: list[np.ndarray], k: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids with the number of lists they stand in, of distinct sorted lists: all, or those that may be among the best ``k`` (ties: the least ids)."""
    asked = sorted(asked, key=len)
    ids, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for done, own in enumerate(asked):
        left = len(asked) - done
        if k is not None and len(ids) >= k and np.partition(score, len(score) - k)[len(score) - k] > left:
            score = score + np.isin(ids, own, assume_unique=True)
        else:
            both, place = np.unique(np.concatenate([ids, own]), return_inverse=True)
            score = np.bincount(place, np.concatenate([score, np.ones(len(own), np.int64)]), len(both)).astype(np.int64)
            ids = both
    if k is not None and len(ids) > k:
        best = np.lexsort((ids, -score))[:k]
        ids, score = ids[best], score[best]
    return ids, score


def _matches(blocks: pd.DataFrame, questions: pd.DataFrame, k: int | None) -> Iterator[pd.DataFrame]:
    lists = {word: np.asarray(ids, np.int64) for word, ids in zip(blocks["word"], blocks["ids"], strict=True)}
    for question, rows in questions.groupby("question", sort=False):
        asked = []
        for forms in rows["forms"]:
            own = [lists[f] for f in forms if f in lists]
            if own:
                asked.append(own[0] if len(own) == 1 else np.unique(np.concatenate(own)))
        if asked:
            ids, score = counted(asked, k)
            yield pd.DataFrame({"question": question, "id": ids, "matches": score})


def matches(index: DataFrame, questions: DataFrame, question: str, tokens: str, forms, k: int | None = None) -> DataFrame:
    """``question, id, matches``: how many distinct tokens of a question (an integer id and an array) a text has in one of their ``forms``, for pairs with any;
    with ``k``, of each part those that can be among a question's best ``k``."""
    asked = questions.where(F.col(question).isNotNull()).select(F.col(question).cast("long").alias("question"), F.explode(F.array_distinct(tokens)).alias("token"))
    asked = asked.distinct().select("question", forms(F.col("token")).alias("forms"))
    wanted = asked.select(F.explode("forms").alias("word")).distinct().withColumn("bucket", bucket_of(F.col("word")))
    sizes = wanted.agg(F.count("*"), F.collect_set("bucket")).first()  # a bucket set has BUCKETS members at most
    held = index.where(F.col("bucket").isin(sizes[1])) if sizes[1] else index.limit(0)
    names = wanted.select("word")
    held = held.join(F.broadcast(names) if sizes[0] <= SENT_WORDS else names, "word", "left_semi")
    blocks = max(1, -(-questions.count() // QUESTION_ROWS))
    left = held.select("word", "ids", "part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    # every question goes to every part: parts are texts / PART_ROWS in number
    right = asked.withColumn("block", F.pmod(F.xxhash64("question"), F.lit(blocks)).cast("int"))
    count = (index.agg(F.max("part")).first()[0] or 0) + 1
    right = right.select("question", "forms", "block", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("part"))

    def run(own: pd.DataFrame, these: pd.DataFrame) -> pd.DataFrame:
        found = list(_matches(own, these, k)) if len(own) and len(these) else []
        return pd.concat(found) if found else pd.DataFrame({"question": [], "id": [], "matches": []}, dtype=np.int64)

    grouped = left.groupBy("part", "block").cogroup(right.groupBy("part", "block"))
    return grouped.applyInPandas(run, "question long, id long, matches long")


def index_search(index: DataFrame, questions: DataFrame, question: str, text_id: str, k: int = 32, tokens: str = "tokens") -> DataFrame:
    """Top ``k`` texts a question by distinct matching tokens, ties by id; the rows of ``lexical_search`` without label sequences."""
    found = matches(index, questions, question, tokens, search_forms, k)
    return top_k_per(found, ["question"], k, F.desc("matches"), F.asc("id")).withColumnsRenamed({"question": question, "id": text_id})


def index_coverage(index: DataFrame, questions: DataFrame, question: str, text_id: str, tokens: str = "tokens") -> DataFrame:
    """Number of question tokens with an equivalent in the text, for pairs that share any; the rows of ``token_coverage``, from an index of ``text_forms``."""
    found = matches(index, questions, question, tokens, token_forms)
    return found.select(F.col("id").alias(text_id), F.col("question").alias(question), F.col("matches").alias("coverage"))
