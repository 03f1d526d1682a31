"""Main text of web pages by template deduction over the pages of a host, from equivalence classes of tokens.

A page is a sequence of tokens: the tags that open and close elements around its texts, and the texts between two tags, each in its role, the path of elements
around it. Pages of a host whose longest text (of one container, outside links and named furniture) is the same are one page content and count once, so copies of
a page and repeated rows don't look like a template, also if a date or a side column differs; where furniture is longer than every article, a host thus
has no template and keeps it.

1. The occurrence vector of a token says how often it stands on each content of its host. Tokens with equal vectors are one class, if they are two at
   least and stand on half of the host's contents, two at least. A vector is held as two 64-bit exclusive ors over (content, nth occurrence): they merge in any order.
2. A class is ordered if its tokens come in one order, again and again, on every content that has them. Two ordered classes nest if each occurrence
   of one lies in a gap between two tokens of the other. Of classes that cross, the one with fewer occurrences (ties: by vector) leaves, if the other one stays.
3. The classes left, one inside the gaps of another, are the template; what stands in their gaps are the slots. A container (the path without the paragraph, heading,
   list item or cell at its end) all of whose texts are template tokens on a page is no slot and goes; a heading or sentence that
   stays the same beside others that change is kept. A slot outside article and main elements goes if the tags around its texts are template and most of what it holds is links.
4. Of the slots left, elements' meaning and names tell adverts and menus that change from the article: named furniture goes, and if slots inside article or
   main elements are left, what stands outside of them goes.

Defined results: null or empty html gives an empty text; a null url is a host of its own; a host with a single page content has no template; texts in page order,
one block a line.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.markup import Block, blocks
from factloom.llm.registry import query, table
from factloom.llm.shared import bounded_batches, mapped, written

#: Share of linked characters from which a slot counts as a list of links.
LINKS = 0.6
#: Bytes of all templates up to which they are sent to every task; beyond, pages are joined with theirs by a shuffle.
SENT = 8 << 20

#: Elements that hold one piece of a text; what stands around them is the container.
_PIECE = re.compile(r">(?:p|h[1-6]|li|dt|dd|td|th|tr|blockquote|pre|figcaption|caption)(?:\.[^>]*)?$")

#: Seeds of the two exclusive ors that stand for an occurrence vector.
SEEDS = (1, 2)

_CONTENTS = {"host": pa.string(), "content": pa.int64(), "tokens": pa.list_(pa.int64()), "nths": pa.list_(pa.int32())}


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _container(path: str) -> str:
    """The path without the list item, paragraph or cell at its end."""
    while (cut := _PIECE.sub("", path)) != path:
        path = cut
    return path


def _signed(number: int) -> int:
    return number - (1 << 64) if number >> 63 else number


def _digest(text: str) -> int:
    return _signed(xxhash.xxh3_64_intdigest(text))


def _containers(found: list[Block]) -> dict[str, list[Block]]:
    around: dict[str, list[Block]] = {}
    for b in found:
        around.setdefault(_container(b.path), []).append(b)
    return around


def _mostly_links(found: list[Block]) -> bool:
    return sum(b.linked for b in found) >= LINKS * sum(len(b.text) for b in found)


def content_of(found: list[Block]) -> int:
    """A digest of the longest text in one container outside named furniture and links; of equally long ones the last."""
    around = _containers([b for b in found if b.kind != "furniture"])
    return _digest(max(reversed(["\n".join(b.text for b in own) for own in around.values() if not _mostly_links(own)]), key=len, default=""))


def tokens_of(found: list[Block]) -> tuple[list[int], list[tuple[int, int]]]:
    """The page's tokens in order, and for each block its own element's opening tag and its text. An element between two blocks of the same path is
    taken to begin anew only if it is the last of the path."""
    tokens: list[int] = []
    own: list[tuple[int, int]] = []
    names: list[str] = []
    roles: list[int] = [0]  # of the elements open, from the outermost

    def close(depth: int) -> None:
        while len(names) > depth:
            tokens.append(_digest(f"/{roles.pop()}"))
            names.pop()

    for b in found:
        path = b.path.split(">")[1:]
        same = 0
        while same < min(len(names), len(path) - 1) and names[same] == path[same]:
            same += 1
        close(same)
        for name in path[same:]:
            names.append(name)
            roles.append(_digest(f"{roles[-1]}>{name}"))
            tokens.append(roles[-1])
        own.append((roles[-1], _digest(f"{roles[-1]}={b.text}")))
        tokens.append(own[-1][1])
    close(0)
    return tokens, own


def contents(pages: DataFrame) -> DataFrame:
    """``host, content, tokens, nths``: each page content of a host once, with its tokens in order and how often each has occurred up to there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out = []
            for host, page in zip(*(rows.column(k).to_pylist() for k in range(2)), strict=True):
                found = blocks(page)
                tokens, _ = tokens_of(found)
                seen: dict[int, int] = {}
                nths = []
                for t in tokens:
                    seen[t] = seen.get(t, 0) + 1
                    nths.append(seen[t])
                out.append((host, content_of(found), tokens, nths))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _CONTENTS.values(), strict=True)], names=list(_CONTENTS))

    rows = mapped(pages, run, "host string, content bigint, tokens array<bigint>, nths array<int>")
    return rows.groupBy("host", "content").agg(F.min(F.struct("tokens", "nths")).alias("page")).select("host", "content", "page.*")


def classes(pages: DataFrame) -> DataFrame:
    """``host, patterns``: for each host the tokens of its classes, in the order of the least content that has them; classes with many occurrences first.
    Each token stands on half of the host's contents, so a host's classes hold no more than twice as many tokens as a page."""
    hosts = pages.groupBy("host").agg(F.count("*").alias("all_contents")).where("all_contents > 1")
    spots = pages.select("host", "content", F.posexplode(F.arrays_zip("tokens", "nths")).alias("at", "token"))
    occurs = [F.bit_xor(F.xxhash64(F.lit(seed), "content", "token.nths")).alias(f"vector{seed}") for seed in SEEDS]
    vectors = spots.groupBy("host", F.col("token.tokens").alias("token")).agg(
        *occurs, F.count("*").alias("occurrences"), F.count_if(F.col("token.nths") == 1).alias("contents"), F.min(F.struct("content", "at")).alias("first"))
    often = vectors.where("contents > 1").join(hosts, "host").where("2 * contents >= all_contents")
    found = often.groupBy("host", *(f"vector{seed}" for seed in SEEDS)).agg(
        F.sum("occurrences").alias("occurrences"), F.array_sort(F.collect_list(F.struct("first.at", "token"))).alias("members")).where(F.size("members") > 1)
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("occurrences")).alias("rank"), *(f"vector{seed}" for seed in SEEDS), F.col("members.token").alias("pattern"))))
    return found.groupBy("host").agg(ranked.alias("ranked")).select("host", F.col("ranked.pattern").alias("patterns"))


def faults_of(tokens: list[int], patterns: list[list[int]]) -> set[tuple[int, int]]:
    """Pairs of classes (by place in ``patterns``) that cross on a page, the lower ranked first; a class out of its own order is paired with itself."""
    place = {t: (c, k) for c, pattern in enumerate(patterns) for k, t in enumerate(pattern)}
    own: dict[int, list[int]] = {}
    for t in tokens:
        if t in place:
            own.setdefault(place[t][0], []).append(t)
    faults = {(c, c) for c, said in own.items() if said != patterns[c] * (len(said) // len(patterns[c]))}
    bad = {c for c, _ in faults}
    opened: list[list[int]] = []  # class and tokens seen of each occurrence that isn't complete
    for t in tokens:
        c, k = place.get(t, (-1, 0))
        if c < 0 or c in bad:
            continue
        if k == 0:
            opened.append([c, 1])
            continue
        at = next(i for i in range(len(opened) - 1, -1, -1) if opened[i][0] == c)
        faults.update((max(c, other), min(c, other)) for other, _ in opened[at + 1:])
        opened[at][1] += 1
        if opened[at][1] == len(patterns[c]):
            del opened[at]
    return faults


def kept_tokens(patterns: list[list[int]], faults: set[tuple[int, int]]) -> list[int]:
    """The tokens of the classes that are ordered and cross no higher ranked class that stays."""
    crossed: dict[int, set[int]] = {}
    for low, high in faults:
        crossed.setdefault(low, set()).add(high)
    stay: set[int] = set()
    for c in range(len(patterns)):
        if c not in crossed.get(c, ()) and not crossed.get(c, set()) & stay:
            stay.add(c)
    return [t for c in sorted(stay) for t in patterns[c]]


def _beside(pages: DataFrame, own: DataFrame, host: Column, weight: Column) -> DataFrame:
    """``pages`` with the row of their host in ``own``, which is sent to every task while it is small."""
    size = own.agg(F.sum(weight)).first()[0] or 0
    return pages.join(F.broadcast(own) if size <= SENT else own, host == F.col("__host"), "left")


def templates(pages: DataFrame) -> DataFrame:
    """``host, tokens``: the template tokens of each host that has any."""
    once = written(contents(pages), "contents")
    found = written(classes(once), "classes")

    @F.pandas_udf("array<array<int>>")
    def faulty(tokens: pd.Series, patterns: pd.Series) -> pd.Series:
        return pd.Series([[list(f) for f in faults_of(list(t), [list(p) for p in own])] for t, own in zip(tokens, patterns, strict=True)], dtype=object)

    held = _beside(once, found.withColumnRenamed("host", "__host"), F.col("host"), 8 * F.size(F.flatten("patterns"))).where(F.col("patterns").isNotNull())
    pairs = held.select("host", F.explode(faulty("tokens", "patterns")).alias("pair")).groupBy("host").agg(F.collect_set("pair").alias("faults"))

    @F.pandas_udf("array<bigint>")
    def staying(patterns: pd.Series, faults: pd.Series) -> pd.Series:
        return pd.Series([kept_tokens([list(p) for p in own], {tuple(f) for f in pairs} if pairs is not None else set())
                          for own, pairs in zip(patterns, faults, strict=True)], dtype=object)

    return found.join(pairs, "host", "left").select("host", staying("patterns", "faults").alias("tokens")).where(F.size("tokens") > 0)


def main_text(page: str | None, template: set[int]) -> str:
    """The page's article, given the template tokens of its host."""
    found = blocks(page)
    own = {id(b): pair for b, pair in zip(found, tokens_of(found)[1], strict=True)} if template else {}
    slots: set[int] = set()
    for around in _containers([b for b in found if b.kind != "furniture"]).values():
        fixed = template and all(own[id(b)][1] in template for b in around)
        links = template and around[0].kind != "main" and _mostly_links(around) and all(own[id(b)][0] in template for b in around)
        if not (fixed or links):
            slots.update(id(b) for b in around)
    left = [b for b in found if id(b) in slots]
    return "\n".join(b.text for b in [b for b in left if b.kind == "main"] or left)


def extracted(pages: DataFrame, out: str = "main_text", html: str = "html", url: str = "url") -> DataFrame:
    """All rows and columns, and the page's main text as ``out``."""
    host = host_of(F.col(url))
    found = written(templates(pages.select(host.alias("host"), F.col(html).alias("html"))), "templates")
    found = found.select(F.col("host").alias("__host"), F.col("tokens").alias("__tokens"))
    joined = _beside(pages, found, host, 8 * F.size("__tokens"))
    bounded_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def text_of(sources: pd.Series, templates: pd.Series) -> pd.Series:
        return pd.Series([main_text(s, set(t) if t is not None else set()) for s, t in zip(sources, templates, strict=True)], dtype=object)

    return joined.withColumn(out, text_of(F.col(html), F.col("__tokens"))).drop("__host", "__tokens")


@query("op6_html_extraction")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of all pages."""
    out = extracted(table(spark, folder, "pages"))
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("bigint").alias("n_chars"))
