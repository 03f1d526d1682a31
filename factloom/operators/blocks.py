"""Addressed text blocks: normalising, chunking with exact spans, lines, locators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.literals import _CLOSE, _OPEN
from factloom.functions.text import let

SPANS = "array<struct<start:int,stop:int,line:int>>"
LINE_BREAK = r"[\n\r\x0b\x0c\x1c\x1d\x1e\x85\x{2028}\x{2029}]"
_BREAKS = r"\n\r\x0b\x0c\x1c\x1d\x1e\x85\x{2028}\x{2029}"
LINE_END = rf"[{_BREAKS}]+\z"
#: Behind every line break; a carriage return and its newline are one.
LINE_CUT = rf"(?<=[{_BREAKS}])(?<!\r(?=\n))"


def normalise_text(c: Column) -> Column:
    """One kind of line end, no NUL, no trailing blanks, at most one blank line in a row, trimmed."""
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, r"\x00", "")
    c = F.regexp_replace(c, r"(?U)[^\S\n]+(?=\n|\z)", "")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def _spans_at(text: str, cuts) -> list[dict]:
    """Trimmed spans of the pieces ``cuts`` yields, each with its one-based line."""
    out, line, seen = [], 1, 0
    for begin, end in cuts:
        piece = text[begin:end]
        start = begin + len(piece) - len(piece.lstrip())
        stop = begin + len(piece.rstrip())
        if stop > start:
            line += text.count("\n", seen, start)
            seen = start
            out.append({"start": start, "stop": stop, "line": line})
    return out


def _window_cuts(text: str, limit: int):
    """Pieces of at most ``limit`` characters, ended at the last blank or newline of their second half if any."""
    n, begin = len(text), 0
    while begin < n:
        end = min(begin + limit, n)
        if end < n:
            half = begin + limit // 2
            cut = max(text.rfind("\n", half, end), text.rfind(" ", half, end))
            end = cut if cut > begin else end
        yield begin, end
        begin = end
        while begin < n and text[begin].isspace():
            begin += 1


def _line_cuts(text: str, limit: int):
    """Pieces of whole lines; a line longer than ``limit`` is a piece of its own."""
    n, begin = len(text), 0
    while begin < n:
        end = n
        if begin + limit < n:
            end = text.rfind("\n", begin, begin + limit + 1)
            if end <= begin:
                following = text.find("\n", begin + limit)
                end = n if following < 0 else following
        yield begin, end
        begin = end
        while begin < n and text[begin] == "\n":
            begin += 1


def _chunker(cuts, limit: int):
    @F.pandas_udf(SPANS)
    def spans(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if t is None else _spans_at(t, cuts(t, limit)))

    return spans


def _chunk(df: DataFrame, keys: list[str], text: str, spans: Column) -> DataFrame:
    """Only the spans cross to Python and back; the block text is cut out of the row in the JVM."""
    cut = df.select(*keys, F.col(text).alias("_text"), F.posexplode(spans).alias("block_ord", "_s"))
    body = F.substring(F.col("_text"), F.col("_s.start") + 1, F.col("_s.stop") - F.col("_s.start"))
    return cut.select(*keys, "block_ord", F.col("_s.start").alias("start"), F.col("_s.stop").alias("stop"),
                      F.col("_s.line").alias("line_start"), body.alias("text"))


def chunk_text(df: DataFrame, keys: list[str], text: str = "text", limit: int = 1800) -> DataFrame:
    """Blocks of prose; ``text[start:stop]`` of the source is the block, exactly. One row in, no shuffle."""
    if limit < 200:
        raise ValueError("limit is too small")
    return _chunk(df, keys, text, _chunker(_window_cuts, limit)(F.col(text)))


def chunk_lines(df: DataFrame, keys: list[str], text: str = "text", limit: int = 1800) -> DataFrame:
    """Blocks that never split a line."""
    if limit < 200:
        raise ValueError("limit is too small")
    return _chunk(df, keys, text, _chunker(_line_cuts, limit)(F.col(text)))


def newlines(c: Column) -> Column:
    return F.char_length(c) - F.char_length(F.replace(c, F.lit("\n"), F.lit("")))


def span_line(block_text: Column, block_line: Column, start: Column) -> Column:
    """One-based source line of a position in a block."""
    return block_line + newlines(F.left(block_text, start))


def quote_end_line(first: Column, quote: Column) -> Column:
    """Last line of a quote; a trailing newline belongs to the line it ends."""
    last = first + newlines(quote) - F.when(quote.endswith("\n"), 1).otherwise(0)
    return F.greatest(first, last)


def locator_label(line_start: Column, quote: Column, page_label: Column, page_index: Column) -> Column:
    lines = F.concat(F.lit("lines "), line_start.cast("string"), F.lit("-"), (line_start + newlines(quote)).cast("string"))
    page = F.concat(F.lit("page "), F.coalesce(page_label, (F.coalesce(page_index, F.lit(0)) + 1).cast("string")))
    return F.when(line_start.isNotNull(), lines).otherwise(page)


def bounded_quote(text: Column, start: Column, stop: Column, limit: int | None = None) -> Column:
    """The span of a text, or its first ``limit`` characters if a limit is given."""
    length = stop - start
    return F.substring(text, start + 1, length if limit is None else F.least(length, F.lit(limit)))


def located(blocks: DataFrame) -> DataFrame:
    """Adds the text hash and the locator of each block."""
    return blocks.withColumns({
        "text_hash": F.sha2("text", 256),
        "line_end": F.col("line_start") + newlines(F.col("text")),
    })


def text_lines(text: Column) -> Column:
    """``array<struct<start,stop,line,text>>`` of the non-empty lines of one text (line 0-based, blanks trimmed).

    The text is split once and every line measured by itself; only the starts are summed up, so nothing is cut out of the whole text again.
    """
    def placed(pieces: Column) -> Column:
        zero = F.struct(F.lit(0).alias("pos"), F.array().cast("array<int>").alias("out"))
        starts = F.aggregate(pieces, zero, lambda acc, p: F.struct(
            (acc["pos"] + F.char_length(p)).alias("pos"), F.concat(acc["out"], F.array(acc["pos"])).alias("out")), lambda acc: acc["out"])

        def one(s: Column, i: Column) -> Column:
            lead = F.char_length(s["raw"]) - F.char_length(F.ltrim(s["raw"]))
            return let(F.trim(s["raw"]), lambda body: F.struct(
                (s["start"] + lead).alias("start"), (s["start"] + lead + F.char_length(body)).alias("stop"), i.alias("line"), body.alias("text")))

        runs = F.zip_with(pieces, starts, lambda p, at: F.struct(F.regexp_replace(p, LINE_END, "").alias("raw"), at.alias("start")))
        return F.filter(F.transform(runs, one), lambda s: s["text"].rlike(r"(?U)\S"))

    clean = F.translate(text, _OPEN + _CLOSE, "  ")
    return F.when(text.isNotNull(), let(F.split(clean, LINE_CUT), placed))


def source_lines(blocks: DataFrame, keys: list[str], following: bool = False) -> DataFrame:
    """Non-blank lines of blocks with trimmed spans and source line numbers. Blocks are short; no shuffle.

    ``following`` adds ``next_text``, the next non-blank line of the same block.
    """
    lines = text_lines(F.col("text"))
    if following:
        lines = let(lines, lambda a: F.transform(a, lambda s, i: F.struct(
            *[s[c].alias(c) for c in ("start", "stop", "line", "text")], F.get(a, i + 1)["text"].alias("next_text"))))
    exploded = blocks.select(*keys, "line_start", F.explode(lines).alias("s"))
    extra = [F.col("s.next_text").alias("next_text")] if following else []
    return exploded.select(*keys, (F.col("line_start") + F.col("s.line")).alias("line_no"),
                           F.col("s.start").alias("start"), F.col("s.stop").alias("stop"), F.col("s.text").alias("text"), *extra)


def line_citation(rows: DataFrame, lines: DataFrame, file: str = "file_id") -> DataFrame:
    """Each row gets the one line that equals its text (at its line number, where it has one), or ``resolved`` false.

    ``rows`` hold ``row_id, quote, row_line``. Counting is map-side combined, so a text repeated on very many lines
    arrives as one count.
    """
    spots = lines.groupBy(file, F.col("text").alias("quote"), "line_no").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("block_id", "start", "stop")).alias("spot"))
    numbered = rows.where("row_line IS NOT NULL").join(
        spots.withColumnRenamed("line_no", "row_line"), [file, "quote", "row_line"], "left")
    anywhere = spots.groupBy(file, "quote").agg(F.sum("n").alias("n"), F.min("spot").alias("spot"))
    loose = rows.where("row_line IS NULL").join(anywhere, [file, "quote"], "left")
    return numbered.unionByName(loose).select(
        file, "row_id", (F.coalesce("n", F.lit(0)) == 1).alias("resolved"),
        F.when(F.col("n") == 1, F.col("spot")).alias("spot"))


def read_blocks(blocks: DataFrame, files: DataFrame, run_id) -> DataFrame:
    """All blocks of ready files of one run in stable order; vectors live in their own table and are not read."""
    ready = files.where((F.col("status") == "ready") & (F.col("run_id") == run_id))
    return (blocks.where(F.col("run_id") == run_id).join(ready, ["run_id", "file_id"])
            .orderBy("file_ord", "file_id", "block_ord"))


def replace_blocks(stored: DataFrame, fresh: DataFrame, file_keys: list[str]) -> DataFrame:
    """Stored blocks with all blocks of the files in ``fresh`` replaced; running it twice changes nothing."""
    kept = stored.join(fresh.select(*file_keys).distinct(), file_keys, "left_anti")
    return kept.unionByName(fresh)


def attach_vectors(blocks: DataFrame, vectors: DataFrame, config: str) -> DataFrame:
    """Vectors joined to a file's blocks by ordinal, all or nothing per file (the counts must agree)."""
    both = blocks.withColumn("_b", F.lit(True)).join(vectors.withColumn("_v", F.lit(True)), ["file_id", "block_ord"], "full")
    # every block has its vector and every vector its block, none of them twice
    alone = F.count(F.lit(1)).over(Window.partitionBy("file_id", "block_ord")) == 1
    fit = both.withColumn("_fit", F.col("_b").isNotNull() & F.col("_v").isNotNull() & alone)
    whole = fit.withColumn("_whole", F.bool_and("_fit").over(Window.partitionBy("file_id"))).where("_whole")
    return whole.drop("_b", "_v", "_fit", "_whole").withColumns({"dims": F.size("embedding"), "embedding_config": F.lit(config)})


def artifact_complete(files: DataFrame, blocks: DataFrame) -> DataFrame:
    """Per file: stored block count = blocks present = blocks with the current source hash and parser."""
    tally = blocks.join(files.select("file_id", "source_hash", "parser"), "file_id").groupBy("file_id").agg(
        F.count(F.lit(1)).alias("present"),
        F.count_if((blocks["source_hash"] == files["source_hash"]) & (blocks["parser"] == files["parser"])).alias("current"))
    return files.join(tally, "file_id", "left").select(
        "file_id", (F.coalesce("present", F.lit(0)) == F.col("block_count")).alias("count_agrees"),
        ((F.coalesce("present", F.lit(0)) == F.col("block_count"))
         & (F.coalesce("current", F.lit(0)) == F.col("block_count"))).alias("complete"))
