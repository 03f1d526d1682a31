"""Tables inside documents and table artifacts: detection, row/cell forms, profiles, acceptance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import field_id, let, squash
from factloom.functions.typing import typed_cell
from factloom.operators.blocks import LINE_BREAK


def delimiter(text: Column) -> Column:
    """Tab wins; two pipes or more make a pipe row; otherwise null."""
    pipes = F.char_length(text) - F.char_length(F.replace(text, F.lit("|"), F.lit("")))
    return F.when(text.contains("\t"), F.lit("\t")).when(pipes >= 2, F.lit("|"))


def split_cells(text: Column, delim: Column) -> Column:
    """Cells of a row with whitespace collapsed; outer pipes are borders."""
    bare = F.when(delim == "|", F.regexp_replace(F.trim(text), r"^\|+|\|+$", "")).otherwise(F.trim(text))
    return F.transform(F.when(delim == "|", F.split(bare, r"\|", -1)).otherwise(F.split(bare, "\t", -1)), squash)


def is_divider(cells: Column) -> Column:
    return F.forall(cells, lambda c: c.rlike("^:?-{3,}:?$"))


def detect_text_tables(lines: DataFrame, file: str = "file_id") -> DataFrame:
    """Rows of the tables found among the non-blank lines of documents.

    A table is a maximal run of consecutive lines with the same delimiter, at least a header of two non-blank cells
    and one more line; the line before is its title; a divider after the header is skipped; rows of another width are
    ``malformed``. Runs are found by a running sum over each document's lines (one document is one text, so the
    window is bounded by what fits into a text value).
    """
    w = Window.partitionBy(file).orderBy("line_no")
    marked = lines.withColumn("delim", delimiter(F.col("text")))
    marked = marked.withColumn("_prev", F.lag("delim").over(w)).withColumn("_before", F.lag("text").over(w))
    starts = F.coalesce(F.col("delim") != F.col("_prev"), F.lit(True))
    runs = marked.withColumn("_run", F.sum(F.when(starts, 1).otherwise(0)).over(w)).where("delim IS NOT NULL")
    rows = runs.withColumn("cells", split_cells(F.col("text"), F.col("delim")))
    first = F.struct("line_no", "cells", F.when(F.col("_prev").isNull(), F.col("_before")).alias("title"))
    heads = rows.groupBy(file, "_run").agg(
        F.min_by(first, "line_no").alias("head"), F.count(F.lit(1)).alias("n_lines"))
    joined = rows.join(heads, [file, "_run"])
    r = Window.partitionBy(file, "_run").orderBy("line_no")
    joined = joined.withColumn("_i", F.row_number().over(r)).withColumn(
        "_divider", (F.col("_i") == 2) & (F.size("cells") == F.size("head.cells")) & is_divider(F.col("cells")))
    good_head = (F.size("head.cells") >= 2) & ~F.exists("head.cells", lambda c: c == "")
    body = joined.where(good_head & (F.col("_i") > 1) & ~F.col("_divider"))
    return body.select(
        file, F.col("head.line_no").alias("table_line"), F.col("head.title").alias("title"),
        F.col("head.cells").alias("headers"), "line_no", "cells",
        (F.size("cells") != F.size("head.cells")).alias("malformed"))


def text_tables(texts: DataFrame, file: str = "file_id", text: str = "text") -> DataFrame:
    """The rows of ``detect_text_tables`` straight from whole texts, without a shuffle or a sort.

    The lines of a text are one array; a run begins where the delimiter changes, and the runs are slices between two beginnings, so the work grows with
    the lines. Only runs that are tables leave their row. Texts that share an id are not one text; a null or empty one has no table.
    """
    likely = texts.where(F.col(text).contains("\t") | F.col(text).rlike(r"\|[^\n\r]*\|"))
    numbered = F.transform(F.split(F.col(text), rf"\r\n|{LINE_BREAK}"), lambda x, i: F.struct((i + 1).alias("line_no"), F.trim(x).alias("text"), delimiter(x).alias("delim")))
    filled = F.filter(numbered, lambda s: s["text"].rlike(r"(?U)\S"))

    def tables_of(lines: Column) -> Column:
        changes = F.filter(F.transform(lines, lambda s, i: F.when(
            (i == 0) | ~s["delim"].eqNullSafe(F.get(lines, F.greatest(i - 1, F.lit(0)))["delim"]), i)), lambda i: i.isNotNull())
        return let(F.concat(changes, F.array(F.size(lines))), lambda at: F.transform(F.filter(
            F.transform(F.slice(at, 1, F.size(at) - 1), lambda first, j: F.struct(first.alias("first"), (F.get(at, j + 1) - first).alias("n"))),
            lambda s: F.get(lines, s["first"])["delim"].isNotNull() & (s["n"] > 1)), lambda s: run_of(lines, s["first"], s["n"])))

    def run_of(lines: Column, first: Column, n: Column) -> Column:
        head, before = F.get(lines, first), F.when(first > 0, F.get(lines, F.greatest(first - 1, F.lit(0))))
        return F.struct(head["line_no"].alias("table_line"), F.when(before["delim"].isNull(), before["text"]).alias("title"),
                        split_cells(head["text"], head["delim"]).alias("headers"), F.slice(lines, first + 2, n - 1).alias("rows"))

    runs = likely.select(file, F.explode(let(filled, tables_of)).alias("_run")).select(file, "_run.*")
    headed = runs.select(file, "table_line", "title", "headers", F.posexplode("rows").alias("_i", "_row"))
    body = headed.where((F.size("headers") >= 2) & ~F.exists("headers", lambda c: c == "")).select(
        file, "table_line", "title", "headers", F.col("_row.line_no").alias("line_no"), split_cells(F.col("_row.text"), F.col("_row.delim")).alias("cells"), "_i")
    malformed = F.size("cells") != F.size("headers")
    return body.where((F.col("_i") > 0) | malformed | ~is_divider(F.col("cells"))).drop("_i").withColumn("malformed", malformed)


def wide_to_cells(df: DataFrame, table: Column, row_ord: Column, columns: list[str]) -> DataFrame:
    """One row per cell with ordinals and field ids."""
    cells = [F.struct(F.lit(i + 1).alias("col_ord"), F.lit(c).alias("header"), F.col(c).cast("string").alias("raw"))
             for i, c in enumerate(columns)]
    long = df.select(table.alias("table_id"), row_ord.alias("row_ord"), F.inline(F.array(*cells)))
    return long.withColumn("field_id", field_id(F.col("header")))


def cells_to_wide(cells: DataFrame, fields: list[str]) -> DataFrame:
    """The row form back from cells; the field list is known, so there is no extra pass to find it."""
    picks = [F.max(F.when(F.col("field_id") == f, F.col("raw"))).alias(f) for f in fields]
    return cells.groupBy("table_id", "row_ord").agg(*picks)


def profile_tables(cells: DataFrame, malformed: DataFrame | None = None) -> DataFrame:
    """Per table: columns, duplicate field ids, columns of mixed kinds, malformed rows, completeness, codes.

    Kinds are counted per (table, column, kind) first, so huge tables are combined before the shuffle.
    """
    typed = cells.withColumn("kind", typed_cell(F.col("raw"))["kind"])
    kinds = typed.groupBy("table_id", "col_ord", "field_id", "kind").agg(F.count(F.lit(1)).alias("n"))
    columns = kinds.groupBy("table_id", "col_ord", "field_id").agg(
        F.count_if(F.col("kind") != "null").alias("kinds"), F.sum("n").alias("cells"))
    ids = columns.groupBy("table_id", "field_id").agg(
        F.count(F.lit(1)).alias("same_id"), F.count_if(F.col("kinds") > 1).alias("mixed"))
    tables = ids.groupBy("table_id").agg(
        F.sum("same_id").alias("n_columns"), F.count_if(F.col("same_id") > 1).alias("duplicate_ids"),
        F.sum("mixed").alias("mixed_columns"))
    if malformed is not None:
        tables = tables.join(malformed, "table_id", "left")
    else:
        tables = tables.withColumn("malformed_rows", F.lit(0))
    bad = F.coalesce(F.col("malformed_rows"), F.lit(0))
    codes = F.array_compact(F.array(
        F.when(F.col("duplicate_ids") > 0, "duplicate_normalized_field_identifier"),
        F.when(bad > 0, "malformed_row_shape"),
        F.when(F.col("mixed_columns") > 0, "mixed_inferred_column_types")))
    return tables.select("table_id", "n_columns", "duplicate_ids", "mixed_columns", bad.alias("malformed_rows"),
                         (bad == 0).alias("complete"), codes.alias("ambiguity_codes"))


def accept_artifact(artifacts: DataFrame, files: DataFrame, schema_version: str) -> DataFrame:
    """Complete artifacts whose schema, parser and source hash agree with the file; the first writer of a table wins."""
    agreed = artifacts.where((F.col("schema_version") == schema_version) & F.col("complete")).join(
        files.select("file_id", "source_hash", "parser"), ["file_id", "source_hash", "parser"])
    rest = [c for c in agreed.columns if c not in ("file_id", "table_id")]
    first = agreed.groupBy("file_id", "table_id").agg(F.min_by(F.struct(*rest), "written_at").alias("_a"))
    return first.select("file_id", "table_id", "_a.*")


ARTIFACT = "struct<headers:array<string>,rows:array<struct<ordinal:int,values:array<string>>>,title:string>"


def load_artifact_json(df: DataFrame, key: list[str], column: str) -> DataFrame:
    """Cells of table artifacts stored as JSON; rows of the wrong width and unreadable artifacts are kept and counted."""
    parsed = df.withColumn("_a", F.from_json(F.col(column), ARTIFACT))
    ok = F.col("_a.headers").isNotNull() & (F.size("_a.headers") >= 2)
    rows = parsed.select(*key, ok.alias("readable"), F.col("_a.headers").alias("headers"),
                         F.explode_outer("_a.rows").alias("_r"))
    return rows.select(
        *key, "readable", "headers", F.col("_r.ordinal").alias("row_ord"), F.col("_r.values").alias("values"),
        (~F.col("readable") | F.coalesce(F.size("_r.values") != F.size("headers"), F.lit(True))).alias("malformed"))


def artifact_cells(rows: DataFrame, key: list[str]) -> DataFrame:
    good = rows.where(~F.col("malformed"))
    return good.select(*key, "row_ord", F.posexplode(F.arrays_zip("headers", "values")).alias("col_ord", "c")).select(
        *key, "row_ord", (F.col("col_ord") + 1).alias("col_ord"), F.col("c.headers").alias("header"),
        F.col("c.values").alias("raw"))
