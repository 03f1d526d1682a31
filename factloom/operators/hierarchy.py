"""Folder expansion, file admission and budget caps."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import vocab
from factloom.session import cut_lineage


def expand_hierarchy(edges: DataFrame, roots: DataFrame, max_depth: int = 5, max_resources: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Breadth-first expansion of a folder tree given as ``(parent_id, id, name, is_folder, trashed)``.

    Returns the resources (depth, path, parent, trashed flag) and the gap rows. A folder is entered once, on its
    first level, so cycles end; folders below ``max_depth`` become ``depth_limit`` gaps. One join per level; lineage is
    cut each time, because plans would otherwise grow with depth.
    """
    frontier = roots.select("id", F.array("name").alias("path"))
    visited = roots.select("id")
    found, gaps, left = [], [], max_resources
    for depth in range(1, max_depth + 2):
        level = edges.join(frontier.select(F.col("id").alias("parent_id"), F.col("path").alias("_up")), "parent_id")
        level = level.select("id", "name", "parent_id", "is_folder", "trashed", F.lit(depth).alias("depth"),
                             F.concat("_up", F.array("name")).alias("path"))
        if left is not None:
            level = level.orderBy("path", "id").limit(left + 1)
        level = cut_lineage(level)
        n = level.count()
        if n == 0:
            break
        full = left is not None and n > left  # with nothing left, one row more is enough to tell that something is missing
        if full:
            gaps.append(level.orderBy(F.desc("path"), F.desc("id")).limit(1).select(
                F.col("parent_id").alias("id"), F.lit(None).cast("string").alias("name"), "path", F.lit("resource_limit").alias("reason")))
            level = cut_lineage(level.orderBy("path", "id").limit(left))
        found.append(level)
        folders = level.where("is_folder AND NOT trashed")
        if depth > max_depth:
            gaps.append(folders.select("id", "name", "path", F.lit("depth_limit").alias("reason")))
            break
        fresh = folders.join(visited, "id", "left_anti").groupBy("id").agg(F.min("path").alias("path"))
        if full:
            break
        if left is not None:
            left -= n
        frontier = cut_lineage(fresh)
        visited = visited.unionByName(frontier.select("id"))
    schema_gap = "id string, name string, path array<string>, reason string"
    empty_gap = edges.sparkSession.createDataFrame([], schema_gap)
    resources = reduce(DataFrame.unionByName, found) if found else edges.limit(0).withColumns(
        {"depth": F.lit(0), "path": F.array().cast("array<string>")})
    casted = [g.select(F.col("id").cast("string").alias("id"), "name", "path", "reason") for g in gaps]
    return resources, reduce(DataFrame.unionByName, casted, empty_gap)


def classify_files(files: DataFrame) -> DataFrame:
    """Admission by MIME type and extension: parser and mode, or the reason for refusal."""
    def column(i: int):
        pairs = [x for mime, spec in vocab.FORMATS.items() for x in (F.lit(mime), F.lit(spec[i]) if i < 2 else F.array(*[F.lit(e) for e in spec[2]]))]
        return F.try_element_at(F.create_map(*pairs), F.col("mime"))

    ext = F.lower(F.regexp_extract("name", r"[^./]+(\.[^./]*)$", 1))
    export = F.col("mime") == vocab.EXPORTED_DOCUMENT
    known = column(0).isNotNull()
    reason = (
        F.when(F.col("mime") == vocab.SHORTCUT, "shortcut_not_followed").when(export, None)
        .when(~known, "unsupported_mime_type").when(~F.array_contains(column(2), ext), "mime_extension_conflict"))
    return files.withColumn("reason", reason).withColumns({
        "parser": F.when(F.col("reason").isNull(), F.when(export, "plain_text").otherwise(column(0))),
        "mode": F.when(F.col("reason").isNull(), F.when(export, "export_text").otherwise(column(1))),
        "status": F.when(F.col("reason").isNull(), "queued").otherwise("unsupported"),
    })


def discovery_summary(sources: DataFrame, gaps: DataFrame) -> DataFrame:
    """Counts per run and the coverage reasons they imply; queued + unsupported + capped = discovered."""
    limits = F.col("reason").isin("depth_limit", "page_limit", "resource_limit")
    g = gaps.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("gaps"), F.bool_or(limits).alias("g_capped"),
        F.bool_or(F.col("reason").isin("inaccessible", "not_found")).alias("g_inaccessible"),
        F.bool_or(F.col("reason").isin("rate_limited", "provider_failure", "pagination_cycle")).alias("g_failed"))
    live = ~F.col("trashed")
    s = sources.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("seen"), F.count_if("trashed").alias("skipped_trashed"), F.count_if(live).alias("discovered"),
        *[F.count_if(live & (F.col("status") == x)).alias(x) for x in ("queued", "unsupported", "capped")])
    j = s.join(g, "run_id", "full_outer").na.fill(0)
    t = lambda c: F.coalesce(c, F.lit(False))
    reasons = F.array_compact(F.array(
        F.when(F.col("unsupported") > 0, "unsupported"), F.when((F.col("capped") > 0) | t(F.col("g_capped")), "capped"),
        F.when(t(F.col("g_inaccessible")), "inaccessible"), F.when(t(F.col("g_failed")), "failed")))
    status = F.when((F.col("gaps") > 0) | (F.col("queued") != F.col("discovered")), "partial").otherwise("complete")
    return j.select("run_id", "seen", "skipped_trashed", "discovered", "queued", "unsupported", "capped",
                    reasons.alias("coverage_reasons"), status.alias("status"))


def apply_caps(files: DataFrame, max_bytes: int, block_cap: int) -> DataFrame:
    """Byte cap, then the block budget of each run: first fit in order, PDFs first; what does not fit is capped whole.

    ``files``: ``(run_id, file_id, ordinal, is_pdf, bytes, n_blocks, used)`` with ``used`` blocks already taken. The
    remaining budget only falls, so among files of one size the accepted ones are a prefix, of at most budget/size files.
    Only those first files per (run, size) can be accepted; they are few (under ``block_cap * (1 + ln block_cap)``), and only
    they are folded in order. Everything else is capped without ever being gathered.
    """
    f = files.withColumn("_o", F.struct((~F.col("is_pdf")).alias("late"), F.col("ordinal"))).withColumn(
        "_start", F.greatest(F.lit(0), F.lit(block_cap) - F.col("used")))
    small = f.where((F.col("bytes") <= max_bytes) & (F.col("n_blocks") > 0) & (F.col("n_blocks") <= F.col("_start")))
    w = Window.partitionBy("run_id", "n_blocks").orderBy("_o")
    able = small.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= block_cap).where(F.col("_r") * F.col("n_blocks") <= F.col("_start"))
    able = able.select("run_id", "file_id", F.col("_o.late").alias("late"), "ordinal", "n_blocks", F.col("_start").alias("start"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["late", "ordinal"], kind="stable")
        left, taken, after = int(pdf["start"].iloc[0]), [], []
        for n in pdf["n_blocks"]:
            fits = n <= left
            left -= int(n) if fits else 0
            taken.append(bool(fits))
            after.append(left)
        return pd.DataFrame({"run_id": pdf["run_id"], "file_id": pdf["file_id"], "late": pdf["late"], "ordinal": pdf["ordinal"],
                             "taken": taken, "after": after})

    run_type = dict(files.dtypes)["run_id"]
    file_type, ord_type = dict(files.dtypes)["file_id"], dict(files.dtypes)["ordinal"]
    folded = able.groupBy("run_id").applyInPandas(
        fold, f"run_id {run_type}, file_id {file_type}, late boolean, ordinal {ord_type}, taken boolean, after int")
    # where the budget is used up, even empty files are capped
    spent = folded.where("taken AND after = 0").groupBy("run_id").agg(F.min(F.struct("late", "ordinal")).alias("_spent"))
    j = f.join(folded.select("run_id", "file_id", "taken"), ["run_id", "file_id"], "left").join(spent, "run_id", "left")
    over = F.col("_spent").isNotNull() & (F.col("_o") > F.col("_spent"))
    outcome = (
        F.when((F.col("_start") == 0) | over, "block_cap").when(F.col("bytes") > max_bytes, "file_size_limit")
        .when(F.col("n_blocks") == 0, "accepted").when(F.coalesce("taken", F.lit(False)), "accepted").otherwise("block_cap"))
    return j.withColumn("outcome", outcome).select(*files.columns, "outcome")
