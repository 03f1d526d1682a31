"""Coverage accounting, file states, integrity constraints, admission windows and case scoring."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import vocab

COUNTS = ("ready", "processing", "failed", "unsupported", "inaccessible", "capped", "unsafe_to_parse")


def _state_flags() -> dict[str, Column]:
    state, code, stage = F.col("status"), F.col("error_code"), F.col("error_stage")
    failed = state.isin(*vocab.FAILED_STATES)
    gone = failed & F.coalesce(code.isin(*vocab.INACCESSIBLE_CODES), F.lit(False))
    unsafe = failed & F.coalesce((stage == "parse") & code.isin(*vocab.UNSAFE_CODES), F.lit(False))
    return {
        "ready": state == "ready",
        "processing": state.isin(*vocab.PENDING_STATES, *vocab.PROCESSING_STATES),
        "failed": failed & ~gone & ~unsafe,
        "unsupported": state == "unsupported",
        "inaccessible": gone,
        "capped": state == "capped",
        "unsafe_to_parse": unsafe,
    }


def coverage_manifest(files: DataFrame, runs: DataFrame) -> DataFrame:
    """Disjoint file counts of each run that add up to what was discovered; the rest is ``unknown_branch``."""
    flags = _state_flags()
    per = files.groupBy("run_id").agg(*[F.count_if(c).alias(n) for n, c in flags.items()])
    j = runs.join(per, "run_id", "left").na.fill(0, list(COUNTS))
    seen = reduce(lambda a, b: a + b, [F.col(c) for c in COUNTS])
    return j.withColumn("unknown_branch", F.greatest(F.lit(0), F.col("discovered") - seen)).withColumn("unstable", F.lit(0).cast("long"))


def coverage_gaps(manifest: DataFrame) -> DataFrame:
    """Ordered reasons why an answer may be incomplete: counted ones, then recorded ones, then an unknown branch."""
    order = ("processing", "failed", "unsupported", "inaccessible", "capped", "unknown_branch", "unstable", "unsafe_to_parse")
    counted = F.array_compact(F.array(*[F.when(F.col(c) > 0, F.lit(c)) for c in order]))
    recorded = F.filter(F.coalesce("gap_reasons", F.array().cast("array<string>")), lambda r: (r != "failed") | (F.col("failed") > 0))
    gaps = F.array_union(counted, recorded)
    explained = F.arrays_overlap(gaps, F.array(*[F.lit(x) for x in ("capped", "inaccessible", "unknown_branch")]))
    tail = F.when(~F.col("discovery_complete") & ~explained, F.array(F.lit("unknown_branch"))).otherwise(F.array().cast("array<string>"))
    return manifest.withColumn("gaps", F.concat(gaps, tail))


def source_issues(files: DataFrame, runs: DataFrame) -> DataFrame:
    """One row per file that is not fine, plus a ``partial_sync`` row for runs still going on."""
    f = _state_flags()
    kind = (
        F.when(f["inaccessible"] & (F.col("error_code") == "not_found"), "missing_file").when(f["inaccessible"], "access_denied")
        .when(f["unsafe_to_parse"], "unsafe_to_parse").when(F.col("status").isin(*vocab.FAILED_STATES), "source_failed")
        .when(F.col("status").isin("capped", "unsupported"), F.col("status")))
    named = files.select("run_id", "source_name", kind.alias("kind")).where("kind IS NOT NULL")
    going = files.groupBy("run_id").agg(F.bool_or(f["processing"]).alias("p"))
    open_runs = runs.join(going, "run_id", "left").where(F.coalesce("p", F.lit(False)) | ~F.col("discovery_complete"))
    return named.unionByName(open_runs.select("run_id", F.lit(None).cast("string").alias("source_name"), F.lit("partial_sync").alias("kind")))


def project_status(c: Column) -> Column:
    """Public state of an internal one; an unknown state is null."""
    out = None
    for internal, public in vocab.PUBLIC_STATE.items():
        out = F.when(c == internal, public) if out is None else out.when(c == internal, public)
    return out


def run_progress(files: DataFrame) -> DataFrame:
    s = project_status(F.col("status"))
    f = files.withColumn("_s", s)
    return f.groupBy("run_id").agg(
        *[F.count_if(F.col("_s") == p).alias(p) for p in ("queued", "parsing", "ready", "failed", "unsupported", "capped")],
        F.coalesce(F.sum(F.when(F.col("_s") == "ready", F.col("n_blocks"))), F.lit(0)).alias("ready_blocks"))


def terminal_status(files: DataFrame, gaps: DataFrame | None = None) -> DataFrame:
    """``ready``, ``partial`` or ``failed`` of a resolved run; ``unresolved`` where files are still open."""
    open_states = (*vocab.PENDING_STATES, *vocab.PROCESSING_STATES, "retryable_failed")
    per = files.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "ready").alias("r"), F.count_if(F.col("status").isin(*open_states)).alias("o"))
    if gaps is not None:
        per = per.join(gaps.select("run_id", "has_gaps"), "run_id", "left")
    has_gaps = F.coalesce(F.col("has_gaps"), F.lit(False)) if gaps is not None else F.lit(False)
    return per.select("run_id", F.when(F.col("o") > 0, "unresolved").when(F.col("r") == 0, "failed")
                      .when((F.col("r") != F.col("n")) | has_gaps, "partial").otherwise("ready").alias("run_status"))


def close_snapshot(files: DataFrame, error_code: str) -> DataFrame:
    """Seal a run: open files become terminal failures at the stage their last state implies; the rest is untouched."""
    state = F.col("status")
    pending, loading = state.isin(*vocab.PENDING_STATES), state == "downloading"
    late = state.isin("parsed", "embedding")
    opened = pending | loading | late
    return files.withColumns({
        "error_code": F.when(opened, error_code).otherwise(F.col("error_code")),
        "error_stage": F.when(pending, "admission").when(loading, "download").when(late, "embedding").otherwise(F.col("error_stage")),
        "status": F.when(opened | (state == "retryable_failed"), "terminal_failed").otherwise(state),
    })


def check_counts(manifest: DataFrame) -> DataFrame:
    """Runs whose counts do not add up to what was discovered."""
    total = reduce(lambda a, b: a + b, [F.col(c) for c in (*COUNTS, "unknown_branch", "unstable")])
    return manifest.where(total != F.col("discovered")).select("run_id", F.lit("counts_do_not_balance").alias("violation"))


def check_spans(citations: DataFrame) -> DataFrame:
    """Citations with an impossible span, a quote of another length, or not exactly one kind of locator."""
    why = F.array_compact(F.array(
        F.when(~(F.col("start") < F.col("stop")), "empty_span"),
        F.when(F.col("stop") - F.col("start") != F.char_length("quote"), "span_length"),
        F.when(F.col("line_start").isNull() == F.col("page_index").isNull(), "locator")))
    return citations.select("citation_id", F.explode(why).alias("violation"))


def check_refs(claims: DataFrame, citations: DataFrame) -> DataFrame:
    """Citations no claim uses, and claims that cite nothing known."""
    used = claims.select("claim_id", "citation_id").distinct()
    unused = citations.join(used, "citation_id", "left_anti").select(F.col("citation_id").cast("string").alias("id"), F.lit("unused_citation").alias("violation"))
    lost = used.join(citations, "citation_id", "left_anti").select(F.col("claim_id").cast("string").alias("id"), F.lit("unresolved_citation").alias("violation"))
    return unused.unionByName(lost.distinct())


def check_transitions(log: DataFrame) -> DataFrame:
    """Illegal state changes in a log of ``(file_id, seq, status, error_stage)``; failures must name a fitting stage."""
    w = Window.partitionBy("file_id").orderBy("seq")
    moves = log.withColumn("previous", F.lag("status").over(w))
    pair = F.concat_ws(">", "previous", "status")
    legal = pair.isin(*[f"{a}>{b}" for a, b in vocab.LEGAL_TRANSITIONS])
    failing = F.col("status").isin(*vocab.FAILED_STATES)
    late = F.col("previous").isin("parsed", "embedding")
    stage_ok = F.when(failing & late, F.col("error_stage") == "embedding").when(
        failing, F.coalesce(F.col("error_stage") != "embedding", F.lit(False))).otherwise(True)
    first_ok = F.col("previous").isNull() & (F.col("status") == "discovered")
    ok = F.when(F.col("previous").isNull(), first_ok).otherwise(legal & F.coalesce(stage_ok, F.lit(False)))
    return moves.where(~ok).select("file_id", "seq", "previous", "status")


def changes_after_publication(log: DataFrame, runs: DataFrame) -> DataFrame:
    """Changes that a published run should have been spared: entries of the files' ``log`` and of the ``runs`` themselves behind the run's first published
    state. Both have ``run_id``, ``seq`` (one count for both) and ``status``, the log also ``file_id``; null there tells the run's own entries."""
    first = runs.where(F.col("status").isin(*vocab.PUBLISHED_STATES)).groupBy("run_id").agg(F.min("seq").alias("published_at"))
    every = log.select("run_id", "file_id", "seq", "status").unionByName(runs.select("run_id", F.lit(None).cast(log.schema["file_id"].dataType).alias("file_id"), "seq", "status"))
    return every.join(first, "run_id").where("seq > published_at").select("run_id", "file_id", "seq", "status", "published_at")


# --- admission ---------------------------------------------------------------------------------------------------
def minute_of(ts: Column) -> Column:
    return F.date_trunc("minute", ts)


def admission(events: DataFrame, user: str, ts: str, tiebreak: str, per_minute: int) -> DataFrame:
    """Fixed one-minute windows per user: the first ``per_minute`` are admitted, the rest told how long to wait.

    The window is one user in one minute, so no user and no minute becomes one task's whole work.
    """
    e = events.withColumn("minute", minute_of(F.col(ts)))
    w = Window.partitionBy(user, "minute").orderBy(ts, tiebreak)
    e = e.withColumn("admitted", F.row_number().over(w) <= per_minute)
    wait = F.lit(60) - F.second(F.col(ts))
    return e.withColumn("retry_after", F.when(~F.col("admitted"), wait.cast("int")))


def admission_tiers(events: DataFrame, user: str, ts: str, tiebreak: str, per_user: int, overall: int) -> DataFrame:
    """A limit per user, then one for everybody counted only over what the first let through.

    Users are many but a minute is one window; to keep it small for the overall ranking, only each user's admitted
    events (at most ``per_user``) take part, pre-ranked inside hashed sub-windows of which ``overall`` rows can matter.
    """
    first = admission(events, user, ts, tiebreak, per_user)
    passed = first.where("admitted").withColumn("_bucket", F.pmod(F.xxhash64(user), F.lit(32)))
    sub = Window.partitionBy("minute", "_bucket").orderBy(ts, tiebreak)
    near = passed.withColumn("_r", F.row_number().over(sub)).where(F.col("_r") <= overall)
    total = Window.partitionBy("minute").orderBy(ts, tiebreak)
    good = near.withColumn("_t", F.row_number().over(total)).where(F.col("_t") <= overall).select(tiebreak, F.lit(True).alias("_in"))
    j = first.join(good, tiebreak, "left")
    return j.withColumn("tier", F.when(~F.col("admitted"), "user_limit").when(F.col("_in"), "admitted").otherwise("overall_limit")).drop("_in", "admitted", "retry_after")


def admission_after(events: DataFrame, user: str, ts: str, tiebreak: str, per_user: int, overall: int, seen: DataFrame) -> DataFrame:
    """``admission_tiers`` for events that come behind others: ``seen`` has ``scope`` (``user`` or ``all``), ``who``, ``minute`` and ``n``, the events of a user
    and the events that the first limit let through, so far. Each event gets its ``minute``, its ``tier`` and, if refused, ``retry_after`` in seconds.

    The counters meet the events by user and minute before they are numbered; a minute of which everything has been given out costs no ranking.
    """
    e = events.withColumn("minute", minute_of(F.col(ts)))
    own = seen.where("scope = 'user'").select(F.col("who").alias("_who"), F.col("minute").alias("_minute"), F.col("n").alias("_n"))
    w = Window.partitionBy(user, "minute").orderBy(ts, tiebreak)
    first = e.join(own, F.col(user).cast("string").eqNullSafe(F.col("_who")) & F.col("minute").eqNullSafe(F.col("_minute")), "left").drop("_who", "_minute")
    first = first.withColumn("_passed", F.row_number().over(w) + F.coalesce("_n", F.lit(0)) <= per_user).drop("_n")
    given = seen.where("scope = 'all'").select(F.col("minute").alias("_minute"), F.col("n").alias("_n"))
    passed = first.where("_passed").select(user, ts, tiebreak, "minute").join(given, F.col("minute").eqNullSafe(F.col("_minute")), "left").withColumn(
        "_left", F.lit(overall) - F.coalesce("_n", F.lit(0))).where("_left > 0")
    sub = Window.partitionBy("minute", F.pmod(F.xxhash64(user), F.lit(32))).orderBy(ts, tiebreak)
    near = passed.withColumn("_r", F.row_number().over(sub)).where(F.col("_r") <= F.col("_left"))
    total = Window.partitionBy("minute").orderBy(ts, tiebreak)
    good = near.withColumn("_t", F.row_number().over(total)).where(F.col("_t") <= F.col("_left")).select(tiebreak, F.lit(True).alias("_in"))
    j = first.join(good, tiebreak, "left")
    tier = F.when(~F.col("_passed"), "user_limit").when(F.col("_in"), "admitted").otherwise("overall_limit")
    return j.withColumn("tier", tier).withColumn("retry_after", F.when(F.col("tier") != "admitted", (F.lit(60) - F.second(F.col(ts))).cast("int"))).drop("_passed", "_in")


def seen_in(decided: DataFrame, user: str) -> DataFrame:
    """The counters (``scope``, ``who``, ``minute``, ``n``) that decided events add to."""
    by_user = decided.groupBy(F.lit("user").alias("scope"), F.col(user).cast("string").alias("who"), "minute").agg(F.count(F.lit(1)).alias("n"))
    passed = decided.where("tier <> 'user_limit'").groupBy(F.lit("all").alias("scope"), F.lit(None).cast("string").alias("who"), "minute").agg(F.count(F.lit(1)).alias("n"))
    return by_user.unionByName(passed)


# --- evaluation --------------------------------------------------------------------------------------------------
def score_cases(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Per case: right values (as a bag), sound citations, right policy version, right uncertainty, all of them."""
    e = expected.select("case_id", F.col("status").alias("want_status"), F.col("policy").alias("want_policy"), F.col("values").alias("want_values"))
    j = e.join(actual, "case_id", "left")
    t = lambda c: F.coalesce(c, F.lit(False))
    unsure = lambda c: c.isin("insufficient", "coverage_limited")
    j = j.withColumns({
        "accuracy": t((F.array_sort("values") == F.array_sort("want_values")) & (F.col("status") == F.col("want_status"))),
        "citations": t(F.col("citations_ok")),
        "policy_ok": t(F.col("policy") == F.col("want_policy")),
        "uncertainty": t(unsure(F.col("status")) == unsure(F.col("want_status"))),
    })
    return j.select("case_id", "accuracy", "citations", "policy_ok", "uncertainty",
                    (F.col("accuracy") & F.col("citations") & F.col("policy_ok") & F.col("uncertainty")).alias("all_ok"))


#: Lines to one address of a block; a citation meets the blocks that share the address of its line.
LINES_PER_ADDRESS = 64


def found_in_source(citations: DataFrame, corpus: DataFrame) -> DataFrame:
    """``citation_id`` and ``found``: do the words stand in some block of the named source, at the stated span and line?

    ``citations`` has ``citation_id``, ``source``, ``quote``, ``start``, ``stop`` and ``line_start``, ``corpus`` has ``block_id``, ``source``, ``line_start``
    and ``text``. A source may have any number of blocks: citation and block meet on source and line address, without the text, which is then read only
    for the blocks met.
    """
    from factloom.operators.blocks import newlines, span_line

    def address(line: Column) -> Column:
        return F.floor(line / LINES_PER_ADDRESS).cast("long")

    last = F.col("line_start") + newlines(F.col("text"))
    places = corpus.where("text IS NOT NULL AND line_start IS NOT NULL").select("block_id", "source", F.col("line_start").alias("_first"), last.alias("_last"))
    places = places.withColumn("_address", F.explode(F.sequence(address(F.col("_first")), address(F.col("_last")))))
    sound = citations.where((F.col("start") >= 0) & (F.col("stop") - F.col("start") == F.char_length("quote")) & (F.char_length("quote") > 0) & (F.col("line_start") > 0))
    met = sound.withColumn("_address", address(F.col("line_start"))).join(places, ["source", "_address"]).where(
        F.col("line_start").between(F.col("_first"), F.col("_last"))).select("citation_id", "block_id", "quote", "start", "stop", "line_start", "_first")
    there = met.join(corpus.select("block_id", "text"), "block_id").where(
        (F.substring(F.col("text"), F.col("start") + 1, F.col("stop") - F.col("start")) == F.col("quote"))
        & (span_line(F.col("text"), F.col("_first"), F.col("start")) == F.col("line_start"))).select("citation_id").distinct()
    return citations.select("citation_id").join(there.withColumn("found", F.lit(True)), "citation_id", "left").select(
        "citation_id", F.coalesce("found", F.lit(False)).alias("found"))


def citation_integrity(cases: DataFrame, claims: DataFrame, citations: DataFrame, corpus: DataFrame) -> DataFrame:
    """Per case the sorted codes of what is wrong with its citations, and ``citations_ok`` where there are none: the input of ``score_cases``, computed.

    ``cases`` has ``case_id``, ``sources`` (names that must be cited) and ``mode`` (``required``, ``forbidden`` or ``optional``), ``claims`` has ``case_id``,
    ``claim_id`` and ``value`` (null: none stated), ``citations`` besides the columns of ``found_in_source`` ``case_id`` and ``claim_id``. A value is supported
    if one of the claim's citations holds it in its ``quote`` (or ``raw`` or ``norm``, where given), whatever the case of its letters. Claims and citations are counted per claim, then per case, so a case of any
    size is combined inside the tasks.
    """
    from factloom.functions.text import fold

    value = claims.select("case_id", "claim_id", fold(F.col("value")).alias("_value"))
    held = citations.join(found_in_source(citations, corpus), "citation_id").join(value, ["case_id", "claim_id"], "left")
    held_in = [F.coalesce(F.contains(fold(F.col(c)), F.col("_value")), F.lit(False)) for c in ("quote", "raw", "norm") if c in citations.columns]
    holds = reduce(lambda a, b: a | b, held_in, F.col("_value").isNull())
    per_claim = held.withColumn("_holds", holds).groupBy("case_id", "claim_id").agg(
        F.bool_and("found").alias("found"), F.bool_or("_holds").alias("supported"),
        F.collect_set("source").alias("named"))
    cited = per_claim.groupBy("case_id").agg(F.bool_and("found").alias("found"), F.array_distinct(F.flatten(F.collect_set("named"))).alias("named"))
    said = claims.join(per_claim.select("case_id", "claim_id", "supported"), ["case_id", "claim_id"], "left").groupBy("case_id").agg(
        F.bool_or(F.col("supported").isNull()).alias("bare"), F.bool_or(~F.coalesce("supported", F.lit(True))).alias("unsupported"))
    j = cases.join(cited, "case_id", "left").join(said, "case_id", "left")
    no = F.lit(False)
    codes = F.array_compact(F.array(
        F.when(~F.coalesce("found", F.lit(True)), "not_in_source"), F.when(F.coalesce("bare", no), "claim_without_citation"),
        F.when(F.coalesce("unsupported", no), "value_without_support"),
        F.when(F.size(F.array_except(F.coalesce("sources", F.array().cast("array<string>")), F.coalesce("named", F.array().cast("array<string>")))) > 0, "source_missing"),
        F.when((F.col("mode") == "required") & F.col("bare").isNull(), "claim_missing"), F.when((F.col("mode") == "forbidden") & F.col("found").isNotNull(), "citation_forbidden")))
    return j.select("case_id", F.array_sort(codes).alias("codes"), (F.size(codes) == 0).alias("citations_ok"))


def score_means(scores: DataFrame) -> DataFrame:
    return scores.agg(*[F.avg(F.col(c).cast("int")).alias(c) for c in ("accuracy", "citations", "policy_ok", "uncertainty", "all_ok")])


def verify_citations(citations: DataFrame, corpus: DataFrame) -> DataFrame:
    """Does ``text[start:stop]`` equal the quote, and is the line number right? Checked against the stored text."""
    from factloom.operators.blocks import newlines

    j = citations.join(corpus.select("file_id", "text"), "file_id", "left")
    same = F.substring("text", F.col("start") + 1, F.col("stop") - F.col("start")) == F.col("quote")
    line = (newlines(F.left(F.col("text"), F.col("start"))) + 1) == F.col("line_start")
    return j.select("citation_id", F.coalesce(same, F.lit(False)).alias("quote_ok"), F.coalesce(line, F.lit(False)).alias("line_ok"))


def regression_diff(actual: DataFrame, expected: DataFrame, observed: list[str]) -> DataFrame:
    """Every case with its verdict: pass, fail (any observation differs), missing, unexpected, or duplicated."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("case_id").agg(F.count(F.lit(1)).alias(f"n_{name}"), F.min(F.struct(*observed)).alias(name))

    j = side(actual, "actual").join(side(expected, "expected"), "case_id", "full_outer")
    verdict = (
        F.when(F.col("n_actual").isNull(), "missing").when(F.col("n_expected").isNull(), "unexpected")
        .when((F.col("n_actual") > 1) | (F.col("n_expected") > 1), "duplicated")
        .when(F.col("actual").eqNullSafe(F.col("expected")), "pass").otherwise("fail"))
    return j.select("case_id", verdict.alias("verdict"))
