"""One scoring run: every search over every stale listing."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postledger.config import Search, searches_frame, select_searches
from postledger.operators.matching import MODEL_STAGE, gate_failures, match_searches, stale
from postledger.operators.bounds import broadcast_within
from postledger.operators.reports import search_report
from postledger.operators.scoring import (
    ANSWER_KEYS,
    ScoreBatch,
    ask,
    offline_scorer,
    read_answers,
    render_prompts,
    upsert_scores,
)
from postledger.operators.snapshot import REOPENED
from postledger.tables import Ledger

# Columns that decide staleness; the description is not among them.
_NARROW = ["unique_key", "title", "location", "stored_run"]


def score(
    ledger: Ledger,
    searches: Sequence[Search],
    run_ts: datetime,
    score_batch: ScoreBatch = offline_scorer,
    target: str | None = None,
    tasks: int | None = None,
    incremental: bool = True,
) -> DataFrame:
    """Score what has no current score, for all searches or for ``target``; returns the report.

    A search whose fingerprints and regions are those of its high-water mark matches only
    postings stored by later sync runs, postings reopened since, and the pairs the last
    scoring run left without a score; any other search matches all postings.  Both give
    the same stale pairs (``incremental=False`` matches everything, for comparison).
    Stale pairs are found on narrow columns.  Only pairs that pass the title gate fetch
    their text, and only from the sync runs that stored them.  Answers are written
    before anything is done with them: a repeated run asks only for what is missing.
    Prompts whose model call fails get no score, are counted in the report, and are asked
    again by the next run.  ``tasks`` bounds how many calls run at a time.
    """
    chosen = select_searches(searches, target)
    spark, run = ledger.spark, ledger.last_scoring() + 1
    frame = searches_frame(spark, chosen)
    previous = ledger.current_score_state()

    postings = ledger.current_postings().withColumnRenamed("run", "stored_run")
    active = ledger.current_state().where("is_active").select("unique_key")
    candidates = postings.where("has_description").select(*_NARROW).join(active, "unique_key", "left_semi")
    marks = _marks(ledger) if incremental else {}
    found = stale(_unmatched(ledger, candidates, active, chosen, marks), previous).drop("location")
    pairs = ledger.pairs.write(found, run)

    passed = pairs.where("title_ok").select(*ANSWER_KEYS, "stored_run")
    attempts = ledger.answers(run)
    attempt = max(attempts.runs(), default=0) + 1
    asked = attempts.read_until(attempt).where("error IS NULL").select(*ANSWER_KEYS)
    missing = passed.join(asked, ANSWER_KEYS, "left_anti")
    # One number per sync run, so that only those runs' texts are read.
    stored = [row.stored_run for row in missing.select("stored_run").distinct().collect()]
    texts = postings.where(F.col("stored_run").isin(stored)).drop("stored_run")
    prompts = render_prompts(missing.join(texts, "unique_key"), frame)
    written = attempts.write(ask(prompts, score_batch, tasks), attempt)

    # A dead run may have asked under other settings; only what passes now counts.
    answers = attempts.read_until(attempt).where("error IS NULL").join(passed.select(*ANSWER_KEYS), ANSWER_KEYS, "left_semi")
    fresh = ledger.scores.write(
        gate_failures(pairs, frame)
        .unionByName(read_answers(answers))
        .withColumn("scored_at", F.lit(run_ts))
        .sortWithinPartitions("unique_key"),
        run,
    )
    current = fresh.withColumn("scored_run", F.lit(run)).select(*previous.columns)
    ledger.score_state.write(upsert_scores(previous, current), run)
    _write_marks(ledger, chosen, marks, run)
    failed = written.where("error IS NOT NULL").select("search_name", F.lit(MODEL_STAGE).alias("stage_reached"))
    failed = failed.groupBy("search_name", "stage_reached").agg(F.count("*").alias("failed_calls"))
    # At most a row per search and stage on either side.
    report = search_report(fresh).join(failed, ["search_name", "stage_reached"], "full")
    counts = ("processed", "hard_failed", "unreadable", "failed_calls")
    return ledger.score_report.write(
        report.select("search_name", "stage_reached", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts]), run
    )


Mark = tuple[str, str, str, int, int]


def _marks(ledger: Ledger) -> dict[str, Mark]:
    """The high-water mark of every search: fingerprints, regions, sync run and the scoring
    run that matched it.  One row per configured search."""
    rows = ledger.score_marks.read(ledger.last_scoring()).collect()
    return {r.search_name: tuple(r)[1:] for r in rows}


def _mark_of(search: Search, marks: dict[str, Mark]) -> tuple[int, int]:
    """(sync run, scoring run) through which ``search`` has matched everything as it is now;
    (0, 0): none."""
    mark = marks.get(search.name)
    if mark is None or mark[:3] != (search.profile_hash, search.requirements_hash, search.regions_hash):
        return 0, 0
    return mark[3], mark[4]


def _unmatched(ledger: Ledger, candidates: DataFrame, active: DataFrame, chosen: Sequence[Search], marks) -> DataFrame:
    """(posting, search) pairs that no committed scoring run has matched as they are now.

    Searches are grouped by their mark.  A group reads the postings of later sync runs
    only (a filter on the run directories), those reopened since its mark, and the pairs
    its last scoring run left, if still active (those scored drop out in the staleness
    check; their location is not needed).  The parts are disjoint, so no pair is found
    twice.
    """
    groups: dict[tuple[int, int], list[Search]] = {}
    for search in chosen:
        groups.setdefault(_mark_of(search, marks), []).append(search)
    last_sync, parts = ledger.last_sync(), []
    for (mark, scoring), searches in sorted(groups.items()):
        if mark == 0:
            parts.append(match_searches(candidates, searches))
            continue
        parts.append(match_searches(candidates.where(F.col("stored_run") > mark), searches))
        pending = _pending(ledger, searches, scoring).join(active, "unique_key", "left_semi")
        pending = pending.withColumn("location", F.lit(None).cast("string"))
        reopened = [
            ledger.state.read(sync).where(F.col("change") == REOPENED).select("unique_key")
            for sync in range(mark + 1, last_sync + 1)
        ]
        keys = reduce(DataFrame.unionByName, reopened).distinct() if reopened else None
        # Earlier postings are read only where some were reopened; the state is narrow.
        if keys is not None and not keys.isEmpty():
            keys = broadcast_within(keys)
            earlier = candidates.where(F.col("stored_run") <= mark).join(keys, "unique_key", "left_semi")
            parts.append(match_searches(earlier, searches))
            pending = pending.join(keys, "unique_key", "left_anti")
        parts.append(pending)
    if not parts:
        return match_searches(candidates, [])
    return reduce(lambda a, b: a.unionByName(b), parts)


def _pending(ledger: Ledger, searches: Sequence[Search], scoring: int) -> DataFrame:
    """Pairs that scoring run ``scoring`` found for ``searches``, under their current
    fingerprints."""
    current = ledger.spark.createDataFrame(
        [(s.name, s.profile_hash, s.requirements_hash) for s in searches],
        "search_name STRING, profile_hash STRING, requirements_hash STRING",
    )
    # One row per search: configuration, broadcast by its exact size.
    keys = ["search_name", "profile_hash", "requirements_hash"]
    return ledger.pairs.read(scoring).join(F.broadcast(current), keys, "left_semi")


def _write_marks(ledger: Ledger, chosen: Sequence[Search], marks, run: int) -> None:
    """Chosen searches have now matched everything through the last sync run; the marks of
    other searches stay as they were."""
    through = ledger.last_sync()
    rows = {name: (name, *mark) for name, mark in marks.items()}
    for search in chosen:
        rows[search.name] = (
            search.name, search.profile_hash, search.requirements_hash, search.regions_hash, through, run,
        )
    ledger.score_marks.write(ledger.spark.createDataFrame(list(rows.values()), ledger.score_marks.schema), run)
