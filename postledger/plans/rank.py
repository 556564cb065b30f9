"""Rankings of the stored scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postledger.config import Search
from postledger.operators.ranking import LIMIT, best_of_all, best_of_search, with_listings
from postledger.tables import SCORE_KEYS, Ledger

# Up to this many keys the listings are looked up by value.
LOOKUP_KEYS = 1000


def rank(ledger: Ledger, search_name: str, limit: int = LIMIT, **options) -> DataFrame:
    """The best listings of one search, best first.  Options as in ``best_of_search``."""
    state = ledger.current_state()
    best = best_of_search(state, ledger.current_score_state(), search_name, limit=limit, **options)
    order = [F.col("combined_score").desc(), F.col("unique_key").asc()]
    return _listings(ledger, best, limit).orderBy(*order).limit(limit)


def rank_all(ledger: Ledger, searches: Sequence[Search], limit: int = LIMIT, **options) -> DataFrame:
    """The best listings of each of ``searches``.  Options as in ``best_of_all``.

    Scores of searches that are no longer configured do not rank.
    """
    names = sorted({search.name for search in searches})
    scores = ledger.current_score_state()
    best = best_of_all(ledger.current_state(), scores, limit=limit, searches=names, **options)
    return _listings(ledger, best, limit * len(names))


def _listings(ledger: Ledger, best: DataFrame, rows: int) -> DataFrame:
    """``best`` with postings, state, and the rest of the scores.

    A short ranking is fetched first, and its keys are pushed into the scans: the files
    are sorted by key, so their column indexes leave a few pages of text to read.
    """
    postings = ledger.current_postings().drop("run")
    state = ledger.current_state().select("unique_key", "last_seen", "is_active")
    scores = ledger.all_scores().select(
        *SCORE_KEYS, "hard_fail_reason", "score_detail", "stage_reached", "scored_at", "parse_ok"
    )
    if rows <= LOOKUP_KEYS:
        found = best.collect()
        best = ledger.spark.createDataFrame(found, best.schema)
        wanted = F.col("unique_key").isin(sorted({row.unique_key for row in found}))
        runs = sorted({row.scored_run for row in found})
        postings, state = postings.where(wanted), state.where(wanted)
        scores = scores.where(wanted & F.col("scored_run").isin(runs))
    ranked = with_listings(with_listings(best, postings, rows), state, rows)
    few = F.broadcast(ranked) if rows <= LOOKUP_KEYS else ranked
    full = scores.join(few, SCORE_KEYS)
    return full.drop("scored_run")
