"""Top-k of scored listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postledger.functions.scalars import combined_score

# Defaults of a ranking.
MIN_FIT, MIN_DESIRABILITY, LIMIT = 60, 60, 10

# Ranked rows, each with a score in full, that are broadcast.
FEW = 10_000

_GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"
_SALTS = 256


def _order() -> list[Column]:
    """Best first; equal scores are ordered by key."""
    return [F.col("combined_score").desc(), F.col("unique_key").asc()]


def eligible(scores: DataFrame, min_fit: int = MIN_FIT, min_desirability: int = MIN_DESIRABILITY) -> DataFrame:
    """Scores over both thresholds without a hard fail, with their combined score."""
    passing = (
        ~F.col("hard_fail")
        & (F.col("fit_score") >= min_fit)
        & (F.col("desirability_score") >= min_desirability)
    )
    combined = combined_score(F.col("fit_score"), F.col("desirability_score"))
    return scores.where(passing).withColumn("combined_score", combined)


def stored_only(scores: DataFrame, stored: DataFrame, active_only: bool = False) -> DataFrame:
    """Scores whose listing is stored.  Touches only key columns of ``stored``."""
    keys = stored.where("is_active") if active_only else stored
    return scores.join(keys.select("unique_key"), "unique_key", "left_semi")


def top_per_group(rows: DataFrame, group: list[str], limit: int, order: list[Column]) -> DataFrame:
    """The first ``limit`` rows of each group, with their ``rank``.

    Up to a threshold Spark limits groups before the shuffle by itself.  Beyond it a
    salted ranking does the same, so that no task ever sorts a whole hot group.
    """
    if limit > int(rows.sparkSession.conf.get(_GROUP_LIMIT, "1000")):
        salt = F.pmod(F.xxhash64(*rows.columns), F.lit(_SALTS))
        within = Window.partitionBy(*group, "_salt").orderBy(*order)
        salted = rows.withColumn("_salt", salt).withColumn("_row", F.row_number().over(within))
        rows = salted.where(F.col("_row") <= limit).drop("_salt", "_row")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.where(F.col("rank") <= limit)


def best_of_search(
    stored: DataFrame,
    scores: DataFrame,
    search_name: str,
    min_fit: int = MIN_FIT,
    min_desirability: int = MIN_DESIRABILITY,
    limit: int = LIMIT,
    active_only: bool = False,
) -> DataFrame:
    """The best scores of one search.  ``stored`` holds the keys of stored listings."""
    own = eligible(scores.where(F.col("search_name") == search_name), min_fit, min_desirability)
    return stored_only(own, stored, active_only).orderBy(*_order()).limit(limit)


def best_of_all(
    stored: DataFrame,
    scores: DataFrame,
    min_fit: int = MIN_FIT,
    min_desirability: int = MIN_DESIRABILITY,
    limit: int = LIMIT,
    active_only: bool = False,
    searches: Sequence[str] | None = None,
) -> DataFrame:
    """The best scores of every search in one pass, with their ``rank``; of ``searches`` only,
    if they are given by name."""
    if searches is not None:
        scores = scores.where(F.col("search_name").isin(*searches))
    candidates = stored_only(eligible(scores, min_fit, min_desirability), stored, active_only)
    return top_per_group(candidates, ["search_name"], limit, _order())


def with_listings(best: DataFrame, listings: DataFrame, rows: int) -> DataFrame:
    """Ranked scores with their listings.  ``rows`` is the most rows ``best`` can have, by its
    limits; the wide side is neither shuffled nor sorted while they are few."""
    few = F.broadcast(best) if rows <= FEW else best
    return listings.join(few, "unique_key")


def rank_search(listings: DataFrame, scores: DataFrame, search_name: str, limit: int = LIMIT, **options) -> DataFrame:
    """The best listings of one search, best first."""
    best = best_of_search(listings, scores, search_name, limit=limit, **options)
    return with_listings(best, listings, limit).orderBy(*_order()).limit(limit)


def rank_searches(
    listings: DataFrame, scores: DataFrame, searches: Sequence[str], limit: int = LIMIT, **options
) -> DataFrame:
    """The best listings of each of ``searches``, which are given by name."""
    names = sorted(set(searches))
    best = best_of_all(listings, scores, limit=limit, searches=names, **options)
    return with_listings(best, listings, limit * len(names))
