"""Which listings belong to which search, and the title gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postledger.config import Search
from postledger.functions.prompts import gate_reason
from postledger.functions.text import contains_any
from postledger.operators.bounds import broadcast_within

# Up to this many searches are compiled into one projection of the rows: no join and no
# shuffle.  More are matched once per distinct place, in one pass.
COMPILED_SEARCHES = 200

# Stages of the scoring funnel.
GATE_STAGE, MODEL_STAGE = 1, 3


def in_regions(location: Column, regions: Sequence[str]) -> Column:
    return contains_any(location, regions)


def title_passes(title: Column, keywords: Sequence[str]) -> Column:
    return contains_any(title, keywords)


def match_searches(rows: DataFrame, searches: Sequence[Search]) -> DataFrame:
    """(row, search) for every search whose regions hold the row's location.

    Adds ``search_name``, both current fingerprints and ``title_ok``.  A few searches are
    compiled into one projection.  Beyond that, locations repeat, so the distinct ones are
    matched once, in one pass for all searches: each is cut into its
    substrings of exactly the lengths that region terms have, and an equality join with
    the terms (configuration, broadcast) names the searches it holds.  Rows get them by a
    join on the location; a title is tested against the keywords of its matched searches
    only.  No search is compiled into a plan of its own and nothing is unioned.
    """
    if not searches:
        return _match(rows, [Search("", "")]).where(F.lit(False))
    if len(searches) <= COMPILED_SEARCHES:
        return _match(rows, searches)
    spark = rows.sparkSession
    keyed = rows.withColumn("_place", F.lower(F.coalesce(F.col("location"), F.lit(""))))
    everywhere = [i for i, s in enumerate(searches) if not s.regions or any(not t for t in s.regions)]
    terms = sorted({(t.lower(), i) for i, s in enumerate(searches) if i not in everywhere for t in s.regions})
    places = keyed.select("_place").distinct()
    found = places.select("_place", F.array().cast("array<int>").alias("_hits")).where(F.lit(False))
    if terms:
        place, pieces = F.col("_place"), []
        for size in sorted({len(t) for t, _ in terms}):
            cut = F.transform(F.sequence(F.lit(1), F.length(place) - size + 1), lambda k: F.substring(place, k, size))
            pieces.append(F.when(F.length(place) >= size, cut).otherwise(F.array().cast("array<string>")))
        parts = places.select("_place", F.explode(F.array_distinct(F.flatten(F.array(*pieces)))).alias("_term"))
        index = spark.createDataFrame(terms, "_term string, _search int")
        found = parts.join(F.broadcast(index), "_term").groupBy("_place").agg(F.collect_set("_search").alias("_hits"))
    always = F.lit(everywhere).cast("array<int>") if everywhere else F.array().cast("array<int>")
    hits = places.join(found, "_place", "left").select(
        "_place", F.array_sort(F.array_union(F.coalesce("_hits", F.array().cast("array<int>")), always)).alias("_hits")
    )
    paired = keyed.join(broadcast_within(hits), "_place").withColumn("_search", F.explode("_hits"))
    at = F.col("_search") + 1
    title = F.lower(F.coalesce(F.col("title"), F.lit("")))
    keywords = F.array(*[F.array(*[F.lit(k.lower()) for k in s.title_keywords]).cast("array<string>") for s in searches])
    wanted = F.element_at(keywords, at)
    return paired.select(
        *rows.columns,
        F.element_at(F.array(*[F.lit(s.name) for s in searches]), at).alias("search_name"),
        F.element_at(F.array(*[F.lit(s.profile_hash) for s in searches]), at).alias("profile_hash"),
        F.element_at(F.array(*[F.lit(s.requirements_hash) for s in searches]), at).alias("requirements_hash"),
        ((F.size(wanted) == 0) | F.exists(wanted, lambda k: title.contains(k))).alias("title_ok"),
    )


def _match(rows: DataFrame, searches: Sequence[Search]) -> DataFrame:
    """Searches compiled into one projection of the rows: a generator, no join, no shuffle."""
    hits = [
        F.when(
            in_regions(F.col("location"), search.regions),
            F.struct(
                F.lit(search.name).alias("search_name"),
                F.lit(search.profile_hash).alias("profile_hash"),
                F.lit(search.requirements_hash).alias("requirements_hash"),
                title_passes(F.col("title"), search.title_keywords).alias("title_ok"),
            ),
        )
        for search in searches
    ]
    matched = rows.withColumn("_hit", F.explode(F.array_compact(F.array(*hits))))
    return matched.select(*rows.columns, "_hit.*")


def stale(pairs: DataFrame, scores: DataFrame) -> DataFrame:
    """Pairs without a score under their current fingerprints.

    "No score, or either fingerprint differs" is the same as "no stored row with this
    key, this search and both fingerprints", which is one anti join.
    """
    keys = ["unique_key", "search_name", "profile_hash", "requirements_hash"]
    return pairs.join(scores.select(*keys), keys, "left_anti")


def gate_failures(pairs: DataFrame, searches: DataFrame) -> DataFrame:
    """Score rows of pairs whose title misses every keyword."""
    reasons = searches.select(F.col("name").alias("search_name"), "keyword_list")
    failed = pairs.where(~F.col("title_ok")).join(reasons, "search_name")
    return failed.select(
        "unique_key",
        "search_name",
        F.lit(0).alias("fit_score"),
        F.lit(0).alias("desirability_score"),
        F.lit(True).alias("hard_fail"),
        gate_reason(F.col("title"), F.col("keyword_list")).alias("hard_fail_reason"),
        F.lit("{}").alias("score_detail"),
        F.lit(GATE_STAGE).alias("stage_reached"),
        "profile_hash",
        "requirements_hash",
        F.lit(True).alias("parse_ok"),
    )
