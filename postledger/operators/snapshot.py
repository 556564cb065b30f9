"""Merging full snapshots into state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postledger.operators.bounds import broadcast_within

# What a run did to a row.
NEW, SEEN, REOPENED, CLOSED, KEPT = "new", "seen", "reopened", "closed", "kept"


def one_per_key(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order.

    ``row_number() = 1`` plans as a group limit on both sides of the shuffle, so a key
    with very many copies leaves each task with one row.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_row", F.row_number().over(window)).where("_row = 1").drop("_row")


def first_wins(rows: DataFrame, keys: list[str], ordinal: str = "ordinal") -> DataFrame:
    return one_per_key(rows, keys, F.col(ordinal).asc())


def last_wins(rows: DataFrame, keys: list[str], ordinal: str = "ordinal") -> DataFrame:
    return one_per_key(rows, keys, F.col(ordinal).desc())


def choose_listed(listed: DataFrame, in_region: Column) -> DataFrame:
    """One listed row per key, with ``in_region`` as a column.

    Copies inside the regions are all enriched and the last one counts; without any,
    the first copy counts.
    """
    flagged = listed.withColumn("in_region", in_region)
    preference = F.when(F.col("in_region"), -F.col("ordinal")).otherwise(F.col("ordinal"))
    return one_per_key(flagged, ["unique_key"], F.col("in_region").desc(), preference.asc())


def choose_keys(listed: DataFrame, in_region: Column) -> DataFrame:
    """``choose_listed`` reduced to (unique_key, company, row_id, in_region).

    All buffers are numbers, so this is a hash aggregation with a map-side combine and
    sorts nothing.  The company travels as its length, being the start of the key.
    """
    flagged = listed.select(
        "unique_key", "ordinal", "row_id", F.length("company").alias("_length"), in_region.alias("in_region")
    )
    inside = F.when(F.col("in_region"), F.col("ordinal"))
    picked = flagged.groupBy("unique_key").agg(
        F.bool_or("in_region").alias("in_region"),
        *[F.max_by(name, inside).alias(f"_last_{name}") for name in ("row_id", "_length")],
        *[F.min_by(name, "ordinal").alias(f"_first_{name}") for name in ("row_id", "_length")],
    )
    length = F.coalesce("_last__length", "_first__length")
    return picked.select(
        "unique_key",
        F.substring("unique_key", F.lit(1), length).alias("company"),
        F.coalesce("_last_row_id", "_first_row_id").alias("row_id"),
        "in_region",
    )


def known_keys(state: DataFrame) -> DataFrame:
    """Every stored key, active or not."""
    return state.select("unique_key").distinct()


def new_rows(incoming: DataFrame, state: DataFrame) -> DataFrame:
    """Incoming rows whose key was never stored."""
    return incoming.join(state.select("unique_key"), "unique_key", "left_anti")


def closed_keys(state: DataFrame, incoming: DataFrame, scanned: DataFrame) -> DataFrame:
    """Active keys of completely scanned companies that the snapshot no longer holds."""
    complete = broadcast_within(scanned.where("complete").select("company").distinct())
    active = state.where("is_active").join(complete, "company", "left_semi")
    return active.join(incoming.select("unique_key"), "unique_key", "left_anti").select(
        "unique_key", "company"
    )


def merge_snapshot(
    state: DataFrame, incoming: DataFrame, scanned: DataFrame, run_ts: Column
) -> DataFrame:
    """The next state: insert, touch, close and reopen in one full outer join.

    ``incoming`` holds one row per key (unique_key, company, row_id); ``scanned``
    (company, complete) names the companies of this run, also those that listed
    nothing.  Only complete ones can have rows closed.
    """
    complete = broadcast_within(
        scanned.where("complete").select("company").distinct().withColumn("_scanned", F.lit(True))
    )
    known = state.select("unique_key", "company", "last_seen", "is_active").join(
        complete, "company", "left"
    )
    listed = incoming.select(
        "unique_key", F.col("company").alias("_company"), "row_id", F.lit(True).alias("_listed")
    )
    change = (
        F.when(F.col("company").isNull(), NEW)
        .when(F.col("_listed") & F.col("is_active"), SEEN)
        .when(F.col("_listed"), REOPENED)
        .when(F.col("is_active") & F.col("_scanned"), CLOSED)
        .otherwise(KEPT)
    )
    merged = known.join(listed, "unique_key", "full_outer").withColumn("change", change)
    touched = F.col("change") != KEPT
    return merged.select(
        "unique_key",
        F.coalesce("company", "_company").alias("company"),
        F.when(touched, run_ts).otherwise(F.col("last_seen")).alias("last_seen"),
        F.when(touched, F.col("change") != CLOSED).otherwise(F.col("is_active")).alias("is_active"),
        "change",
        F.when(F.col("change") == NEW, F.col("row_id")).alias("row_id"),
    )
