"""Counts of stored rows and of what a run did."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postledger.operators.snapshot import CLOSED, NEW, REOPENED


def counts(state: DataFrame) -> DataFrame:
    """Stored and active rows, in one scan."""
    return state.agg(F.count("*").alias("total"), F.count_if("is_active").alias("active"))


def listing_report(listed: DataFrame, in_region: Column) -> DataFrame:
    """Per company: rows listed, rows in the regions, rows without an id."""
    return listed.groupBy("company").agg(
        F.count("*").alias("listed"),
        F.count_if(in_region).alias("region_matched"),
        F.count_if(F.col("ats_job_id") == "").alias("missing_id"),
    )


def change_report(state: DataFrame) -> DataFrame:
    """Per company: keys the run stored first, reopened and closed."""
    return state.groupBy("company").agg(
        F.count_if(F.col("change") == NEW).alias("new"),
        F.count_if(F.col("change") == REOPENED).alias("reopened"),
        F.count_if(F.col("change") == CLOSED).alias("closed"),
    )


def search_report(fresh: DataFrame) -> DataFrame:
    """Per search and stage: pairs processed, and those that failed a hard requirement."""
    return fresh.groupBy("search_name", "stage_reached").agg(
        F.count("*").alias("processed"),
        F.count_if("hard_fail").alias("hard_failed"),
        F.count_if(~F.col("parse_ok")).alias("unreadable"),
    )
