"""One synchronisation run: landed documents in, next state out.

The wide text of a listing that is already stored is never shuffled.  Documents are
parsed once into a staged Parquet table; which rows are new is decided on narrow
columns; only the new rows fetch their text and pay for HTML stripping.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postledger import schemas
from postledger.config import Company, companies_frame
from postledger.functions.text import strip_html
from postledger.operators.bounds import broadcast_within
from postledger.operators.enrich import enrich
from postledger.operators.matching import in_regions
from postledger.operators.reports import change_report, listing_report
from postledger.operators.snapshot import NEW, choose_keys, merge_snapshot
from postledger.sources import (
    completeness,
    details_from_bodies,
    items_from_bodies,
    normalise,
    read_details,
    read_items,
    source,
    union_sources,
)
from postledger.sources.landing import detail_path, listing_path, path_exists
from postledger.tables import Ledger


def sync(
    ledger: Ledger,
    landed_run: str,
    companies: Sequence[Company],
    regions: Sequence[str],
    run_ts: datetime,
) -> DataFrame:
    """Synchronise with the documents below ``landed_run``; returns the run's report.

    A company without a landed listing, or with an incomplete one, keeps its rows.
    """
    spark = ledger.spark
    configured = companies_frame(spark, companies)
    used = [source(name) for name in sorted({company.ats for company in companies})]
    landed = [entry for entry in used if path_exists(spark, listing_path(landed_run, entry))]
    if not landed:
        raise ValueError(f"no landed listings of the configured companies below {landed_run}")
    listed = [normalise(read_items(spark, landed_run, entry), entry, configured) for entry in landed]
    details = [
        read_details(spark, landed_run, entry)
        for entry in landed
        if entry.detail and path_exists(spark, detail_path(landed_run, entry))
    ]
    return sync_listed(
        ledger,
        union_sources(listed),
        union_sources(details) if details else None,
        regions,
        run_ts,
    )


def sync_bodies(
    ledger: Ledger,
    listings: DataFrame,
    details: DataFrame | None,
    companies: Sequence[Company],
    regions: Sequence[str],
    run_ts: datetime,
) -> DataFrame:
    """The same for documents that arrive as rows: ``listings`` (source, company, offset,
    body) and ``details`` (source, company, detail_key, body)."""
    configured = companies_frame(ledger.spark, companies)
    used = [source(name) for name in sorted({company.ats for company in companies})]
    listed = [
        normalise(items_from_bodies(listings.where(F.col("source") == entry.name), entry), entry, configured)
        for entry in used
    ]
    found = [
        details_from_bodies(details.where(F.col("source") == entry.name), entry)
        for entry in used
        if entry.detail and details is not None
    ]
    return sync_listed(
        ledger, union_sources(listed), union_sources(found) if found else None, regions, run_ts
    )


def sync_listed(
    ledger: Ledger,
    listed: DataFrame,
    details: DataFrame | None,
    regions: Sequence[str],
    run_ts: datetime,
) -> DataFrame:
    """The run from listed rows (``schemas.LISTED``) on."""
    run = ledger.last_sync() + 1
    previous = ledger.current_state()
    stamp = F.lit(run_ts)
    in_region = in_regions(F.col("location"), regions)

    staged = ledger.listed.write(listed.withColumn("row_id", F.monotonically_increasing_id()), run)
    scanned = ledger.scanned.write(completeness(staged), run)
    usable = staged.where("usable")

    chosen = choose_keys(usable, in_region)
    state = ledger.state.write(merge_snapshot(previous, chosen, scanned, stamp), run)

    new = _new_rows(ledger, run, usable, state)
    if details is not None:
        # Details count for new rows inside the regions only.
        new = enrich(new.withColumn("detail_ref", F.when(in_region, F.col("detail_ref"))), details)
    texts = new.withColumn("description", strip_html(F.col("raw_description")))
    kept = [name for name in _names(schemas.POSTINGS) if name not in ("first_seen", "has_description")]
    complete = texts.select(
        *kept, stamp.alias("first_seen"), (F.col("description") != "").alias("has_description")
    )
    # Sorted files let a lookup of single keys skip all other pages.
    postings = ledger.postings.write(complete.sortWithinPartitions("unique_key"), run)

    enriched = postings.groupBy("company").agg(F.count_if(in_region).alias("enriched"))
    report = scanned
    # Every part is an aggregate with one row per company.
    for part in (listing_report(usable, in_region), change_report(state), enriched):
        report = report.join(part, "company", "left")
    keys = ("company", "complete", "run_ts")
    numbers = [name for name in _names(schemas.RUN_REPORT) if name not in keys]
    return ledger.sync_report.write(
        report.select(
            "company",
            "complete",
            *[F.coalesce(name, F.lit(0)).cast("bigint").alias(name) for name in numbers],
            stamp.alias("run_ts"),
        ),
        run,
    )


def _new_rows(ledger: Ledger, run: int, usable: DataFrame, state: DataFrame) -> DataFrame:
    """The staged rows of new keys, in full.

    The ids of new rows, or in a first load those of the few rows passed over, are written
    as a table of their own.  The join is then planned with their true size: a broadcast,
    or a Bloom filter before the shuffle, keeps text out of it.
    """
    arrivals = ledger.arrivals.write(state.where(F.col("change") == NEW).select("row_id"), run)
    if 2 * arrivals.count() <= usable.count():
        return usable.join(arrivals.where("row_id >= 0"), "row_id")
    others = usable.select("row_id").join(arrivals, "row_id", "left_anti")
    return usable.join(ledger.passed_over.write(others, run), "row_id", "left_anti")


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.replace("\n", " ").split(",")]
