"""Snapshot operators.

``lineitem`` holds two snapshots: lines with status F are what was listed first, lines
with status O what is listed now.  The return flag is the company, so each of the three
holds a third of all rows, and the order is the listing's id.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from postledger.operators.enrich import enrich as enrich_rows
from postledger.operators.matching import in_regions
from postledger.operators.reports import change_report, counts as count_rows, listing_report
from postledger.operators.snapshot import (
    choose_keys,
    choose_listed,
    closed_keys,
    first_wins,
    known_keys,
    last_wins,
    merge_snapshot,
    new_rows,
)
from postledger.sources import completeness, limit_listing, union_sources
from workloads.common import table

FIRST_DAY, SECOND_DAY = "2026-01-01", "2026-01-02"
REGIONS = ["1996", "year 1998"]


def listed(spark, sf, status=None):
    """One snapshot, or both, as listed rows.  Title and ordinal follow from the part and line, so
    that equal ordinals do not make the result ambiguous."""
    lines = table(spark, sf, "lineitem")
    if status:
        lines = lines.where(F.col("l_linestatus") == status)
    return lines.select(
        F.concat_ws("::", "l_returnflag", "l_orderkey").alias("unique_key"),
        F.col("l_returnflag").alias("company"),
        F.col("l_orderkey").cast("string").alias("ats_job_id"),
        F.concat(F.lit("part "), "l_partkey", F.lit(" line "), "l_linenumber").alias("title"),
        F.concat(F.lit("Year "), F.year("l_shipdate")).alias("location"),
        (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("ordinal"),
        "l_tax",
    )


def state(spark, sf, status="F"):
    """A snapshot as stored state; keys without any tax were closed since."""
    stored = listed(spark, sf, status).groupBy("unique_key").agg(F.max("l_tax").alias("tax"))
    return stored.select(
        "unique_key",
        F.split_part("unique_key", F.lit("::"), F.lit(1)).alias("company"),
        F.lit(FIRST_DAY).cast("date").cast("timestamp").alias("last_seen"),
        (F.col("tax") > 0.02).alias("is_active"),
    )


def scanned(spark, sf):
    """All companies were scanned, N incompletely."""
    companies = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("company")).distinct()
    return companies.withColumn("complete", F.col("company") != "N")


def incoming(spark, sf):
    rows = listed(spark, sf, "O").withColumn("row_id", F.col("ordinal"))
    return choose_keys(rows, in_regions(F.col("location"), REGIONS))


_CTES = """
listed AS (
    SELECT concat(l_returnflag, '::', l_orderkey) AS unique_key, l_returnflag AS company,
        concat('part ', l_partkey, ' line ', l_linenumber) AS title,
        concat('Year ', year(l_shipdate)) IN ('Year 1996', 'Year 1998') AS in_region,
        l_partkey * 10 + l_linenumber AS ordinal, l_tax, l_linestatus
    FROM lineitem),
state AS (
    SELECT unique_key, company, max(l_tax) > 0.02 AS is_active
    FROM listed WHERE l_linestatus = 'F' GROUP BY ALL),
current AS (
    SELECT unique_key, company, bool_or(in_region) AS in_region, count(*) AS copies,
        CASE WHEN bool_or(in_region) THEN max(ordinal) FILTER (WHERE in_region) ELSE min(ordinal) END AS ordinal
    FROM listed WHERE l_linestatus = 'O' GROUP BY ALL)"""


def choose(spark, sf):
    rows = choose_listed(listed(spark, sf), in_regions(F.col("location"), REGIONS))
    return rows.select("unique_key", "company", "title", "in_region")


CHOOSE = f"""
WITH {_CTES}
SELECT DISTINCT unique_key, company, title, c.in_region
FROM (SELECT unique_key, company, bool_or(in_region) AS in_region,
        CASE WHEN bool_or(in_region) THEN max(ordinal) FILTER (WHERE in_region) ELSE min(ordinal) END AS ordinal
      FROM listed GROUP BY ALL) c
JOIN listed l USING (unique_key, company, ordinal)"""


def merge(spark, sf):
    stamp = F.lit(SECOND_DAY).cast("date").cast("timestamp")
    merged = merge_snapshot(state(spark, sf), incoming(spark, sf), scanned(spark, sf), stamp)
    return merged.select(
        "unique_key",
        "company",
        "change",
        "is_active",
        F.col("last_seen").cast("date").cast("string").alias("last_seen"),
        "row_id",
    )


MERGE = f"""
WITH {_CTES},
merged AS (
    SELECT unique_key, coalesce(s.company, c.company) AS company, s.is_active, c.ordinal,
        CASE WHEN s.company IS NULL THEN 'new'
             WHEN c.company IS NOT NULL AND s.is_active THEN 'seen'
             WHEN c.company IS NOT NULL THEN 'reopened'
             WHEN s.is_active AND s.company <> 'N' THEN 'closed'
             ELSE 'kept' END AS change
    FROM state s FULL OUTER JOIN current c USING (unique_key))
SELECT unique_key, company, change,
    CASE change WHEN 'kept' THEN is_active WHEN 'closed' THEN false ELSE true END AS is_active,
    CASE change WHEN 'kept' THEN '{FIRST_DAY}' ELSE '{SECOND_DAY}' END AS last_seen,
    CASE change WHEN 'new' THEN ordinal END AS row_id
FROM merged"""


def new(spark, sf):
    return new_rows(incoming(spark, sf), state(spark, sf))


NEW = f"""
WITH {_CTES}
SELECT unique_key, company, ordinal AS row_id, in_region FROM current c
WHERE NOT EXISTS (SELECT 1 FROM state s WHERE s.unique_key = c.unique_key)"""


def closed(spark, sf):
    return closed_keys(state(spark, sf), listed(spark, sf, "O"), scanned(spark, sf))


CLOSED = f"""
WITH {_CTES}
SELECT unique_key, company FROM state s WHERE is_active AND company IN ('A', 'R')
AND NOT EXISTS (SELECT 1 FROM current c WHERE c.unique_key = s.unique_key)"""


def known(spark, sf):
    return known_keys(union_sources([listed(spark, sf, "F"), listed(spark, sf, "O")]))


KNOWN = "SELECT DISTINCT concat(l_returnflag, '::', l_orderkey) AS unique_key FROM lineitem"


def counts(spark, sf):
    return count_rows(state(spark, sf, None))


COUNTS = f"""WITH {_CTES}
SELECT count(*) AS total, count(*) FILTER (WHERE is_active) AS active
FROM (SELECT unique_key, max(l_tax) > 0.02 AS is_active FROM listed GROUP BY unique_key)"""


def run_report(spark, sf):
    stamp = F.lit(SECOND_DAY).cast("date").cast("timestamp")
    merged = merge_snapshot(state(spark, sf), incoming(spark, sf), scanned(spark, sf), stamp)
    rows = listed(spark, sf, "O")
    report = listing_report(rows, in_regions(F.col("location"), REGIONS))
    return report.join(change_report(merged), "company", "left")


RUN_REPORT = f"""
WITH {_CTES},
listing AS (
    SELECT company, count(*) AS listed, count(*) FILTER (WHERE in_region) AS region_matched,
           0::BIGINT AS missing_id
    FROM listed WHERE l_linestatus = 'O' GROUP BY company),
merged AS (
    SELECT coalesce(s.company, c.company) AS company, s.company IS NULL AS is_new,
        s.company IS NOT NULL AND c.company IS NOT NULL AND NOT s.is_active AS is_reopened,
        c.company IS NULL AND s.is_active AND s.company <> 'N' AS is_closed
    FROM state s FULL OUTER JOIN current c USING (unique_key)),
changes AS (
    SELECT company, count(*) FILTER (WHERE is_new) AS new, count(*) FILTER (WHERE is_reopened) AS reopened,
        count(*) FILTER (WHERE is_closed) AS closed
    FROM merged GROUP BY company)
SELECT * FROM listing LEFT JOIN changes USING (company)"""


def turns(spark, sf):
    """Turns as copies of their conversation."""
    return table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("ordinal"), "role", "text")


def first(spark, sf):
    return first_wins(turns(spark, sf), ["conv_id"])


def last(spark, sf):
    return last_wins(turns(spark, sf), ["conv_id"])


_COPIES = """
SELECT conv_id, ordinal, role, text FROM (
    SELECT conv_id, turn AS ordinal, role, text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn {}) AS n FROM conversations)
WHERE n = 1"""


def limit_per_group(spark, sf):
    items = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("company"), F.col("turn").alias("offset"), F.col("turn").alias("ordinal"), "role"
    )
    return limit_listing(items, 3).select("company", "ordinal", "role")


LIMIT_PER_GROUP = """
SELECT company, ordinal, role FROM (
    SELECT conv_id AS company, turn AS ordinal, role,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)
WHERE n <= 3"""


def complete(spark, sf):
    """Assistants' turns are unreadable where the text is long, and the last turn announces one more."""
    rows = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("company"),
        F.col("turn").alias("ordinal"),
        (F.col("turn") + F.when(F.col("role") == "user", 2).otherwise(1)).cast("int").alias("announced"),
        ((F.col("role") == "assistant") & (F.length("text") > 1000)).alias("corrupt"),
    )
    return completeness(rows)


COMPLETE = """
SELECT conv_id AS company,
    count(*) >= max(turn + CASE WHEN role = 'user' THEN 2 ELSE 1 END)
        AND NOT bool_or(role = 'assistant' AND length(text) > 1000) AS complete
FROM conversations GROUP BY conv_id"""


def enrich(spark, sf):
    """Documents as listings, pages as their detail documents."""
    rows = table(spark, sf, "documents").select(
        F.concat(F.lit("doc::"), "doc_id").alias("unique_key"),
        F.when(F.col("lang") != "de", F.concat(F.lit("ref"), "doc_id")).alias("detail_ref"),
        F.col("text").alias("raw_description"),
        F.col("source").alias("department"),
    )
    details = table(spark, sf, "pages").select(
        F.concat(F.lit("ref"), "page_id").alias("detail_ref"),
        F.col("html").alias("detail_description"),
        F.when(F.col("url").startswith("https"), F.col("url")).alias("detail_department"),
    )
    return enrich_rows(rows, details).select("unique_key", "raw_description", "department", "enriched")


ENRICH = """
SELECT concat('doc::', doc_id) AS unique_key, coalesce(html, text) AS raw_description,
    CASE WHEN url LIKE 'https%' THEN url ELSE source END AS department, html IS NOT NULL AS enriched
FROM documents LEFT JOIN pages ON doc_id = page_id AND lang <> 'de'"""

QUERIES = {
    "q_choose_listed": (choose, CHOOSE),
    "q_sync_merge": (merge, MERGE),
    "q_new": (new, NEW),
    "q_closed": (closed, CLOSED),
    "q_known_keys": (known, KNOWN),
    "q_counts": (counts, COUNTS),
    "q_run_report": (run_report, RUN_REPORT),
    "q_first_wins": (first, _COPIES.format("ASC")),
    "q_last_wins": (last, _COPIES.format("DESC")),
    "q_limit_per_group": (limit_per_group, LIMIT_PER_GROUP),
    "q_completeness": (complete, COMPLETE),
    "q_enrich": (enrich, ENRICH),
}
