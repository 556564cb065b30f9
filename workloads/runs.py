"""Whole runs against a ledger in the cluster's shared folder."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

from pyspark.sql import functions as F

from postledger import plans
from postledger.tables import Ledger
from workloads import snapshots
from workloads.common import (
    ALL,
    DOCUMENT_PLACE,
    DOCUMENT_TITLE,
    ENGLISH,
    PAIRS_SQL,
    ROMANCE,
    SEARCHES,
    SEARCHES_SQL,
    scratch,
    sql_text,
    table,
)
from workloads.searches import ANSWERS_SQL, PROMPTS_SQL

DAY_1, DAY_2 = dt.datetime(2026, 1, 1, 12), dt.datetime(2026, 1, 2, 12)


def _listed(rows, **columns):
    """Rows completed to listed rows."""
    defaults = {
        "url": F.lit(""),
        "department": F.lit(""),
        "posted_date": F.lit(None).cast("date"),
        "detail_ref": F.lit(None).cast("string"),
        "announced": F.lit(None).cast("int"),
        "corrupt": F.lit(False),
        "usable": F.lit(True),
        **columns,
    }
    names = (
        "unique_key company ats_job_id title url location department raw_description posted_date "
        "ordinal detail_ref announced corrupt usable"
    ).split()
    return rows.select(*[defaults[n].alias(n) if n in defaults else F.col(n) for n in names])


def sync_run(spark, sf):
    """Two snapshots of lines, one after the other; company N is never complete."""
    ledger = Ledger(spark, scratch(spark, "sync"))
    for status, stamp in (("F", DAY_1), ("O", DAY_2)):
        rows = _listed(
            snapshots.listed(spark, sf, status),
            raw_description=F.concat(F.lit("<p>"), "title", F.lit("</p>")),
            announced=F.when(F.col("company") == "N", 2**31 - 1),
        )
        plans.sync_listed(ledger, rows, None, snapshots.REGIONS, stamp)
    return ledger.jobs().select(
        "unique_key",
        "company",
        "title",
        "description",
        "is_active",
        F.col("first_seen").cast("date").cast("string").alias("first_seen"),
        F.col("last_seen").cast("date").cast("string").alias("last_seen"),
    )


def _chosen(status):
    return f"""
    SELECT DISTINCT unique_key, company, title FROM (
        SELECT unique_key, company, CASE WHEN bool_or(in_region)
            THEN max(ordinal) FILTER (WHERE in_region) ELSE min(ordinal) END AS ordinal
        FROM listed WHERE l_linestatus = '{status}' GROUP BY ALL)
    JOIN listed USING (unique_key, company, ordinal) WHERE l_linestatus = '{status}'"""


SYNC_RUN = f"""
WITH listed AS (
    SELECT concat(l_returnflag, '::', l_orderkey) AS unique_key, l_returnflag AS company,
        concat('part ', l_partkey, ' line ', l_linenumber) AS title,
        year(l_shipdate) IN (1996, 1998) AS in_region,
        l_partkey * 10 + l_linenumber AS ordinal, l_linestatus
    FROM lineitem),
one AS ({_chosen("F")}),
two AS ({_chosen("O")})
SELECT unique_key, coalesce(one.company, two.company) AS company, coalesce(one.title, two.title) AS title,
    coalesce(one.title, two.title) AS description,
    two.company IS NOT NULL OR one.company = 'N' AS is_active,
    CASE WHEN one.company IS NULL THEN '2026-01-02' ELSE '2026-01-01' END AS first_seen,
    CASE WHEN two.company IS NULL AND one.company = 'N' THEN '2026-01-01' ELSE '2026-01-02' END AS last_seen
FROM one FULL OUTER JOIN two USING (unique_key)"""

CHANGED = replace(ALL, profile="Reads everything, again.")


def scored_ledger(spark, sf):
    """Documents synchronised, scored, and scored again after one profile changed."""
    ledger = Ledger(spark, scratch(spark, "score"))
    rows = table(spark, sf, "documents").select(
        F.concat_ws("::", "source", "doc_id").alias("unique_key"),
        F.col("source").alias("company"),
        F.col("doc_id").cast("string").alias("ats_job_id"),
        F.expr(DOCUMENT_TITLE).alias("title"),
        F.expr(DOCUMENT_PLACE).alias("location"),
        F.col("text").alias("raw_description"),
        F.col("doc_id").alias("ordinal"),
        "lang",
    )
    plans.sync_listed(ledger, _listed(rows, department=F.col("lang")), None, [], DAY_1)
    plans.score(ledger, SEARCHES, DAY_1)
    plans.score(ledger, [ENGLISH, CHANGED, ROMANCE], DAY_2)
    return ledger


def score_run(spark, sf):
    return scored_ledger(spark, sf).current_scores().select(
        "unique_key",
        "search_name",
        "fit_score",
        "desirability_score",
        "hard_fail",
        "stage_reached",
        "profile_hash",
        "requirements_hash",
        F.col("scored_at").cast("date").cast("string").alias("scored_at"),
    )


_STRIPPED = r"""trim(regexp_replace(
    replace(replace(replace(replace(regexp_replace(text, '<[^>]+>', ' ', 'g'),
        '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'))"""

_LISTINGS = f"""listings AS (
    SELECT concat(source, '::', doc_id) AS unique_key, {DOCUMENT_TITLE} AS title, source AS company,
           {DOCUMENT_PLACE} AS location, lang AS department, {_STRIPPED} AS description
    FROM documents WHERE {_STRIPPED} <> '')"""

# The changed profile takes the place of the first one.
_SEARCHES = SEARCHES_SQL.replace(sql_text(ALL.profile), sql_text(CHANGED.profile))

_SCORED = f"""{_SEARCHES}, {_LISTINGS}, {PAIRS_SQL}, {PROMPTS_SQL}, {ANSWERS_SQL},
scored AS (
    SELECT unique_key, search_name, fit_score, desirability_score, false AS hard_fail, 3 AS stage_reached,
        profile_hash, requirements_hash FROM answers
    UNION ALL
    SELECT unique_key, search_name, 0, 0, true, 1, profile_hash, requirements_hash
    FROM pairs WHERE NOT title_ok)"""

SCORE_RUN = f"""
WITH {_SCORED}
SELECT *, CASE search_name WHEN 'All' THEN '2026-01-02' ELSE '2026-01-01' END AS scored_at FROM scored"""


def rank_run(spark, sf):
    ledger = scored_ledger(spark, sf)
    return plans.rank_all(ledger, SEARCHES).select(
        "search_name", "rank", "unique_key", "title", "fit_score", "desirability_score", "is_active"
    )


RANK_RUN = f"""
WITH {_SCORED},
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY search_name
        ORDER BY fit_score + desirability_score DESC, unique_key)::INT AS rank
    FROM scored WHERE NOT hard_fail AND fit_score >= 60 AND desirability_score >= 60)
SELECT search_name, rank, unique_key, title, fit_score, desirability_score, true AS is_active
FROM ranked JOIN listings USING (unique_key) WHERE rank <= 10"""



def rank_one(spark, sf):
    """The ranking of one search over a ledger."""
    best = plans.rank(scored_ledger(spark, sf), ALL.name, limit=25, active_only=True)
    return best.select("unique_key", "title", "description", "fit_score", "desirability_score", "combined_score")


RANK_ONE = f"""
WITH {_SCORED}
SELECT unique_key, title, description, fit_score, desirability_score,
    fit_score + desirability_score AS combined_score
FROM scored JOIN listings USING (unique_key)
WHERE search_name = {sql_text(ALL.name)} AND NOT hard_fail AND fit_score >= 60 AND desirability_score >= 60
ORDER BY combined_score DESC, unique_key LIMIT 25"""


QUERIES = {
    "q_rank_one": (rank_one, RANK_ONE),
    "q_sync_run": (sync_run, SYNC_RUN),
    "q_score_run": (score_run, SCORE_RUN),
    "q_rank_run": (rank_run, RANK_RUN),
}
