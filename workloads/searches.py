"""Searches over listings: matching, staleness, prompts, scores, rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from postledger.config import searches_frame
from postledger.functions import prompts as text
from postledger.functions.scalars import fingerprint
from postledger.operators.matching import gate_failures, match_searches, stale as stale_pairs
from postledger.operators.ranking import rank_search, rank_searches
from postledger.operators.reports import search_report as report_searches
from postledger.operators.scoring import (
    ask,
    offline_scorer,
    read_answers,
    render_prompts,
    upsert_scores,
)
from workloads.common import (
    DOCUMENTS_SQL,
    PAIRS_SQL,
    SEARCHES,
    SEARCHES_SQL,
    document_rows,
    sql_text,
    table,
)


def frame(spark):
    return searches_frame(spark, SEARCHES)


def pairs(spark, sf):
    rows = document_rows(spark, sf, text=False).select("unique_key", "title", "location")
    return match_searches(rows, SEARCHES)


def jobs_searches(spark, sf):
    return pairs(spark, sf).select(
        "unique_key", "search_name", "profile_hash", "requirements_hash", "title_ok"
    )


JOBS_SEARCHES = f"""
WITH {SEARCHES_SQL}, {DOCUMENTS_SQL}, {PAIRS_SQL}
SELECT unique_key, search_name, profile_hash, requirements_hash, title_ok FROM pairs"""


def label_scores(spark, sf):
    """``labels`` as stored scores: good ones of one search, bad ones of another, and
    toxic ones made under an old profile."""
    current = searches_frame(spark, SEARCHES).select("name", "profile_hash", "requirements_hash")
    labels = table(spark, sf, "labels").select(
        F.concat(F.lit("doc::"), "doc_id").alias("unique_key"),
        F.when(F.col("quality") == 1, "All").otherwise("English").alias("search_name"),
        "quality",
        "toxic",
    )
    scored = labels.join(current, F.col("search_name") == F.col("name"))
    return scored.select(
        "unique_key",
        "search_name",
        (F.col("quality") * 50).alias("fit_score"),
        F.lit(10).alias("desirability_score"),
        (F.col("toxic") == 1).alias("hard_fail"),
        F.when(F.col("toxic") == 1, "old").otherwise(F.col("profile_hash")).alias("profile_hash"),
        "requirements_hash",
    )


_LABEL_SCORES = """label_scores AS (
    SELECT concat('doc::', doc_id) AS unique_key, search_name, quality * 50 AS fit_score,
        10 AS desirability_score, toxic = 1 AS hard_fail,
        CASE WHEN toxic = 1 THEN 'old' ELSE profile_hash END AS profile_hash, requirements_hash
    FROM labels JOIN searches ON search_name = CASE quality WHEN 1 THEN 'All' ELSE 'English' END)"""


def stale(spark, sf):
    return stale_pairs(pairs(spark, sf), label_scores(spark, sf)).select("unique_key", "search_name", "title_ok")


STALE = f"""
WITH {SEARCHES_SQL}, {DOCUMENTS_SQL}, {PAIRS_SQL}, {_LABEL_SCORES}
SELECT p.unique_key, p.search_name, p.title_ok
FROM pairs p LEFT JOIN label_scores s ON p.unique_key = s.unique_key AND p.search_name = s.search_name
WHERE s.unique_key IS NULL OR s.profile_hash <> p.profile_hash OR s.requirements_hash <> p.requirements_hash"""


def gate(spark, sf):
    return gate_failures(pairs(spark, sf), frame(spark)).select(
        "unique_key", "search_name", "hard_fail", "stage_reached", "hard_fail_reason"
    )


# Keyword lists as the stored reason shows them.
_SHOWN = "CASE search_name WHEN 'English' THEN '[''SRC1'', ''src7'']' WHEN 'Romance' THEN '[''src'']' END"

GATE = f"""
WITH {SEARCHES_SQL}, {DOCUMENTS_SQL}, {PAIRS_SQL}
SELECT unique_key, search_name, true AS hard_fail, 1 AS stage_reached,
    concat('Title ''', title, ''' does not match required keywords: ', {_SHOWN}) AS hard_fail_reason
FROM pairs WHERE NOT title_ok"""


def search_report(spark, sf):
    matched = pairs(spark, sf)
    failed = gate_failures(matched, frame(spark)).select("search_name", "stage_reached", "hard_fail", "parse_ok")
    passed = matched.where("title_ok").select(
        "search_name", F.lit(3).alias("stage_reached"), F.lit(False).alias("hard_fail"), F.lit(True).alias("parse_ok")
    )
    return report_searches(failed.unionByName(passed))


SEARCH_REPORT = f"""
WITH {SEARCHES_SQL}, {DOCUMENTS_SQL}, {PAIRS_SQL}
SELECT search_name, CASE WHEN title_ok THEN 3 ELSE 1 END AS stage_reached, count(*) AS processed,
    count(*) FILTER (WHERE NOT title_ok) AS hard_failed, 0::BIGINT AS unreadable
FROM pairs GROUP BY ALL"""


def document_prompts(spark, sf):
    full = document_rows(spark, sf)
    return render_prompts(match_searches(full, SEARCHES).where("title_ok"), frame(spark))


def prompt(spark, sf):
    return document_prompts(spark, sf).select(
        "unique_key",
        "search_name",
        F.length("prompt").alias("length"),
        fingerprint(F.col("prompt")).alias("prompt_hash"),
    )


_HARD = f"""CASE search_name WHEN 'English' THEN
    {sql_text(text.SALARY_LINE[0] + "150,000" + text.SALARY_LINE[1])} || chr(10) || '- Title must match one of: SRC1, src7'
    WHEN 'Romance' THEN '- Title must match one of: src' ELSE 'None specified' END"""
_SOFT = """CASE search_name WHEN 'English' THEN
    '- Prefers remote or hybrid' || chr(10) || '- Preferred industries: rail, air' ELSE 'None specified' END"""

PROMPTS_SQL = f"""prompts AS (
    SELECT unique_key, search_name, profile_hash, requirements_hash, concat_ws(chr(10) || chr(10),
        {sql_text(text._INTRODUCTION)}, concat('PERSON', chr(10), profile),
        concat('MUST HOLD', chr(10), {_HARD}), concat('WISHES', chr(10), {_SOFT}),
        concat('LISTING', chr(10), 'Title: ', title), concat('Company: ', company),
        concat('Location: ', location), concat('Department: ', department),
        concat('Text:', chr(10), description), {sql_text(text._TASK)}) AS prompt
    FROM pairs WHERE title_ok)"""

PROMPT = f"""
WITH {SEARCHES_SQL}, {DOCUMENTS_SQL}, {PAIRS_SQL}, {PROMPTS_SQL}
SELECT unique_key, search_name, length(prompt)::INT AS length,
    substring(sha256(prompt), 1, 16) AS prompt_hash FROM prompts"""


def score_answers(spark, sf):
    answers = ask(document_prompts(spark, sf), offline_scorer)
    return read_answers(answers).select(
        "unique_key", "search_name", "fit_score", "desirability_score", "hard_fail", "parse_ok"
    )


ANSWERS_SQL = """answers AS (
    SELECT *, (('0x' || substring(md5(prompt), 1, 8))::BIGINT % 101)::INT AS fit_score,
        (('0x' || substring(md5(prompt), 9, 8))::BIGINT % 101)::INT AS desirability_score
    FROM prompts)"""

SCORE_ANSWERS = f"""
WITH {SEARCHES_SQL}, {DOCUMENTS_SQL}, {PAIRS_SQL}, {PROMPTS_SQL}, {ANSWERS_SQL}
SELECT unique_key, search_name, fit_score, desirability_score, false AS hard_fail, true AS parse_ok
FROM answers"""


def score_upsert(spark, sf):
    """Stored scores of labels, replaced where the gate failed the same pair."""
    columns = ["unique_key", "search_name", "fit_score", "desirability_score", "hard_fail"]
    fresh = gate_failures(pairs(spark, sf), frame(spark)).select(*columns)
    return upsert_scores(label_scores(spark, sf).select(*columns), fresh)


SCORE_UPSERT = f"""
WITH {SEARCHES_SQL}, {DOCUMENTS_SQL}, {PAIRS_SQL}, {_LABEL_SCORES},
fresh AS (SELECT unique_key, search_name, 0 AS fit_score, 0 AS desirability_score, true AS hard_fail
    FROM pairs WHERE NOT title_ok)
SELECT * FROM fresh UNION ALL
SELECT unique_key, search_name, fit_score, desirability_score, hard_fail FROM label_scores s
WHERE NOT EXISTS (SELECT 1 FROM fresh f
    WHERE f.unique_key = s.unique_key AND f.search_name = s.search_name)"""


def part_scores(spark, sf):
    return table(spark, sf, "part").select(
        F.concat(F.lit("part::"), "p_partkey").alias("unique_key"),
        F.col("p_type").alias("search_name"),
        (F.col("p_size") * 2).alias("fit_score"),
        F.length("p_name").cast("int").alias("half"),
        (F.col("p_brand") == "Brand#3").alias("hard_fail"),
    ).withColumn("desirability_score", F.col("half") * 7).drop("half")


_PART_SCORES = """scored AS (
    SELECT concat('part::', p_partkey) AS unique_key, p_type AS search_name, p_size * 2 AS fit_score,
        (length(p_name) * 7)::INT AS desirability_score, p_brand = 'Brand#3' AS hard_fail, p_name AS title
    FROM part)"""


def topk(spark, sf):
    """Parts as listings; one search, the default thresholds and length."""
    jobs = table(spark, sf, "part").select(
        F.concat(F.lit("part::"), "p_partkey").alias("unique_key"), F.col("p_name").alias("title")
    )
    return rank_search(jobs, part_scores(spark, sf), "PROMO").select("unique_key", "title", "combined_score")


TOPK = f"""
WITH {_PART_SCORES}
SELECT unique_key, title, fit_score + desirability_score AS combined_score FROM scored
WHERE search_name = 'PROMO' AND NOT hard_fail AND fit_score >= 60 AND desirability_score >= 60
ORDER BY combined_score DESC, unique_key LIMIT 10"""


# What o_orderpriority holds.
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def topk_per_search(spark, sf):
    """Orders as listings, their priority as the search; every search at once."""
    orders = table(spark, sf, "orders")
    key = F.concat_ws("::", "o_orderstatus", "o_orderkey")
    scores = orders.select(
        key.alias("unique_key"),
        F.col("o_orderpriority").alias("search_name"),
        F.floor(F.col("o_totalprice") / 5000).cast("int").alias("fit_score"),
        F.floor(F.dayofyear("o_orderdate") / 4).cast("int").alias("desirability_score"),
        (F.col("o_orderstatus") == "P").alias("hard_fail"),
    )
    jobs = orders.select(key.alias("unique_key"), F.col("o_orderdate").cast("date").cast("string").alias("posted_date"))
    return rank_searches(jobs, scores, PRIORITIES).select(
        "search_name", "rank", "unique_key", "posted_date", "combined_score"
    )


TOPK_PER_SEARCH = """
WITH scored AS (
    SELECT concat_ws('::', o_orderstatus, o_orderkey) AS unique_key, o_orderpriority AS search_name,
        CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS posted_date,
        floor(o_totalprice / 5000)::INT AS fit_score, floor(dayofyear(o_orderdate) / 4)::INT AS desirability_score
    FROM orders WHERE o_orderstatus <> 'P'),
ranked AS (
    SELECT search_name, unique_key, posted_date, fit_score + desirability_score AS combined_score,
        row_number() OVER (PARTITION BY search_name
            ORDER BY fit_score + desirability_score DESC, unique_key)::INT AS rank
    FROM scored WHERE fit_score >= 60 AND desirability_score >= 60)
SELECT search_name, rank, unique_key, posted_date, combined_score FROM ranked WHERE rank <= 10"""

QUERIES = {
    "q_jobs_searches": (jobs_searches, JOBS_SEARCHES),
    "q_stale": (stale, STALE),
    "q_gate_failures": (gate, GATE),
    "q_search_report": (search_report, SEARCH_REPORT),
    "q_prompt": (prompt, PROMPT),
    "q_score_answers": (score_answers, SCORE_ANSWERS),
    "q_score_upsert": (score_upsert, SCORE_UPSERT),
    "q_topk": (topk, TOPK),
    "q_topk_per_search": (topk_per_search, TOPK_PER_SEARCH),
}
