"""Table schemas, as Spark DDL.

``jobs`` is split vertically.  ``POSTINGS`` holds what never changes after a key
is first stored (the wide text); ``STATE`` holds the few bytes that every run
rewrites.  ``jobs`` is their join on ``unique_key``.
"""

# One row per listed item, as every source produces it.  A document without items
# leaves a row with neither key nor ordinal, so that its company counts as scanned.
# ``ordinal`` gives the order of a company's items.
# ``usable`` rows are listings; ``announced`` is the total a document claims.
LISTED = """
    unique_key STRING, company STRING, ats_job_id STRING, title STRING, url STRING,
    location STRING, department STRING, raw_description STRING, posted_date DATE,
    ordinal BIGINT, detail_ref STRING, announced INT, corrupt BOOLEAN, usable BOOLEAN
"""

# Listed rows as staged for one run.  ``row_id`` tells copies apart even where a
# document landed twice.
STAGED = LISTED.rstrip() + ", row_id BIGINT"

# Staged rows of a run, by number alone.
ROW_IDS = "row_id BIGINT"

# Append-only, partitioned by the run that stored the row.  ``has_description``
# lets scoring skip empty rows without reading the text column.
POSTINGS = """
    unique_key STRING, title STRING, url STRING, company STRING, ats_job_id STRING,
    location STRING, department STRING, description STRING, posted_date DATE,
    first_seen TIMESTAMP, has_description BOOLEAN
"""

# Rewritten by every run.  ``change`` says what the run did to the row and
# ``row_id`` which staged row a new one came from.
STATE = """
    unique_key STRING, company STRING, last_seen TIMESTAMP, is_active BOOLEAN,
    change STRING, row_id BIGINT
"""

# Scores in full, append-only, one directory per scoring run.
SCORES = """
    unique_key STRING, search_name STRING, fit_score INT, desirability_score INT,
    hard_fail BOOLEAN, hard_fail_reason STRING, score_detail STRING, stage_reached INT,
    profile_hash STRING, requirements_hash STRING, scored_at TIMESTAMP, parse_ok BOOLEAN
"""

# Raw model answers, kept so that a repeated run does not ask twice.  A prompt whose model
# call failed has an error instead, and is asked again.
ANSWERS = """
    unique_key STRING, search_name STRING, profile_hash STRING,
    requirements_hash STRING, answer STRING, error STRING
"""

RUN_REPORT = """
    company STRING, complete BOOLEAN, listed BIGINT, region_matched BIGINT, missing_id BIGINT,
    enriched BIGINT, new BIGINT, reopened BIGINT, closed BIGINT, run_ts TIMESTAMP
"""

# Stale pairs of a scoring run.  ``stored_run`` is the sync run that stored the listing.
PAIRS = """
    unique_key STRING, search_name STRING, profile_hash STRING, requirements_hash STRING,
    title STRING, title_ok BOOLEAN, stored_run INT
"""

# Which score counts for a pair.  Only this is rewritten by every scoring run; reasons and
# answers stay where run ``scored_run`` wrote them.
CURRENT_SCORES = """
    unique_key STRING, search_name STRING, fit_score INT, desirability_score INT,
    hard_fail BOOLEAN, profile_hash STRING, requirements_hash STRING, scored_run INT
"""

# Per search: the sync run through which all its postings were matched, under these
# fingerprints and these regions, and the scoring run that did it.
MARKS = """
    search_name STRING, profile_hash STRING, requirements_hash STRING, regions_hash STRING,
    through_sync INT, scoring_run INT
"""

SCORE_REPORT = """
    search_name STRING, stage_reached INT, processed BIGINT, hard_failed BIGINT,
    unreadable BIGINT, failed_calls BIGINT
"""

SEARCHES = """
    name STRING, regions ARRAY<STRING>, profile STRING, profile_hash STRING,
    requirements_hash STRING, hard_text STRING, soft_text STRING, keyword_list STRING,
    hard STRUCT<salary_min: INT, title_keywords: ARRAY<STRING>>,
    soft STRUCT<prefers_remote: BOOLEAN, preferred_industries: ARRAY<STRING>>, notify STRING
"""

COMPANIES = "company STRING, ats STRING, config MAP<STRING, STRING>"

SCANNED = "company STRING, complete BOOLEAN"

# Which landed run a sync run merged, for those that came through the stream.
MERGED_RUNS = "landed_run STRING"
