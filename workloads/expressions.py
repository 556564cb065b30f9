"""Scalar expressions and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from postledger import functions as fn
from postledger.functions.prompts import (
    GATE_REASON,
    INDUSTRIES_LINE,
    KEYWORDS_LINE,
    NOTHING,
    REMOTE_LINE,
    SALARY_LINE,
    gate_reason,
    hard_text,
    soft_text,
)
from postledger.operators.bounds import broadcast_within
from postledger.operators.matching import in_regions, title_passes
from workloads.common import any_of, sql_text, table


def unique_key(spark, sf):
    key = fn.unique_key(F.col("source"), fn.id_text(F.col("doc_id")))
    return table(spark, sf, "documents").select("doc_id", key.alias("unique_key"))


UNIQUE_KEY = "SELECT doc_id, concat(source, '::', CAST(doc_id AS VARCHAR)) AS unique_key FROM documents"


def strip_html(spark, sf):
    return table(spark, sf, "pages").select("page_id", fn.strip_html(F.col("html")).alias("text"))


STRIP_HTML = r"""
SELECT page_id, trim(regexp_replace(
    replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'),
        '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) AS text
FROM pages"""

_REGIONS = ["Nation_1", "ASIA"]


def region(spark, sf):
    regions = broadcast_within(table(spark, sf, "region"))
    places = broadcast_within(
        table(spark, sf, "nation")
        .join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
        .select("n_nationkey", F.concat_ws(", ", "n_name", "r_name").alias("location"))
    )
    located = table(spark, sf, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return located.where(in_regions(F.col("location"), _REGIONS)).select("c_custkey", "c_name", "location")


REGION = f"""
WITH located AS (
    SELECT c_custkey, c_name, concat(n_name, ', ', r_name) AS location
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT * FROM located WHERE {any_of("location", str(_REGIONS))}"""

_KEYWORDS = ["standard", "PROmo"]


def title_gate(spark, sf):
    passes = title_passes(F.col("p_type"), _KEYWORDS)
    reason = F.when(passes, "").otherwise(gate_reason(F.col("p_type"), F.lit(repr(_KEYWORDS))))
    return table(spark, sf, "part").select(
        "p_partkey",
        (~passes).alias("hard_fail"),
        F.when(passes, 3).otherwise(1).alias("stage_reached"),
        reason.alias("hard_fail_reason"),
    )


TITLE_GATE = f"""
WITH gated AS (SELECT p_partkey, p_type, {any_of("p_type", str(_KEYWORDS))} AS passes FROM part)
SELECT p_partkey, NOT passes AS hard_fail, CASE WHEN passes THEN 3 ELSE 1 END AS stage_reached,
       CASE WHEN passes THEN '' ELSE concat({sql_text(GATE_REASON[0])}, p_type,
            {sql_text(GATE_REASON[1])}, {sql_text(repr(_KEYWORDS))}) END AS hard_fail_reason
FROM gated"""


def fingerprint(spark, sf):
    return table(spark, sf, "documents").select("doc_id", fn.fingerprint(F.col("text")).alias("fingerprint"))


FINGERPRINT = "SELECT doc_id, substring(sha256(text), 1, 16) AS fingerprint FROM documents"

# The same text in both engines: five kinds of answers, by type of event.
_ANSWER = """
CASE event_type
    WHEN 'click' THEN concat('{"fit_score": ', cast(user_id as string), ', "desirability_score": "',
        cast(event_id as string), '", "hard_fail": false, "hard_fail_reason": ""}')
    WHEN 'view' THEN concat('Result:', chr(10), '{"fit_score": ', cast(user_id as string), '.9,', chr(10),
        ' "hard_fail": "true", "hard_fail_reason": "of user ', cast(user_id as string), '"}', chr(10), 'Done.')
    WHEN 'purchase' THEN concat(props, ' and ', props)
    WHEN 'signup' THEN concat('Props ', props, ' only.')
    ELSE concat('no answer {', cast(event_id as string)) END"""


def json_slice(spark, sf):
    answers = table(spark, sf, "events").select("event_id", F.expr(_ANSWER).alias("answer"))
    rows = fn.with_answer_columns(answers)
    k = F.try_variant_get(fn.decode_detail(F.col("score_detail")), "$.k", "int")
    return rows.withColumn("k", k).drop("score_detail")


JSON_SLICE = rf"""
WITH sliced AS (
    SELECT event_id, regexp_extract({_ANSWER}, '(?s)(\{{.*\}})', 1) AS object FROM events),
parsed AS (
    SELECT event_id, json_valid(object) AS parse_ok,
           CASE WHEN json_valid(object) THEN object ELSE '{{}}' END AS object
    FROM sliced)
SELECT event_id, parse_ok,
    coalesce(trunc(TRY_CAST(json_extract_string(object, '$.fit_score') AS DOUBLE)), 0)::INT AS fit_score,
    coalesce(trunc(TRY_CAST(json_extract_string(object, '$.desirability_score') AS DOUBLE)), 0)::INT
        AS desirability_score,
    coalesce(TRY_CAST(json_extract_string(object, '$.hard_fail') AS BOOLEAN), false) AS hard_fail,
    coalesce(json_extract_string(object, '$.hard_fail_reason'), '') AS hard_fail_reason,
    TRY_CAST(json_extract_string(object, '$.k') AS INT) AS k
FROM parsed"""


def json_roundtrip(spark, sf):
    detail = fn.encode_detail(F.struct("event_id", "event_type", "value", "props"))
    stored = table(spark, sf, "events").select(detail.alias("score_detail"))
    back = fn.decode_detail(F.col("score_detail"))
    kinds = {"event_id": "bigint", "event_type": "string", "value": "double", "props": "string"}
    return stored.select(
        *[F.variant_get(back, f"$.{name}", kind).alias(name) for name, kind in kinds.items()]
    )


JSON_ROUNDTRIP = """
WITH stored AS (
    SELECT json_object('event_id', event_id, 'event_type', event_type, 'value', value, 'props', props)
           AS detail FROM events)
SELECT CAST(json_extract_string(detail, '$.event_id') AS BIGINT) AS event_id,
       json_extract_string(detail, '$.event_type') AS event_type,
       CAST(json_extract_string(detail, '$.value') AS DOUBLE) AS value,
       json_extract_string(detail, '$.props') AS props
FROM stored"""

_CITY = "CASE p_type WHEN 'SMALL' THEN '' WHEN 'LARGE' THEN concat(', ', p_name, ' ,') ELSE p_name END"
_COUNTRY = "CASE p_brand WHEN 'Brand#1' THEN NULL WHEN 'Brand#2' THEN '' ELSE p_brand END"


def place(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", fn.place(F.expr(_CITY), F.expr(_COUNTRY)).alias("location")
    )


PLACE = f"""SELECT p_partkey,
    trim(concat({_CITY}, ', ', coalesce({_COUNTRY}, '')), ', ') AS location FROM part"""


def fallback(spark, sf):
    value = fn.non_empty(F.expr(_COUNTRY), F.expr(_CITY))
    return table(spark, sf, "part").select("p_partkey", value.alias("value"))


FALLBACK = f"SELECT p_partkey, coalesce(nullif({_COUNTRY}, ''), {_CITY}, '') AS value FROM part"


def first_or_default(spark, sf):
    words = F.when(F.col("p_type") == "SMALL", F.lit(None)).when(
        F.col("p_type") == "LARGE", F.array().cast("array<string>")
    ).otherwise(F.split("p_name", " "))
    return table(spark, sf, "part").select("p_partkey", fn.first_or_default(words).alias("value"))


FIRST_OR_DEFAULT = """
SELECT p_partkey, coalesce((CASE p_type WHEN 'SMALL' THEN NULL WHEN 'LARGE' THEN []::VARCHAR[]
    ELSE string_split(p_name, ' ') END)[1], '') AS value FROM part"""


def lenient_date(spark, sf):
    day = "cast(ts as date)"
    compact = f"replace(cast({day} as string), '-', '')"
    text = f"""CASE event_type
        WHEN 'click' THEN concat(cast({day} as string), 'T', cast(event_id as string))
        WHEN 'view' THEN concat_ws('-', year(ts), month(ts), day(ts))
        WHEN 'purchase' THEN {compact}
        WHEN 'signup' THEN concat(extract(YEAROFWEEK FROM ts), '-W', lpad(weekofyear(ts), 2, '0'), '-',
            weekday(ts) + 1)
        ELSE cast(event_id as string) END"""
    return table(spark, sf, "events").select(
        "event_id", fn.lenient_date(F.expr(text)).cast("string").alias("posted_date")
    )


# Unpadded dates read only where month and day have two digits; an event id of eight
# digits would read as a compact date.
LENIENT_DATE = """
SELECT event_id, CAST(CASE event_type
    WHEN 'view' THEN CASE WHEN month(ts) >= 10 AND day(ts) >= 10 THEN CAST(ts AS DATE) END
    WHEN 'error' THEN CASE WHEN event_id >= 10000000
        THEN try_strptime(CAST(event_id AS VARCHAR), '%Y%m%d')::DATE END
    ELSE CAST(ts AS DATE) END AS VARCHAR) AS posted_date
FROM events"""


def thousands(spark, sf):
    salary = F.when(F.col("p_brand") != "Brand#1", F.round(F.col("p_retailprice") * 1000).cast("int"))
    keywords = F.when(F.col("p_type") == "SMALL", F.array().cast("array<string>")).otherwise(
        F.split("p_name", " ")
    )
    return table(spark, sf, "part").select(
        "p_partkey",
        hard_text(salary, keywords).alias("hard_text"),
        soft_text(F.col("p_size") > 25, keywords).alias("soft_text"),
    )


THOUSANDS = f"""
WITH lines AS (
    SELECT p_partkey,
        CASE WHEN p_brand <> 'Brand#1' THEN concat({sql_text(SALARY_LINE[0])},
            format('{{:,}}', round(p_retailprice * 1000)::INT), {sql_text(SALARY_LINE[1])}) END AS salary,
        CASE WHEN p_type <> 'SMALL' THEN replace(p_name, ' ', ', ') END AS words,
        CASE WHEN p_size > 25 THEN {sql_text(REMOTE_LINE)} END AS remote
    FROM part)
SELECT p_partkey,
    coalesce(nullif(concat_ws(chr(10), salary, {sql_text(KEYWORDS_LINE)} || words), ''),
        {sql_text(NOTHING)}) AS hard_text,
    coalesce(nullif(concat_ws(chr(10), remote, {sql_text(INDUSTRIES_LINE)} || words), ''),
        {sql_text(NOTHING)}) AS soft_text
FROM lines"""


def read_defaults(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    location = F.when(F.col("toxic") == 0, F.col("lang"))
    return rows.select(
        "doc_id",
        fn.or_empty(location).alias("location"),
        fn.or_empty(F.when(F.col("quality") == 1, F.col("source"))).alias("department"),
        fn.fingerprint(fn.or_empty(F.when(F.col("toxic").isNull(), F.col("text")))).alias("description_hash"),
    )


READ_DEFAULTS = """
SELECT d.doc_id, coalesce(CASE WHEN toxic = 0 THEN lang END, '') AS location,
    coalesce(CASE WHEN quality = 1 THEN source END, '') AS department,
    substring(sha256(CASE WHEN toxic IS NULL THEN text ELSE '' END), 1, 16) AS description_hash
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""

QUERIES = {
    "q_unique_key": (unique_key, UNIQUE_KEY),
    "q_strip_html": (strip_html, STRIP_HTML),
    "q_region": (region, REGION),
    "q_title_gate": (title_gate, TITLE_GATE),
    "q_fingerprint": (fingerprint, FINGERPRINT),
    "q_json_slice": (json_slice, JSON_SLICE),
    "q_json_roundtrip": (json_roundtrip, JSON_ROUNDTRIP),
    "q_place": (place, PLACE),
    "q_fallback": (fallback, FALLBACK),
    "q_first_or_default": (first_or_default, FIRST_OR_DEFAULT),
    "q_lenient_date": (lenient_date, LENIENT_DATE),
    "q_thousands": (thousands, THOUSANDS),
    "q_read_defaults": (read_defaults, READ_DEFAULTS),
}
