"""Shared by the registered queries."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postledger.config import Search

# Listings made of ``documents``.  Everything below is over the whole table.
DOCUMENT_KEY = "concat('doc::', cast(doc_id as string))"
DOCUMENT_TITLE = "concat(source, ' ', lang)"
DOCUMENT_PLACE = "concat(lang, ', ', source)"

ENGLISH = Search(
    "English", "Reads English.", ("EN, src1", "de"), 150_000, ("SRC1", "src7"), True, ("rail", "air")
)
ALL = Search("All", "Reads everything.\nWrites it, too.")
ROMANCE = Search("Romance", "Lit français; niño.", ("fr", "es"), None, ("src",))
SEARCHES = [ENGLISH, ALL, ROMANCE]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_rows(spark: SparkSession, sf_dir: str, text: bool = True) -> DataFrame:
    """``documents`` as listings."""
    columns = {
        "unique_key": F.expr(DOCUMENT_KEY),
        "title": F.expr(DOCUMENT_TITLE),
        "company": F.col("source"),
        "location": F.expr(DOCUMENT_PLACE),
        "department": F.col("lang"),
    }
    if text:
        columns["description"] = F.col("text")
    return table(spark, sf_dir, "documents").select(*[c.alias(n) for n, c in columns.items()])


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _sql_list(values) -> str:
    return "[" + ", ".join(map(sql_text, values)) + "]::VARCHAR[]"


# Canonical requirements as text, written out rather than taken from the library.
_REQUIREMENTS = {
    ENGLISH.name: (
        '{"hard": {"salary_min": 150000, "title_keywords": ["SRC1", "src7"]}, '
        '"soft": {"preferred_industries": ["air", "rail"], "prefers_remote": true}}'
    ),
    ALL.name: (
        '{"hard": {"salary_min": null, "title_keywords": []}, '
        '"soft": {"preferred_industries": [], "prefers_remote": false}}'
    ),
    ROMANCE.name: (
        '{"hard": {"salary_min": null, "title_keywords": ["src"]}, '
        '"soft": {"preferred_industries": [], "prefers_remote": false}}'
    ),
}

_ROWS = ",\n".join(
    f"({sql_text(s.name)}, {_sql_list(s.regions)}, {_sql_list(s.title_keywords)}, {sql_text(s.profile)}, "
    f"substring(sha256({sql_text(s.profile)}), 1, 16), "
    f"substring(sha256({sql_text(_REQUIREMENTS[s.name])}), 1, 16))"
    for s in SEARCHES
)

# CTEs for the SQL side.
SEARCHES_SQL = f"""searches(search_name, terms, keywords, profile, profile_hash, requirements_hash)
    AS (VALUES {_ROWS})"""

DOCUMENTS_SQL = f"""listings AS (
    SELECT concat('doc::', doc_id) AS unique_key, {DOCUMENT_TITLE} AS title, source AS company,
           {DOCUMENT_PLACE} AS location, lang AS department, text AS description
    FROM documents)"""


def any_of(text: str, terms: str) -> str:
    return (
        f"(len({terms}) = 0 OR len(list_filter({terms}, "
        f"lambda t: contains(lower({text}), lower(t)))) > 0)"
    )


PAIRS_SQL = f"""pairs AS (
    SELECT l.*, s.search_name, s.profile, s.profile_hash, s.requirements_hash, s.keywords,
           {any_of("l.title", "s.keywords")} AS title_ok
    FROM listings l JOIN searches s ON {any_of("l.location", "s.terms")})"""


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder that every executor can reach."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="postledger-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
