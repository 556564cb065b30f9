"""Searches and companies: small configuration, read from plain documents.

A document is the parsed form of a JSON or YAML file.  Everything derived from a
search alone (its fingerprints, its requirement text) is fixed here once.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from postledger import schemas
from postledger.functions.prompts import hard_text, soft_text
from postledger.functions.scalars import FINGERPRINT_LENGTH


def _fingerprint(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()[:FINGERPRINT_LENGTH]


@dataclass(frozen=True)
class Search:
    """A named search.  ``profile`` is the text itself, not a path to it."""

    name: str
    profile: str
    regions: Sequence[str] = ()
    salary_min: int | None = None
    title_keywords: Sequence[str] = ()
    prefers_remote: bool = False
    preferred_industries: Sequence[str] = ()
    notify: str = ""

    @property
    def profile_hash(self) -> str:
        return _fingerprint(self.profile)

    @property
    def regions_hash(self) -> str:
        """Fingerprint of the regions that choose the listings, in sorted order."""
        return _fingerprint(json.dumps(sorted(self.regions)))

    @property
    def requirements_hash(self) -> str:
        """Fingerprint of the requirements as canonical JSON: sorted keys and lists."""
        wishes = dict(
            preferred_industries=sorted(self.preferred_industries),
            prefers_remote=self.prefers_remote,
        )
        musts = dict(salary_min=self.salary_min, title_keywords=sorted(self.title_keywords))
        return _fingerprint(json.dumps(dict(hard=musts, soft=wishes), sort_keys=True))

    @property
    def keyword_list(self) -> str:
        """The keywords as the stored gate reason shows them."""
        return repr(list(self.title_keywords))

    def as_row(self) -> dict[str, Any]:
        return {
            "name": self.name,
            "regions": list(self.regions),
            "profile": self.profile,
            "profile_hash": self.profile_hash,
            "requirements_hash": self.requirements_hash,
            "keyword_list": self.keyword_list,
            "hard": {"salary_min": self.salary_min, "title_keywords": list(self.title_keywords)},
            "soft": {
                "prefers_remote": self.prefers_remote,
                "preferred_industries": list(self.preferred_industries),
            },
            "notify": self.notify,
        }


@dataclass(frozen=True)
class Company:
    name: str
    ats: str
    config: Mapping[str, str] = field(default_factory=dict)


def read_document(path: str | Path) -> dict[str, Any]:
    """Parse a configuration file: JSON, or YAML where a YAML parser is installed."""
    text = Path(path).read_text(encoding="utf-8")
    if Path(path).suffix == ".json":
        return json.loads(text)
    try:
        import yaml
    except ImportError as missing:
        raise RuntimeError("reading YAML configuration needs PyYAML; use JSON instead") from missing
    return yaml.safe_load(text)


def load_searches(document: Mapping[str, Any], profiles: Mapping[str, str] | None = None) -> list[Search]:
    """Searches of a document.  ``profiles`` maps ``profile_path`` to text already at hand;
    other paths are read as files."""
    return [_search(entry, profiles or {}) for entry in document.get("searches") or []]


# Where a search's settings stand in its document; what is missing keeps its default.
_PLACES = {
    "regions": ("regions",),
    "notify": ("notify",),
    "salary_min": ("requirements", "hard", "salary_min"),
    "title_keywords": ("requirements", "hard", "title_keywords"),
    "prefers_remote": ("requirements", "soft", "prefers_remote"),
    "preferred_industries": ("requirements", "soft", "preferred_industries"),
}


def _search(entry: Mapping[str, Any], profiles: Mapping[str, str]) -> Search:
    path, settings = entry["profile_path"], {}
    for setting, place in _PLACES.items():
        value: Any = entry
        for key in place:
            value = (value or {}).get(key)
        if value is not None:
            settings[setting] = tuple(value) if isinstance(value, list | tuple) else value
    profile = profiles[path] if path in profiles else Path(path).expanduser().read_text(encoding="utf-8")
    return Search(name=entry["name"], profile=profile, **settings)


def load_companies(document: Mapping[str, Any]) -> tuple[list[Company], list[str]]:
    """Companies and the region terms shared by all of them."""
    companies = [
        Company(entry["name"], entry["ats"], dict(entry.get("config") or {}))
        for entry in document.get("companies") or []
    ]
    return companies, list(document.get("regions") or [])


def select_searches(searches: Iterable[Search], target: str | None) -> list[Search]:
    """All searches, or the one named ``target``."""
    chosen = [search for search in searches if target is None or search.name == target]
    if target is not None and not chosen:
        raise ValueError(f"no search named {target!r}")
    return chosen


def searches_frame(spark: SparkSession, searches: Iterable[Search]) -> DataFrame:
    rows = _local(spark, [search.as_row() for search in searches], schemas.SEARCHES)
    return rows.withColumns(
        {
            "hard_text": hard_text(F.col("hard.salary_min"), F.col("hard.title_keywords")),
            "soft_text": soft_text(F.col("soft.prefers_remote"), F.col("soft.preferred_industries")),
        }
    )


def _local(spark: SparkSession, rows: list[dict[str, Any]], schema: str) -> DataFrame:
    """Configuration as a local relation.  Its exact size is part of the plan, so joins
    broadcast it only below ``spark.sql.autoBroadcastJoinThreshold``."""
    struct = spark.createDataFrame([], schema).schema
    return spark.createDataFrame(pa.Table.from_pylist(rows, to_arrow_schema(struct)), struct)


def companies_frame(spark: SparkSession, companies: Iterable[Company]) -> DataFrame:
    # Only plain settings travel with the rows; nested ones steer fetching, which is not done here.
    rows = [
        {
            "company": company.name,
            "ats": company.ats,
            "config": [(k, v) for k, v in company.config.items() if isinstance(v, str)],
        }
        for company in companies
    ]
    return _local(spark, rows, schemas.COMPANIES)
