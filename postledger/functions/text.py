"""Text expressions: HTML to text, and case-insensitive substring tests."""

from __future__ import annotations

import html
from collections.abc import Sequence
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What counts as a tag and as white space.
TAG = "<[^>]+>"
# Unicode white space plus the four separators Java leaves out.
WHITE_SPACE = r"(?U)[\s\x1c-\x1f]+"

# Beyond this many terms the test becomes one array predicate instead of an OR
# chain, which would outgrow a generated method.
OR_CHAIN_TERMS = 100


@F.pandas_udf(T.StringType())
def _decode_entities(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


def strip_html(raw: Column) -> Column:
    """Tags become spaces, then entities are decoded, then white space collapses.

    Spark has no decoder for named HTML entities, so that one step runs in an
    Arrow UDF, and only strings with an ampersand are sent to it.
    """
    raw = F.coalesce(raw, F.lit(""))
    untagged = F.regexp_replace(raw, TAG, " ")
    has_entity = raw.contains("&")
    decoded = F.when(has_entity, _decode_entities(F.when(has_entity, untagged))).otherwise(untagged)
    return F.trim(F.regexp_replace(decoded, WHITE_SPACE, " "))


def contains_any(text: Column, terms: Sequence[str]) -> Column:
    """True if any term occurs in ``text``, ignoring case; always true without terms."""
    if not terms:
        return F.lit(True)
    lowered = F.lower(F.coalesce(text, F.lit("")))
    wanted = sorted({term.lower() for term in terms})
    if len(wanted) > OR_CHAIN_TERMS:
        return F.exists(F.lit(wanted), lambda term: F.contains(lowered, term))
    return reduce(or_, [lowered.contains(term) for term in wanted])
