"""Requirement text and prompts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postledger.functions.scalars import or_empty

# Lines of the requirement text, and the gate's stored reason.
SALARY_LINE = ("- Minimum salary: ", " (estimate if not stated; hard_fail if clearly below)")
KEYWORDS_LINE = "- Title must match one of: "
REMOTE_LINE = "- Prefers remote or hybrid"
INDUSTRIES_LINE = "- Preferred industries: "
NOTHING = "None specified"
GATE_REASON = ("Title '", "' does not match required keywords: ")

# Fields of the JSON object an answer must hold.
ANSWER_FIELDS = (
    "fit_score",
    "fit_reasoning",
    "desirability_score",
    "desirability_reasoning",
    "hard_fail",
    "hard_fail_reason",
)

_INTRODUCTION = "Judge how well one listing suits one person."
_TASK = (
    "Give two whole numbers from 0 to 100. fit_score says how likely the person is to be "
    "offered the position. desirability_score says how far the position meets the wishes "
    "above; estimate what the listing leaves open. Explain each in one sentence. Set "
    "hard_fail to true only if a hard requirement is plainly missed, and name it in "
    "hard_fail_reason. Answer with one JSON object and nothing else, with the fields "
    + ", ".join(ANSWER_FIELDS)
    + "."
)


def _lines(*lines: Column) -> Column:
    return F.coalesce(F.nullif(F.concat_ws("\n", *lines), F.lit("")), F.lit(NOTHING))


def _listing(prefix: str, values: Column) -> Column:
    return F.when(F.size(values) > 0, F.concat(F.lit(prefix), F.array_join(values, ", ")))


def thousands(number: Column) -> Column:
    return F.format_number(number, 0)


def hard_text(salary_min: Column, title_keywords: Column) -> Column:
    before, after = SALARY_LINE
    salary = F.when(salary_min != 0, F.concat(F.lit(before), thousands(salary_min), F.lit(after)))
    return _lines(salary, _listing(KEYWORDS_LINE, title_keywords))


def soft_text(prefers_remote: Column, preferred_industries: Column) -> Column:
    remote = F.when(prefers_remote, F.lit(REMOTE_LINE))
    return _lines(remote, _listing(INDUSTRIES_LINE, preferred_industries))


def gate_reason(title: Column, keyword_list: Column) -> Column:
    before, after = GATE_REASON
    return F.concat(F.lit(before), or_empty(title), F.lit(after), keyword_list)


def prompt(
    profile: Column,
    hard: Column,
    soft: Column,
    title: Column,
    company: Column,
    location: Column,
    department: Column,
    description: Column,
) -> Column:
    """One prompt per row.  Values are joined as they are, never interpreted as a format."""
    parts = [
        F.lit(_INTRODUCTION),
        F.concat(F.lit("PERSON\n"), profile),
        F.concat(F.lit("MUST HOLD\n"), hard),
        F.concat(F.lit("WISHES\n"), soft),
        F.concat(F.lit("LISTING\nTitle: "), or_empty(title)),
        F.concat(F.lit("Company: "), or_empty(company)),
        F.concat(F.lit("Location: "), or_empty(location)),
        F.concat(F.lit("Department: "), or_empty(department)),
        F.concat(F.lit("Text:\n"), or_empty(description)),
        F.lit(_TASK),
    ]
    return F.concat_ws("\n\n", *parts)
