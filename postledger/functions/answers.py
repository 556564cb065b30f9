"""Reading the scorer's free-text answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postledger.functions.scalars import or_empty

# From the first opening to the last closing brace.
_OBJECT = r"(?s)(\{.*\})"


def _slice(answer: Column) -> Column:
    return F.regexp_extract(answer, _OBJECT, 1)


def _parsed(answer: Column) -> Column:
    """The one JSON object of an answer as a variant, else null.

    The JSON reader ignores what follows a first value, but text with more than one
    object must not parse.  Inside brackets and inside braces alike, only a single
    value is well formed.
    """
    # Answers without braces are not worth a failing parse.
    text = F.nullif(_slice(answer), F.lit(""))
    in_brackets = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    in_braces = F.try_parse_json(F.concat(F.lit('{"":'), text, F.lit("}")))
    return F.when(in_braces.isNotNull(), F.try_variant_get(in_brackets, "$[0]", "variant"))


def json_slice(answer: Column) -> Column:
    """The text of the JSON object inside an answer, null where there is none that parses."""
    return F.when(_parsed(answer).isNotNull(), _slice(answer))


def with_answer_columns(rows: DataFrame, answer: str = "answer") -> DataFrame:
    """Replaces an answer by typed columns, with defaults for what is missing or unusable.

    The parsed answer is a column of its own first, so that it is parsed once.
    """
    parsed = rows.withColumn("_detail", _parsed(F.col(answer))).drop(answer)
    return parsed.withColumns(answer_columns(F.col("_detail"))).drop("_detail")


def answer_columns(detail: Column) -> dict[str, Column]:
    """Typed columns of a parsed answer."""

    def score(path: str) -> Column:
        number = F.try_variant_get(detail, path, "double")
        return F.coalesce(number.try_cast("int"), F.lit(0))

    return {
        "fit_score": score("$.fit_score"),
        "desirability_score": score("$.desirability_score"),
        "hard_fail": F.coalesce(F.try_variant_get(detail, "$.hard_fail", "boolean"), F.lit(False)),
        "hard_fail_reason": or_empty(F.try_variant_get(detail, "$.hard_fail_reason", "string")),
        "score_detail": F.coalesce(F.to_json(detail), F.lit("{}")),
        "parse_ok": detail.isNotNull(),
    }
