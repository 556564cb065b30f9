"""Scalar and text expressions against plain Python where Python defines the result."""

import datetime
import html
import json
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postledger import functions as fn
from postledger.config import Search, searches_frame
from postledger.functions.prompts import ANSWER_FIELDS, gate_reason, prompt

RELAXED = settings(
    max_examples=8,
    deadline=None,
    suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow],
)


def evaluate(spark, values, column, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    rows = frame.select("i", column(F.col("v")).alias("out")).collect()
    return [row.out for row in sorted(rows, key=lambda row: row.i)]


def expected_text(raw):
    spaced = html.unescape(re.sub("<[^>]+>", " ", raw or ""))
    return re.sub(r"\s+", " ", spaced).strip()


TEXTS = [
    "<div>Two <i>words</i></div>",
    "<p>a</p>  <p>b</p>",
    "",
    "plain",
    None,
    "a&nbsp;b",
    "&uuml;&#228;&#xe4;",
    "&amp;lt;b&amp;gt;",
    "&lt;b&gt;bold&lt;/b&gt;",
    "<a\nhref='x'>over two lines</a>",
    "wide space \x1c and \x85 more 　",
    "<a href='&'>tag only</a>",
    "1 < 2",
    "a &notit; b &unknown; &",
]


def test_strip_html(spark):
    assert evaluate(spark, TEXTS, fn.strip_html) == [expected_text(t) for t in TEXTS]


@RELAXED
@given(st.lists(st.text(alphabet=st.sampled_from(list("<>&;ab# \n \x1duml/ltgp39")), max_size=40), min_size=20, max_size=60))
def test_strip_html_property(spark, texts):
    assert evaluate(spark, texts, fn.strip_html) == [expected_text(t) for t in texts]


DATES = [
    "2026-03-01", "2026-03-01T10:00:00Z", "20260301", "20260301T10", "2026-W10", "2026-W10-3",
    "2026W103", "2026W10", "2026W103xy", "2026W10xyz", "2026-W10xx", "20260301x", "2026030112", "2020-W53-7", "2021-W53-1", "2021-W00-1", "2026-3-1", "2026-03",
    "2026-02-30", "20260230", "0000-01-01", "0001-01-01", "9999-12-31", "9999-W52-7", "", "soon",
    " 2026-03-01", "2026-03-01\n", None,
]


def test_lenient_date(spark):
    def iso(text):
        try:
            return datetime.date.fromisoformat(text[:10])
        except (ValueError, TypeError):
            return None

    assert evaluate(spark, DATES, fn.lenient_date) == [iso(d) for d in DATES]


@pytest.mark.parametrize(
    ("terms", "expected"),
    [
        ([], [True, True, True, True, True]),
        (["Germany"], [True, True, True, False, False]),
        (["germany", "FRANCE"], [True, True, True, True, False]),
        ([""], [True] * 5),
        (["nowhere"], [False] * 5),
    ],
)
def test_contains_any(spark, terms, expected):
    places = ["Germany, Ulm", "Ulm, Germany", "KIEL, GERMANY", "Lyon, France", None]
    assert evaluate(spark, places, lambda c: fn.contains_any(c, terms)) == expected


def test_contains_any_many_terms(spark):
    terms = [f"town {i}" for i in range(300)] + ["Munich"]
    places = ["Munich, Germany", "TOWN 7", "Berlin", None]
    assert evaluate(spark, places, lambda c: fn.contains_any(c, terms)) == [True, True, False, False]


def test_unique_key_and_ids(spark):
    rows = spark.createDataFrame([("Acme", 4711), ("Acme", None)], "company string, id bigint")
    out = rows.select(fn.unique_key(F.col("company"), fn.id_text(F.col("id"))).alias("k")).collect()
    assert [r.k for r in out] == ["Acme::4711", "Acme::"]


def test_place(spark):
    rows = [("Munich", "DE"), ("Munich", ""), ("", "DE"), ("", ""), (None, None), (", Ulm ,", "DE")]
    frame = spark.createDataFrame(rows, "city string, country string")
    out = [r.p for r in frame.select(fn.place(F.col("city"), F.col("country")).alias("p")).collect()]
    assert out == [f"{c or ''}, {k or ''}".strip(", ") for c, k in rows]


def test_non_empty_and_first(spark):
    frame = spark.createDataFrame(
        [("", "b", []), ("a", "b", ["x", "y"]), (None, None, None)], "a string, b string, c array<string>"
    )
    out = frame.select(
        fn.non_empty(F.col("a"), F.col("b")).alias("n"), fn.first_or_default(F.col("c")).alias("f")
    ).collect()
    assert [(r.n, r.f) for r in out] == [("b", ""), ("a", "x"), ("", "")]


def test_fingerprints(spark):
    base = Search("s", "profile text", title_keywords=("b", "a"), salary_min=150_000)
    assert evaluate(spark, [base.profile], fn.fingerprint) == [base.profile_hash]
    assert len(base.requirements_hash) == 16
    reordered = Search("s", "other", title_keywords=("a", "b"), salary_min=150_000)
    assert reordered.requirements_hash == base.requirements_hash
    assert reordered.profile_hash != base.profile_hash
    raised = Search("s", "profile text", title_keywords=("a", "b"), salary_min=200_000)
    assert raised.requirements_hash != base.requirements_hash
    # The digest of the canonical text, written out.
    text = (
        '{"hard": {"salary_min": 150000, "title_keywords": ["a", "b"]}, '
        '"soft": {"preferred_industries": [], "prefers_remote": false}}'
    )
    assert evaluate(spark, [text], fn.fingerprint) == [base.requirements_hash]


ANSWERS = [
    ('{"hard_fail": false, "fit_score": 64}', (64, 0, False, "", True)),
    ('My view: {"fit_score": 31} and that is all.', (31, 0, False, "", True)),
    ("not json", (0, 0, False, "", False)),
    ("", (0, 0, False, "", False)),
    (None, (0, 0, False, "", False)),
    (
        '{"fit_score": 70, "desirability_score": 20, "hard_fail": true, "hard_fail_reason": "Pay too low."}',
        (70, 20, True, "Pay too low.", True),
    ),
    ('{"fit_score": "85", "desirability_score": 85.9}', (85, 85, False, "", True)),
    ('{"fit_score": null, "hard_fail_reason": null, "hard_fail": "false"}', (0, 0, False, "", True)),
    ('{"fit_score": 1} and {"fit_score": 2}', (0, 0, False, "", False)),
    ('{"fit_score": 1}, {"fit_score": 2}', (0, 0, False, "", False)),
    ('{"fit_score": 1}] [{"fit_score": 2}', (0, 0, False, "", False)),
    ('{"fit_score": 1}} {"fit_score": 2}', (0, 0, False, "", False)),
    ('{"fit_score": {"a": [1, {"b": "}"}]}, "desirability_score": 7}', (0, 7, False, "", True)),
]


def test_answers(spark):
    frame = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(ANSWERS)], "i int, a string")
    rows = fn.with_answer_columns(frame, "a").orderBy("i").collect()
    got = [
        (r.fit_score, r.desirability_score, r.hard_fail, r.hard_fail_reason, r.parse_ok) for r in rows
    ]
    assert got == [expected for _, expected in ANSWERS]
    assert all(isinstance(json.loads(r.score_detail), dict) for r in rows)


def test_json_slice(spark):
    out = evaluate(spark, [a for a, _ in ANSWERS], fn.json_slice)
    assert out[1] == '{"fit_score": 31}'
    assert [o is not None for o in out] == [expected[-1] for _, expected in ANSWERS]


def test_detail_round_trip(spark):
    frame = spark.createDataFrame([(1, "x")], "n int, s string")
    text = frame.select(fn.encode_detail(F.struct("n", "s")).alias("t"))
    out = text.select(F.variant_get(fn.decode_detail(F.col("t")), "$.s", "string").alias("s")).first()
    assert out.s == "x"
    assert evaluate(spark, ["", None], lambda c: F.to_json(fn.decode_detail(c))) == ["{}", "{}"]


def test_requirement_text(spark):
    searches = [
        Search("full", "p", salary_min=150_000, title_keywords=("a", "b"), prefers_remote=True,
               preferred_industries=("x", "y")),
        Search("none", "p"),
        Search("zero", "p", salary_min=0),
    ]
    rows = {r.name: r for r in searches_frame(spark, searches).collect()}
    assert rows["full"].hard_text.startswith("- Minimum salary: 150,000 (")
    assert rows["full"].hard_text.endswith("\n- Title must match one of: a, b")
    assert rows["full"].soft_text == "- Prefers remote or hybrid\n- Preferred industries: x, y"
    assert rows["none"].hard_text == rows["none"].soft_text == "None specified"
    assert rows["zero"].hard_text == "None specified"


def test_prompt_takes_text_literally(spark):
    values = ["{profile} %s", "H", "S", "T $1", "C", "L", "D", "100% {x}"]
    frame = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(8)))
    text = frame.select(prompt(*[F.col(f"c{i}") for i in range(8)]).alias("p")).first().p
    assert all(value in text for value in values)
    assert all(name in text for name in ANSWER_FIELDS)


def test_gate_reason(spark):
    search = Search("s", "p", title_keywords=("it's", 'say "x"'))
    out = evaluate(spark, ["Cook"], lambda c: gate_reason(c, F.lit(search.keyword_list)))
    assert out == [f"Title 'Cook' does not match required keywords: {list(search.title_keywords)}"]
