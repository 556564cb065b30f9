"""Search matching, staleness, the scoring run, and ranking."""

import datetime as dt
import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from postledger import schemas
from postledger.config import Search, load_companies, load_searches, read_document, searches_frame
from postledger.operators.matching import gate_failures, match_searches, stale
from postledger.operators.ranking import rank_search, rank_searches
from postledger.operators.reports import search_report
from postledger.operators.scoring import ANSWER_KEYS, ask, offline_scorer, upsert_scores
from postledger.plans import rank, rank_all, score, sync_listed
from postledger.tables import Ledger

# Workers cannot import this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

T1, T2 = dt.datetime(2026, 1, 1, 6), dt.datetime(2026, 1, 2, 6)

LEAD = Search("Lead Germany", "knows steel", ("Germany", "DE"), 150_000, ("lead", "head of"), True)
ANY = Search("Anything", "likes tea")
PERU = Search("Peru", "speaks Quechua", ("peru",), title_keywords=("cook",))
SEARCHES = [LEAD, ANY, PERU]


def listed(spark, rows):
    """(id, title, location, text) at one company, as listed rows."""
    full = [
        (f"Acme::{i}", "Acme", i, title, "u", place, "", text, None, n, None, None, False, True)
        for n, (i, title, place, text) in enumerate(rows)
    ]
    return spark.createDataFrame(full, schemas.LISTED)


JOBS = [
    ("1", "Lead Engineer", "Germany, Ulm", "steel"),
    ("2", "Cook", "Munich, DE", "soup"),
    ("3", "Cook", "Lima, PERU", "soup"),
    ("4", "Lead", "Lima, Peru", ""),
    ("5", "Head of Delaware", "Delaware", "x"),
]


@pytest.fixture
def ledger(spark, tmp_path):
    made = Ledger(spark, str(tmp_path / "ledger"))
    sync_listed(made, listed(spark, JOBS), None, [], T1)
    return made


def reply(fit, desirability, **more):
    return json.dumps({"fit_score": fit, "desirability_score": desirability, **more})


class Recorder:
    """A scorer on the driver's side of a local session cannot be seen from tasks, so the
    prompts are kept in a file."""

    def __init__(self, path, answer):
        self.path, self.answer = str(path), answer

    def __call__(self, prompts):
        with open(self.path, "a") as out:
            for prompt in prompts:
                out.write(json.dumps(prompt) + "\n")
        return [self.answer(prompt) for prompt in prompts]

    def prompts(self):
        try:
            with open(self.path) as lines:
                return [json.loads(line) for line in lines]
        except FileNotFoundError:
            return []


def pairs_of(frame):
    return {(r.unique_key.split("::")[1], r.search_name) for r in frame.collect()}


def test_match_searches(spark):
    rows = listed(spark, JOBS)
    assert pairs_of(match_searches(rows, SEARCHES)) == {
        ("1", LEAD.name), ("2", LEAD.name), ("5", LEAD.name),
        ("1", ANY.name), ("2", ANY.name), ("3", ANY.name), ("4", ANY.name), ("5", ANY.name),
        ("3", PERU.name), ("4", PERU.name),
    }
    assert match_searches(rows, []).count() == 0


def test_more_searches_than_one_pass_holds(spark):
    many = [Search(f"s{i}", "p", ("Ulm",) if i % 2 else ("Lima",)) for i in range(450)]
    out = match_searches(listed(spark, JOBS), many).groupBy("search_name").count().collect()
    assert {r.search_name: r["count"] for r in out} == {s.name: 1 if s.regions == ("Ulm",) else 2 for s in many}


def test_title_gate(spark):
    matched = match_searches(listed(spark, JOBS), [LEAD])
    frame = searches_frame(spark, [LEAD])
    rows = gate_failures(matched, frame).collect()
    (row,) = rows
    assert row.unique_key == "Acme::2"
    assert (row.fit_score, row.desirability_score, row.hard_fail, row.stage_reached) == (0, 0, True, 1)
    assert row.hard_fail_reason == "Title 'Cook' does not match required keywords: ['lead', 'head of']"


def score_row(key, search, fit=70, desirability=70, hard_fail=False, profile=None, requirements=None):
    return (f"Acme::{key}", search, fit, desirability, hard_fail, "", "{}", 3, profile, requirements, T1, True)


def test_stale(spark):
    matched = match_searches(listed(spark, JOBS), [ANY, PERU])
    current = dict(profile=ANY.profile_hash, requirements=ANY.requirements_hash)
    stored = [
        score_row("1", ANY.name, **current),
        score_row("2", ANY.name, **{**current, "profile": "old"}),
        score_row("3", ANY.name, **{**current, "requirements": "old"}),
        # A score of another search does not count.
        score_row("4", PERU.name, **current),
    ]
    scores = spark.createDataFrame(stored, schemas.SCORES)
    assert pairs_of(stale(matched, scores)) == {
        ("2", ANY.name), ("3", ANY.name), ("4", ANY.name), ("5", ANY.name),
        ("3", PERU.name), ("4", PERU.name),
    }


def test_upsert_replaces_whole_rows(spark):
    old = spark.createDataFrame([score_row("1", "a", 1), score_row("2", "a", 2)], schemas.SCORES)
    new = spark.createDataFrame([score_row("1", "a", 9), score_row("1", "b", 3)], schemas.SCORES)
    out = {(r.unique_key, r.search_name): r.fit_score for r in upsert_scores(old, new).collect()}
    assert out == {("Acme::1", "a"): 9, ("Acme::2", "a"): 2, ("Acme::1", "b"): 3}


def test_offline_scorer_is_deterministic_and_in_range():
    first, second = offline_scorer(["a", "b"]), offline_scorer(["a", "b"])
    assert first == second and first[0] != first[1]
    assert all(0 <= json.loads(a)["fit_score"] <= 100 for a in first)


def test_a_scorer_must_answer_every_prompt(spark):
    prompts = spark.createDataFrame([("k", "s", "p", "r", "text")], [*ANSWER_KEYS, "prompt"])
    with pytest.raises(Exception, match="1 prompts but 0 answers"):
        ask(prompts, lambda texts: []).collect()


def test_a_refused_prompt_costs_no_other_answer(spark, ledger, tmp_path):
    refused = Recorder(tmp_path / "one", lambda p: 1 / 0 if "steel\n" in p and ANY.profile in p else reply(70, 70))
    report = score(ledger, SEARCHES, T1, refused, tasks=2)
    counts = {r.search_name: r.failed_calls for r in report.collect() if r.failed_calls}
    assert counts == {ANY.name: 1}
    kept = ledger.current_scores().count()
    again = Recorder(tmp_path / "two", lambda p: reply(70, 70))
    score(ledger, SEARCHES, T2, again)
    assert len(again.prompts()) == 1 and ledger.current_scores().count() == kept + 1


def stored(ledger):
    return {
        (r.unique_key.split("::")[1], r.search_name): r for r in ledger.current_scores().collect()
    }


def test_scoring_run(spark, ledger, tmp_path):
    scorer = Recorder(tmp_path / "prompts", lambda p: f"Sure: {reply(82, 68, hard_fail_reason='')}")
    out = score(ledger, SEARCHES, T1, scorer)
    assert {(r.search_name, r.stage_reached): (r.processed, r.hard_failed) for r in out.collect()} == {
        (LEAD.name, 1): (1, 1), (LEAD.name, 3): (2, 0), (ANY.name, 3): (4, 0), (PERU.name, 3): (1, 0),
    }
    rows = stored(ledger)
    # Job 4 has no text and is never scored.
    assert ("4", PERU.name) not in rows and ("4", ANY.name) not in rows
    assert rows["2", LEAD.name].stage_reached == 1
    row = rows["1", LEAD.name]
    assert (row.fit_score, row.desirability_score, row.hard_fail, row.stage_reached) == (82, 68, False, 3)
    assert (row.profile_hash, row.requirements_hash) == (LEAD.profile_hash, LEAD.requirements_hash)
    assert json.loads(row.score_detail)["fit_score"] == 82
    (mine,) = [p for p in scorer.prompts() if "knows steel" in p and "Lead Engineer" in p]
    assert "150,000" in mine and "Germany, Ulm" in mine and "steel" in mine
    assert len(scorer.prompts()) == 7

    # Nothing is stale any more.
    again = score(ledger, SEARCHES, T2, scorer)
    assert again.count() == 0 and len(scorer.prompts()) == 7
    assert len(stored(ledger)) == 8

    # A changed profile makes one search stale, changed requirements as well.
    changed = Search(ANY.name, "likes coffee")
    score(ledger, [changed, LEAD, PERU], T2, scorer)
    assert len(scorer.prompts()) == 11
    assert {k for k, r in stored(ledger).items() if r.scored_at == T2} == {
        (i, ANY.name) for i in "1235"
    }


def test_one_search_only(spark, ledger, tmp_path):
    scorer = Recorder(tmp_path / "prompts", lambda p: reply(1, 2))
    score(ledger, SEARCHES, T1, scorer, target=PERU.name)
    assert set(stored(ledger)) == {("3", PERU.name)}
    with pytest.raises(ValueError, match="no search named"):
        score(ledger, SEARCHES, T1, scorer, target="unknown")


def test_closed_listings_are_not_scored(spark, ledger, tmp_path):
    sync_listed(ledger, listed(spark, JOBS[1:]), None, [], T2)
    score(ledger, [ANY], T2, Recorder(tmp_path / "p", lambda p: reply(1, 1)))
    assert set(stored(ledger)) == {("2", ANY.name), ("3", ANY.name), ("5", ANY.name)}


def test_bad_answers_score_zero_and_are_counted(spark, ledger, tmp_path):
    out = score(ledger, [ANY], T1, Recorder(tmp_path / "p", lambda p: "oops"))
    assert [(r.processed, r.unreadable) for r in out.collect()] == [(4, 4)]
    assert {(r.fit_score, r.stage_reached, r.score_detail) for r in stored(ledger).values()} == {(0, 3, "{}")}


def test_a_run_that_died_after_asking_does_not_ask_again(spark, ledger, tmp_path, monkeypatch):
    module = sys.modules["postledger.plans.score"]
    scorer = Recorder(tmp_path / "prompts", lambda p: reply(5, 6))

    def broken(*args):
        raise RuntimeError("lost")

    monkeypatch.setattr(module, "upsert_scores", broken)
    with pytest.raises(RuntimeError):
        score(ledger, [ANY], T1, scorer)
    assert len(scorer.prompts()) == 4 and stored(ledger) == {}
    monkeypatch.undo()
    score(ledger, [ANY, PERU], T2, scorer)
    # Only the search that the dead run did not have was asked for.
    assert len(scorer.prompts()) == 5
    assert len(stored(ledger)) == 5


def test_no_searches(spark, ledger):
    assert score(ledger, [], T1).count() == 0


# ---- ranking ------------------------------------------------------------------------


@pytest.fixture
def ranked(spark):
    keys = [f"Acme::{i}" for i in range(8)]
    jobs = spark.createDataFrame([(k, "t", i != 3) for i, k in enumerate(keys)], "unique_key string, title string, is_active boolean")
    rows = [
        score_row("0", "a", 90, 60), score_row("1", "a", 60, 90), score_row("2", "a", 99, 99, True),
        score_row("3", "a", 95, 95), score_row("4", "a", 59, 99), score_row("5", "a", 99, 59),
        score_row("6", "a", 61, 61), score_row("7", "b", 80, 80), score_row("99", "a", 100, 100),
    ]
    return jobs, spark.createDataFrame(rows, schemas.SCORES)


def ids(rows):
    return [r.unique_key.split("::")[1] for r in rows.collect()]


def test_rank_search(ranked):
    jobs, scores = ranked
    # A hard fail, too low scores and a score without a listing are left out; a tie is
    # ordered by key; closed listings rank unless asked otherwise.
    assert ids(rank_search(jobs, scores, "a")) == ["3", "0", "1", "6"]
    assert ids(rank_search(jobs, scores, "a", limit=2)) == ["3", "0"]
    assert ids(rank_search(jobs, scores, "a", active_only=True)) == ["0", "1", "6"]
    assert ids(rank_search(jobs, scores, "a", min_fit=0, min_desirability=0)) == ["3", "4", "5", "0", "1", "6"]
    assert ids(rank_search(jobs, scores, "nothing")) == []


def test_ranking_does_not_shuffle_wide_rows(spark, ledger, tmp_path):
    score(ledger, [ANY], T1, Recorder(tmp_path / "p", lambda p: reply(90, 90)))
    plan = rank(ledger, ANY.name)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "In(unique_key" in plan
    assert "SinglePartition" not in plan


@pytest.mark.parametrize("limit", [1, 2, 5000])
def test_rank_searches(ranked, limit):
    jobs, scores = ranked
    out = rank_searches(jobs, scores, ["a", "b"], limit=limit).collect()
    got = {(r.search_name, r["rank"]): r.unique_key.split("::")[1] for r in out}
    best = {("a", 1): "3", ("a", 2): "0", ("a", 3): "1", ("a", 4): "6", ("b", 1): "7"}
    assert got == {k: v for k, v in best.items() if k[1] <= limit}


def test_rank_of_a_ledger(spark, ledger, tmp_path):
    answer = lambda p: reply(90 if "steel\n" in p else 70, 70)
    score(ledger, SEARCHES, T1, Recorder(tmp_path / "p", answer))
    rows = rank(ledger, ANY.name, limit=3)
    assert {"title", "description", "last_seen", "fit_score", "score_detail"} <= set(rows.columns)
    assert ids(rows) == ["1", "2", "3"]
    assert ids(rank(ledger, ANY.name, limit=5000)) == ["1", "2", "3", "5"]
    # A search that is no longer configured does not rank.
    assert {r.search_name for r in rank_all(ledger, SEARCHES[:1], limit=5).collect()} == {SEARCHES[0].name}
    everything = rank_all(ledger, SEARCHES, limit=1).collect()
    assert {(r.search_name, r.unique_key.split("::")[1]) for r in everything} == {
        (LEAD.name, "1"), (ANY.name, "1"), (PERU.name, "3"),
    }


def test_search_report(spark):
    rows = spark.createDataFrame([score_row("1", "a"), score_row("2", "a", hard_fail=True)], schemas.SCORES)
    (row,) = search_report(rows).collect()
    assert (row.search_name, row.stage_reached, row.processed, row.hard_failed) == ("a", 3, 2, 1)


# ---- configuration ------------------------------------------------------------------


def test_configuration_defaults(tmp_path):
    profile = tmp_path / "profile.md"
    profile.write_text("me")
    document = {
        "searches": [
            {"name": "bare", "profile_path": str(profile)},
            {
                "name": "full",
                "profile_path": "given",
                "regions": ["DE"],
                "requirements": {
                    "hard": {"salary_min": 5, "title_keywords": ["a"]},
                    "soft": {"prefers_remote": True, "preferred_industries": ["x"]},
                },
                "notify": "n",
            },
        ]
    }
    path = tmp_path / "searches.json"
    path.write_text(json.dumps(document))
    bare, full = load_searches(read_document(path), {"given": "text"})
    assert bare == Search("bare", "me")
    assert full == Search("full", "text", ("DE",), 5, ("a",), True, ("x",), "n")
    assert load_searches({}) == []
    for broken in ({"name": "x"}, {"profile_path": str(profile)}):
        with pytest.raises(KeyError):
            load_searches({"searches": [broken]})
    with pytest.raises(FileNotFoundError):
        load_searches({"searches": [{"name": "x", "profile_path": str(tmp_path / "missing.md")}]})


def test_companies_from_yaml(tmp_path):
    pytest.importorskip("yaml")
    path = tmp_path / "companies.yaml"
    path.write_text("regions: [DE]\ncompanies:\n  - {name: A, ats: google, config: {}}\n  - {name: B, ats: greenhouse, config: {board_slug: b}}\n")
    companies, regions = load_companies(read_document(path))
    assert regions == ["DE"]
    assert [(c.name, c.ats, dict(c.config)) for c in companies] == [
        ("A", "google", {}), ("B", "greenhouse", {"board_slug": "b"}),
    ]


def test_many_searches_in_one_pass_over_distinct_places(spark):
    """2,000 searches against locations, as the substring test of each search would have them."""
    places = ["Germany, Ulm", "Lima, PERU", "", None, "Délaware", "ulm"]
    rows = spark.createDataFrame(
        [(f"k{i}", f"Cook {i % 3}", places[i % len(places)]) for i in range(60)], "unique_key string, title string, location string"
    )
    words = ["ulm", "peru", "de", "élaw", "germany, ulm", "x", "lima, peru", ""]
    many = [
        Search(f"s{i}", "p", tuple(words[(i + j) % len(words)] for j in range(i % 3)), title_keywords=("cook 1",) if i % 4 == 0 else ())
        for i in range(2000)
    ]
    got = {(r.unique_key, r.search_name, r.title_ok) for r in match_searches(rows, many).collect()}
    expected = set()
    for r in rows.collect():
        place = (r.location or "").lower()
        for s in many:
            if not s.regions or any(t.lower() in place for t in s.regions):
                expected.add((r.unique_key, s.name, not s.title_keywords or any(k in r.title.lower() for k in s.title_keywords)))
    assert got == expected
    plan = match_searches(rows, many)._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
