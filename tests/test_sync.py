"""Snapshot operators and the synchronisation run."""

import datetime as dt
import json
import sys

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from landed import ACME, BOARD, FEED, SEARCH, detail, flat_feed, listing, page, posting
from pyspark.sql import functions as F

from postledger import schemas
from postledger.operators.enrich import enrich
from postledger.operators.reports import counts
from postledger.operators.snapshot import (
    choose_keys,
    choose_listed,
    closed_keys,
    first_wins,
    known_keys,
    last_wins,
    merge_snapshot,
    new_rows,
)
from postledger.plans import sync, sync_bodies
from postledger.tables import Ledger

T1, T2, T3 = (dt.datetime(2026, 1, day, 6) for day in (1, 2, 3))


def state_of(spark, rows):
    return spark.createDataFrame(
        [(k, k.split("::")[0], ts, active, "kept", None) for k, ts, active in rows], schemas.STATE
    )


def incoming_of(spark, keys):
    rows = [(k, k.split("::")[0], i) for i, k in enumerate(keys)]
    return spark.createDataFrame(rows, "unique_key string, company string, row_id bigint")


def scanned_of(spark, **companies):
    return spark.createDataFrame(list(companies.items()), schemas.SCANNED)


def merged(spark, state, keys, run_ts=T2, **companies):
    out = merge_snapshot(
        state_of(spark, state), incoming_of(spark, keys), scanned_of(spark, **companies), F.lit(run_ts)
    )
    return {r.unique_key: (r.change, r.last_seen, r.is_active) for r in out.collect()}


def test_merge_insert_touch_close_reopen(spark):
    state = [("A::1", T1, True), ("A::2", T1, True), ("A::3", T1, False), ("A::4", T1, False), ("B::1", T1, True)]
    out = merged(spark, state, ["A::1", "A::3", "A::9"], A=True)
    assert out == {
        "A::1": ("seen", T2, True),
        "A::2": ("closed", T2, False),
        "A::3": ("reopened", T2, True),
        "A::4": ("kept", T1, False),
        "A::9": ("new", T2, True),
        "B::1": ("kept", T1, True),
    }


def test_empty_complete_snapshot_closes_the_company_only(spark):
    out = merged(spark, [("A::1", T1, True), ("B::1", T1, True)], [], A=True)
    assert out["A::1"] == ("closed", T2, False)
    assert out["B::1"] == ("kept", T1, True)


def test_incomplete_snapshot_closes_nothing(spark):
    out = merged(spark, [("A::1", T1, True), ("A::2", T1, True)], ["A::2", "A::3"], A=False)
    assert {k: v[0] for k, v in out.items()} == {"A::1": "kept", "A::2": "seen", "A::3": "new"}


def test_same_id_at_two_companies(spark):
    assert set(merged(spark, [], ["A::1", "B::1"], A=True, B=True)) == {"A::1", "B::1"}


def test_key_sets(spark):
    state = state_of(spark, [("A::1", T1, True), ("A::2", T1, False), ("A::3", T1, True), ("B::1", T1, True)])
    incoming = incoming_of(spark, ["A::1", "A::2", "A::9"])
    assert {r.unique_key for r in known_keys(state).collect()} == {"A::1", "A::2", "A::3", "B::1"}
    assert {r.unique_key for r in new_rows(incoming, state).collect()} == {"A::9"}
    closed = closed_keys(state, incoming, scanned_of(spark, A=True))
    assert {r.unique_key for r in closed.collect()} == {"A::3"}
    assert closed_keys(state, incoming, scanned_of(spark, A=False)).count() == 0
    assert counts(state).first().asDict() == {"total": 4, "active": 3}


def test_copies_of_a_key(spark):
    rows = spark.createDataFrame(
        [("k", 1, "one", "x"), ("k", 2, "two", "in"), ("k", 3, "three", "in"), ("k", 4, "four", "x"),
         ("j", 5, "five", "x"), ("j", 6, "six", "x")],
        "unique_key string, ordinal bigint, title string, location string",
    )
    pick = lambda frame: {r.unique_key: r.title for r in frame.collect()}
    assert pick(first_wins(rows, ["unique_key"])) == {"k": "one", "j": "five"}
    assert pick(last_wins(rows, ["unique_key"])) == {"k": "four", "j": "six"}
    in_region = F.col("location") == "in"
    assert pick(choose_listed(rows, in_region)) == {"k": "three", "j": "five"}
    rows = rows.withColumns({"company": F.substring("unique_key", 1, 1), "row_id": F.col("ordinal") * 10})
    chosen = {r.unique_key: (r.company, r.row_id, r.in_region) for r in choose_keys(rows, in_region).collect()}
    assert chosen == {"k": ("k", 30, True), "j": ("j", 50, False)}


def test_copies_are_limited_before_the_shuffle(spark):
    rows = spark.range(1000).select((F.col("id") % 2).alias("unique_key"), F.col("id").alias("ordinal"))
    plan = first_wins(rows, ["unique_key"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_enrich(spark):
    rows = spark.createDataFrame(
        [("a", "r1", "", ""), ("b", "r2", "", ""), ("c", "gone", "own", "D"), ("d", None, "own", "D")],
        "unique_key string, detail_ref string, raw_description string, department string",
    )
    details = spark.createDataFrame(
        # Details land again: the last one counts, and makes no second row.
        [("r1", "old", "Land", 1), ("r1", "text", "Sea", 2), ("r2", "other", None, 1), ("r2", "other", None, 1), ("r9", "x", None, 1)],
        "detail_ref string, detail_description string, detail_department string, detail_order bigint",
    )
    assert enrich(rows, details).count() == 4
    out = {r.unique_key: (r.raw_description, r.department, r.enriched) for r in enrich(rows, details).collect()}
    assert out == {
        "a": ("text", "Sea", True),
        "b": ("other", "", True),
        "c": ("own", "D", False),
        "d": ("own", "D", False),
    }


SNAPSHOTS = st.lists(
    st.dictionaries(
        st.sampled_from("AB"), st.tuples(st.sets(st.integers(0, 5)), st.booleans()), max_size=2
    ),
    min_size=1,
    max_size=3,
)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(SNAPSHOTS)
def test_merges_equal_a_row_by_row_replay(spark, snapshots):
    """Set-based merges against saving and closing one company after the other."""
    expected = {}
    frame = state_of(spark, [])
    for step, snapshot in enumerate(snapshots):
        stamp = T1 + dt.timedelta(days=step)
        for company, (ids, is_complete) in snapshot.items():
            keys = {f"{company}::{i}" for i in ids}
            for key in keys:
                expected[key] = (stamp, True)
            for key, (_, active) in list(expected.items()):
                if is_complete and active and key.startswith(company) and key not in keys:
                    expected[key] = (stamp, False)
        keys = [f"{c}::{i}" for c, (ids, _) in snapshot.items() for i in sorted(ids)]
        scanned = {c: flag for c, (_, flag) in snapshot.items()}
        scanned_frame = spark.createDataFrame(list(scanned.items()), schemas.SCANNED)
        frame = merge_snapshot(frame, incoming_of(spark, keys), scanned_frame, F.lit(stamp))
        rows = [tuple(r) for r in frame.collect()]
        frame = spark.createDataFrame(rows, schemas.STATE)
    assert {r.unique_key: (r.last_seen, r.is_active) for r in frame.collect()} == expected


# ---- the run ------------------------------------------------------------------------


@pytest.fixture
def ledger(spark, tmp_path):
    return Ledger(spark, str(tmp_path / "ledger"))


def landed(tmp_path, name):
    path = tmp_path / name
    path.mkdir()
    return path


def describe(number):
    return {"jobPostingInfo": {"jobDescription": f"<p>Text {number}</p>", "jobCategory": {"descriptor": "Lab"}}}


def report(frame):
    return {r.company: r for r in frame.collect()}


def first_day(root):
    postings = [posting(1), posting(2, place="Germany, Bonn"), posting(3, place="USA, Reno")]
    listing(root, ACME, page(postings))
    for p, number in zip(postings, (1, 2, 3), strict=True):
        detail(root, ACME, p["externalPath"], describe(number))
    feed = [
        {"jobid": "7", "title": "Pilot", "description": "<b>Fly</b>", "locations": [{"country": "Germany"}]},
        {"jobid": "8", "title": "Cook", "description": "Cook", "locations": [{"country": "Peru"}]},
    ]
    listing(root, FEED, flat_feed(*feed))
    return postings


def test_first_run_stores_all_and_enriches_matching(spark, tmp_path, ledger):
    root = landed(tmp_path, "day1")
    first_day(root)
    out = report(sync(ledger, str(root), [ACME, FEED], ["germany"], T1))
    acme = out["Acme"]
    assert (acme.listed, acme.region_matched, acme.enriched, acme.new, acme.closed) == (3, 2, 2, 3, 0)
    jobs = {r.unique_key: r for r in ledger.jobs().collect()}
    assert {k: (j.description, j.department) for k, j in jobs.items()} == {
        "Acme::R1": ("Text 1", "Lab"),
        "Acme::R2": ("Text 2", "Lab"),
        # Details outside the regions do not count.
        "Acme::R3": ("", ""),
        # Inline text does, wherever the listing is.
        "Delta::7": ("Fly", ""),
        "Delta::8": ("Cook", ""),
    }
    assert {(j.first_seen, j.last_seen, j.is_active, j.has_description == (j.description != "")) for j in jobs.values()} == {
        (T1, T1, True, True)
    }


def test_second_run_writes_text_once_and_closes(spark, tmp_path, ledger):
    postings = first_day(landed(tmp_path, "day1"))
    sync(ledger, str(tmp_path / "day1"), [ACME, FEED], ["germany"], T1)
    root = landed(tmp_path, "day2")
    changed = {**postings[0], "title": "Changed title"}
    listing(root, ACME, page([changed, posting(4)]))
    detail(root, ACME, changed["externalPath"], describe("again"))
    out = report(sync(ledger, str(root), [ACME, FEED], ["germany"], T2))
    # The feed did not land: it is neither reported nor closed.
    assert set(out) == {"Acme"}
    assert (out["Acme"].new, out["Acme"].closed, out["Acme"].enriched) == (1, 2, 1)
    jobs = {r.unique_key: r for r in ledger.jobs().collect()}
    assert (jobs["Acme::R1"].title, jobs["Acme::R1"].description) == ("Engineer", "Text 1")
    assert (jobs["Acme::R1"].first_seen, jobs["Acme::R1"].last_seen) == (T1, T2)
    assert (jobs["Acme::R2"].is_active, jobs["Acme::R2"].last_seen) == (False, T2)
    # Without a detail document the row stays as it is.
    assert (jobs["Acme::R4"].description, jobs["Acme::R4"].first_seen) == ("", T2)
    assert (jobs["Delta::7"].is_active, jobs["Delta::7"].last_seen) == (True, T1)

    again = landed(tmp_path, "day3")
    listing(again, ACME, page(postings))
    out = report(sync(ledger, str(again), [ACME], ["germany"], T3))
    assert (out["Acme"].new, out["Acme"].reopened, out["Acme"].closed) == (0, 2, 1)
    jobs = {r.unique_key: r for r in ledger.jobs().collect()}
    assert (jobs["Acme::R2"].is_active, jobs["Acme::R2"].first_seen, jobs["Acme::R2"].description) == (
        True, T1, "Text 2",
    )


def test_running_twice_changes_nothing(spark, tmp_path, ledger):
    root = landed(tmp_path, "day1")
    first_day(root)
    sync(ledger, str(root), [ACME, FEED], [], T1)
    before = sorted(map(tuple, ledger.jobs().drop("run").collect()))
    out = report(sync(ledger, str(root), [ACME, FEED], [], T1))
    assert [(r.new, r.closed, r.enriched) for r in out.values()] == [(0, 0, 0)] * 2
    assert sorted(map(tuple, ledger.jobs().drop("run").collect())) == before


def test_copies_in_one_listing(spark, tmp_path, ledger):
    root = landed(tmp_path, "day1")
    copies = [posting(1, "First", "USA"), posting(1, "Second", "Germany"), posting(1, "Third", "Germany")]
    others = [posting(2, "First", "USA"), posting(2, "Second", "Peru")]
    listing(root, ACME, page(copies + others))
    detail(root, ACME, copies[2]["externalPath"], describe("third"))
    out = report(sync(ledger, str(root), [ACME], ["germany"], T1))
    assert (out["Acme"].listed, out["Acme"].new) == (5, 2)
    jobs = {r.unique_key: (r.title, r.description) for r in ledger.jobs().collect()}
    assert jobs == {"Acme::R1": ("Third", "Text third"), "Acme::R2": ("First", "")}


def test_a_page_that_landed_twice_stores_one_row_per_key(spark, tmp_path, ledger):
    text = json.dumps(page([posting(1), posting(2)]))
    bodies = [("workday", "Acme", 0, text), ("workday", "Acme", 0, text)]
    frame = spark.createDataFrame(bodies, "source string, company string, offset bigint, body string")
    sync_bodies(ledger, frame, None, [ACME], [], T1)
    assert sorted(r.unique_key for r in ledger.jobs().collect()) == ["Acme::R1", "Acme::R2"]


def test_missing_ids_share_one_key(spark, tmp_path, ledger):
    root = landed(tmp_path, "day1")
    listing(root, FEED, flat_feed({"title": "a"}, {"title": "b"}))
    out = report(sync(ledger, str(root), [FEED], [], T1))
    assert (out["Delta"].listed, out["Delta"].missing_id, out["Delta"].new) == (2, 2, 1)


def test_empty_listing_closes_all(spark, tmp_path, ledger):
    first_day(landed(tmp_path, "day1"))
    sync(ledger, str(tmp_path / "day1"), [ACME, FEED], [], T1)
    root = landed(tmp_path, "day2")
    listing(root, FEED, flat_feed())
    listing(root, ACME, page([], 3))
    out = report(sync(ledger, str(root), [ACME, FEED], [], T2))
    assert (out["Delta"].complete, out["Delta"].closed) == (True, 2)
    # Three were announced and none came: that listing is incomplete.
    assert (out["Acme"].complete, out["Acme"].closed) == (False, 0)
    assert counts(ledger.current_state()).first().asDict() == {"total": 5, "active": 3}


def test_a_run_that_died_is_ignored_and_repeated(spark, tmp_path, ledger, monkeypatch):
    root = landed(tmp_path, "day1")
    first_day(root)
    module = sys.modules["postledger.plans.sync"]

    def broken(*args):
        raise RuntimeError("lost")

    monkeypatch.setattr(module, "listing_report", broken)
    with pytest.raises(RuntimeError):
        sync(ledger, str(root), [ACME, FEED], [], T1)
    assert counts(ledger.current_state()).first().total == 0
    monkeypatch.undo()
    sync(ledger, str(root), [ACME, FEED], [], T2)
    assert counts(ledger.current_state()).first().total == 5
    assert ledger.jobs().where(F.col("first_seen") == T2).count() == 5


def test_documents_as_rows_give_the_same_state(spark, tmp_path, ledger):
    root = landed(tmp_path, "day1")
    first_day(root)
    sync(ledger, str(root), [ACME, FEED, BOARD, SEARCH], ["germany"], T1)
    files = [p for p in root.rglob("*") if p.is_file()]
    listings, details = [], []
    for path in files:
        parts = path.relative_to(root).parts
        ats, company = parts[0].split("=")[1], parts[2].split("=")[1]
        if parts[1] == "listing":
            listings.append((ats, company, int(path.stem), path.read_text()))
        else:
            details.append((ats, company, "/" + "/".join(parts[3:]).removesuffix(".json"), path.read_text()))
    other = Ledger(spark, str(tmp_path / "other"))
    sync_bodies(
        other,
        spark.createDataFrame(listings, "source string, company string, offset bigint, body string"),
        spark.createDataFrame(details, "source string, company string, detail_key string, body string"),
        [ACME, FEED, BOARD, SEARCH],
        ["germany"],
        T1,
    )
    assert sorted(map(tuple, other.jobs().collect())) == sorted(map(tuple, ledger.jobs().collect()))


def test_nothing_landed_is_an_error(spark, tmp_path, ledger):
    with pytest.raises(ValueError, match="no landed listings"):
        sync(ledger, str(tmp_path / "nowhere"), [ACME], [], T1)
