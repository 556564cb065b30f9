"""Incremental scoring by high-water marks: same scores as matching everything, fewer reads."""

import datetime as dt
import sys
from dataclasses import replace

import pytest
from pyspark import cloudpickle

from postledger.plans import score, sync_listed
from postledger.tables import Ledger

sys.path.insert(0, __file__.rsplit("/", 1)[0])
from test_scoring import ANY, JOBS, LEAD, PERU, SEARCHES, Recorder, listed, reply  # noqa: E402

cloudpickle.register_pickle_by_value(sys.modules[__name__])

T1, T2, T3 = (dt.datetime(2026, 1, d, 6) for d in (1, 2, 3))
MORE = [("6", "Lead Cook", "Berlin, Germany", "pans"), ("7", "Head of Kitchen", "Cusco, Peru", "soup")]
module = sys.modules["postledger.plans.score"]


def scores(ledger):
    rows = ledger.current_scores().collect()
    return {(r.unique_key, r.search_name, r.profile_hash, r.requirements_hash, r.fit_score) for r in rows}


def both(spark, tmp_path, steps):
    """The same syncs and scoring runs on two ledgers, marks used by one only."""
    made = []
    for incremental in (True, False):
        ledger = Ledger(spark, str(tmp_path / f"ledger-{incremental}"))
        for kind, rows_or_searches, at in steps:
            if kind == "sync":
                sync_listed(ledger, listed(spark, rows_or_searches), None, [], at)
            else:
                answer = Recorder(tmp_path / f"p-{incremental}-{at}", lambda p: reply(len(p) % 90, 5))
                score(ledger, rows_or_searches, at, answer, incremental=incremental)
        made.append(ledger)
    return made


def test_new_postings_and_a_changed_search(spark, tmp_path):
    changed = replace(ANY, profile="likes coffee")
    steps = [("sync", JOBS, T1), ("score", SEARCHES, T1), ("sync", JOBS + MORE, T2), ("score", [LEAD, changed, PERU], T2)]
    marked, full = both(spark, tmp_path, steps)
    assert scores(marked) == scores(full)
    pairs = {(r.search_name, r.stored_run) for r in marked.pairs.read(2).collect()}
    # Unchanged searches met only postings of the second sync run; the changed one all.
    assert {run for name, run in pairs if name != ANY.name} == {2}
    assert {run for name, run in pairs if name == ANY.name} == {1, 2}


def test_an_unchanged_search_reads_no_earlier_postings(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    sync_listed(ledger, listed(spark, JOBS), None, [], T1)
    score(ledger, SEARCHES, T1, Recorder(tmp_path / "p", lambda p: reply(1, 1)))
    sync_listed(ledger, listed(spark, JOBS + MORE), None, [], T2)
    postings = ledger.current_postings().withColumnRenamed("run", "stored_run").select(*module._NARROW)
    active = ledger.current_state().where("is_active").select("unique_key")
    marks = module._marks(ledger)
    changed = replace(ANY, profile="likes coffee")
    for search, earlier in ((LEAD, False), (changed, True)):
        plan = module._unmatched(ledger, postings, active, [search], marks)._jdf.queryExecution().executedPlan()
        # Postings are the scans of titles by their run directory.
        scans = [line for line in plan.toString().splitlines() if "FileScan" in line and "title#" in line and ",run#" in line]
        unpruned = [line for line in scans if "PartitionFilters: []" in line]
        assert scans and bool(unpruned) == earlier, plan.toString()
        if not earlier:
            assert all("> 1)" in line.split("PartitionFilters:")[1] for line in scans), scans


def test_reopened_postings_are_matched_again(spark, tmp_path):
    steps = [
        ("sync", JOBS, T1),
        ("sync", JOBS[1:], T2),
        ("score", [ANY], T2),
        ("sync", JOBS, T3),
        ("score", [ANY], T3),
    ]
    marked, full = both(spark, tmp_path, steps)
    assert scores(marked) == scores(full)
    assert any(key == "Acme::1" for key, *_ in scores(marked))


@pytest.mark.parametrize("change", ["regions", "nothing"])
def test_changed_regions_match_everything_again(spark, tmp_path, change):
    wider = replace(PERU, regions=("peru", "germany")) if change == "regions" else PERU
    steps = [("sync", JOBS, T1), ("score", [PERU], T1), ("sync", JOBS + MORE, T2), ("score", [wider], T2)]
    marked, full = both(spark, tmp_path, steps)
    assert scores(marked) == scores(full)
