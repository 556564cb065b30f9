"""Landed runs merged by a stream of manifests."""

import datetime as dt
import json

import pytest
from landed import ACME, listing, page, posting
from pyspark.sql import functions as F

from postledger.streaming import sync_landed
from postledger.tables import Ledger

DAYS = [dt.datetime(2026, 1, day, 6) for day in (1, 2, 3)]


def land(tmp_path, day, numbers):
    root = tmp_path / f"day{day}"
    listing(root, ACME, page([posting(n) for n in numbers]))
    manifests = tmp_path / "manifests"
    manifests.mkdir(exist_ok=True)
    stamp = DAYS[day].isoformat() + "Z"
    (manifests / f"{day}.json").write_text(json.dumps({"landed_run": str(root), "run_ts": stamp}) + "\n")


def run(spark, ledger, tmp_path, checkpoint="checkpoint"):
    query = sync_landed(ledger, str(tmp_path / "manifests"), [ACME], [], str(tmp_path / checkpoint))
    query.awaitTermination()
    return {r.ats_job_id: (r.is_active, r.first_seen, r.last_seen) for r in ledger.jobs().collect()}


def test_runs_are_merged_once_and_in_order(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    land(tmp_path, 1, [2, 3])
    land(tmp_path, 0, [1, 2])
    first = run(spark, ledger, tmp_path)
    assert first == {
        "R1": (False, DAYS[0], DAYS[1]),
        "R2": (True, DAYS[0], DAYS[1]),
        "R3": (True, DAYS[1], DAYS[1]),
    }
    assert ledger.last_sync() == 2
    land(tmp_path, 2, [3])
    second = run(spark, ledger, tmp_path)
    assert second["R2"] == (False, DAYS[0], DAYS[2]) and ledger.last_sync() == 3
    # A replay of all manifests changes nothing.
    assert run(spark, ledger, tmp_path, "other") == second and ledger.last_sync() == 3
    assert ledger.sync_report.read_until(3).agg(F.count_distinct("run_ts")).first()[0] == 3


def test_equal_late_and_broken_manifests(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    land(tmp_path, 1, [1])
    run(spark, ledger, tmp_path)
    # A second run of an older or an equal time stamp would turn the state back.
    land(tmp_path, 0, [2])
    with pytest.raises(Exception, match="is not later than the last merged run"):
        run(spark, ledger, tmp_path)
    assert ledger.last_sync() == 1 and [r.ats_job_id for r in ledger.jobs().collect()] == ["R1"]
    (tmp_path / "manifests" / "0.json").write_text(json.dumps({"run_ts": DAYS[2].isoformat() + "Z"}) + "\n")
    with pytest.raises(Exception, match="lacks landed_run"):
        run(spark, ledger, tmp_path, "third")
