"""Synchronising with landed runs as they arrive.

A run of the downloader ends by writing one manifest, a JSON line with ``landed_run``
and ``run_ts``.  Snapshots must be merged whole and in order, so the stream is over
manifests, not over documents; the merge itself is the batch run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from postledger import schemas
from postledger.config import Company
from postledger.plans import sync
from postledger.tables import Ledger

MANIFEST = "landed_run STRING, run_ts TIMESTAMP"


def sync_landed(
    ledger: Ledger,
    manifests: str,
    companies: Sequence[Company],
    regions: Sequence[str],
    checkpoint: str,
) -> StreamingQuery:
    """Start a query that merges every run with a new manifest, then ends.

    The checkpoint remembers which manifests were handled.  A batch that is replayed
    skips the landed runs that were merged before, by name.  Runs are merged in the order
    of their time stamps; one that is not later than the last merged run would turn the
    state back, so the query fails with its name, as it does for a manifest without one.
    """

    def merge(batch: DataFrame, _: int) -> None:
        last = ledger.last_sync()
        done = ledger.merged_runs.read_until(last).select("landed_run")
        # One row per landed run.
        for row in batch.join(done, "landed_run", "left_anti").orderBy("run_ts", "landed_run").collect():
            if row.landed_run is None or row.run_ts is None:
                raise ValueError(f"a manifest lacks landed_run or run_ts: {row.asDict()}")
            newest = ledger.sync_report.read(ledger.last_sync()).agg(F.max("run_ts")).first()[0]
            if newest is not None and row.run_ts <= newest:
                raise ValueError(f"{row.landed_run} of {row.run_ts} is not later than the last merged run of {newest}")
            # Written first; it counts once the run it belongs to has its report.
            name = ledger.spark.createDataFrame([(row.landed_run,)], schemas.MERGED_RUNS)
            ledger.merged_runs.write(name, ledger.last_sync() + 1)
            sync(ledger, row.landed_run, companies, regions, row.run_ts)

    stream = ledger.spark.readStream.schema(MANIFEST).json(manifests)
    return (
        stream.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
