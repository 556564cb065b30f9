"""Tables as Parquet directories, one directory per run.

A run never writes where it reads.  It writes ``<table>/run=N`` and is committed by
writing its report last; a run that died leaves directories that nobody reads and
that the next run overwrites.  A table format with MERGE can replace this module.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postledger import schemas

# What names one score among all that were ever made.
SCORE_KEYS = ["unique_key", "search_name", "scored_run"]

_RUN = re.compile(r"run=(\d+)$")


def _committed_runs(spark: SparkSession, path: str) -> list[int]:
    """Runs below ``path`` whose write succeeded, on whatever file system it lies."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    done = files.globStatus(hadoop.Path(f"{path}/run=*/_SUCCESS")) or []
    return sorted(int(_RUN.search(entry.getPath().getParent().getName()).group(1)) for entry in done)


@dataclass(frozen=True)
class Table:
    spark: SparkSession
    path: str
    schema: str

    def runs(self) -> list[int]:
        return _committed_runs(self.spark, self.path)

    def at(self, run: int) -> str:
        return f"{self.path}/run={run}"

    def empty(self) -> DataFrame:
        return self.spark.createDataFrame([], self.schema)

    def read(self, run: int) -> DataFrame:
        """What run ``run`` wrote; empty if it wrote nothing."""
        return self._load([self.at(run)]) if run in self.runs() else self.empty()

    def read_until(self, run: int) -> DataFrame:
        """What all runs up to ``run`` wrote, with the partition column ``run``."""
        paths = [self.at(number) for number in self.runs() if number <= run]
        if not paths:
            return self.empty().withColumn("run", F.lit(None).cast("int"))
        return self._load(paths, with_run=True)

    def _load(self, paths: list[str], with_run: bool = False) -> DataFrame:
        reader = self.spark.read
        if with_run:
            reader = reader.schema(f"{self.schema}, run INT").option("basePath", self.path)
        else:
            reader = reader.schema(self.schema)
        return reader.parquet(*paths)

    def write(self, rows: DataFrame, run: int) -> DataFrame:
        """Write a run's directory, replacing what an uncommitted run left there."""
        rows.write.mode("overwrite").parquet(self.at(run))
        return self._load([self.at(run)])


@dataclass(frozen=True)
class Ledger:
    """All tables below one root.

    Syncing and scoring number their runs separately.  Each writes its report last,
    and only runs with a report count.
    """

    spark: SparkSession
    root: str

    def _table(self, name: str, schema: str) -> Table:
        return Table(self.spark, f"{self.root}/{name}", schema)

    @property
    def listed(self) -> Table:
        """Staging: the parsed listing of each run."""
        return self._table("listed", schemas.STAGED)

    @property
    def scanned(self) -> Table:
        """Staging: the companies of each run and whether their listing is complete."""
        return self._table("scanned", schemas.SCANNED)

    @property
    def arrivals(self) -> Table:
        """Staging: which staged rows of each run are new."""
        return self._table("arrivals", schemas.ROW_IDS)

    @property
    def passed_over(self) -> Table:
        """Staging: the other staged rows, for runs where most are new."""
        return self._table("passed_over", schemas.ROW_IDS)

    @property
    def postings(self) -> Table:
        return self._table("postings", schemas.POSTINGS)

    @property
    def state(self) -> Table:
        return self._table("state", schemas.STATE)

    @property
    def sync_report(self) -> Table:
        return self._table("sync_report", schemas.RUN_REPORT)

    @property
    def merged_runs(self) -> Table:
        return self._table("merged_runs", schemas.MERGED_RUNS)

    @property
    def pairs(self) -> Table:
        """Staging: the pairs each scoring run found stale."""
        return self._table("pairs", schemas.PAIRS)

    def answers(self, scoring: int) -> Table:
        """Staging: model answers of one scoring run, one directory per attempt."""
        return self._table(f"answers/scoring={scoring}", schemas.ANSWERS)

    @property
    def scores(self) -> Table:
        """Append-only: the scores each scoring run made, in full."""
        return self._table("scores", schemas.SCORES)

    @property
    def score_state(self) -> Table:
        """Rewritten by every scoring run: which score counts."""
        return self._table("score_state", schemas.CURRENT_SCORES)

    @property
    def score_marks(self) -> Table:
        """Rewritten by every scoring run: how far each search has matched the postings."""
        return self._table("score_marks", schemas.MARKS)

    @property
    def score_report(self) -> Table:
        return self._table("score_report", schemas.SCORE_REPORT)

    def last_sync(self) -> int:
        return max(self.sync_report.runs(), default=0)

    def last_scoring(self) -> int:
        return max(self.score_report.runs(), default=0)

    def current_state(self) -> DataFrame:
        return self.state.read(self.last_sync())

    def current_postings(self) -> DataFrame:
        return self.postings.read_until(self.last_sync())

    def current_score_state(self) -> DataFrame:
        return self.score_state.read(self.last_scoring())

    def all_scores(self) -> DataFrame:
        """Every committed score, also replaced ones, with its ``scored_run``."""
        return self.scores.read_until(self.last_scoring()).withColumnRenamed("run", "scored_run")

    def current_scores(self) -> DataFrame:
        """The scores that count, in full."""
        current = self.current_score_state().select(*SCORE_KEYS)
        return self.all_scores().join(current, SCORE_KEYS).drop("scored_run")

    def jobs(self) -> DataFrame:
        """Stored listings in full."""
        state = self.current_state().select("unique_key", "last_seen", "is_active")
        return self.current_postings().join(state, "unique_key")
