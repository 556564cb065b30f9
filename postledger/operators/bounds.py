"""Broadcasting behind a check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A hinted broadcast must stay below both.
MAX_ROWS = 100_000
MAX_BYTES = 32 << 20


def fits(frame: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> bool:
    """Whether ``frame`` is within the bounds.  Looks at no more than ``max_rows + 1`` rows."""
    size = F.length(F.to_json(F.struct(*frame.columns)))
    head = frame.limit(max_rows + 1).agg(F.count("*").alias("n"), F.sum(size).alias("bytes")).first()
    return head["n"] <= max_rows and (head["bytes"] or 0) <= max_bytes


def broadcasts_itself(frame: DataFrame) -> bool:
    """Whether Spark will broadcast ``frame`` on its own estimate, which is exact for local
    rows and an upper bound for plain projections of small files."""
    threshold = frame.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    estimate = frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(estimate)) <= threshold


def broadcast_within(frame: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``frame`` with a broadcast hint if it is within the bounds.

    Nothing is counted where Spark's estimate suffices.  Beyond the bounds the frame stays
    as it is, which leaves a shuffled join to adaptive execution and its handling of
    skewed keys.
    """
    if broadcasts_itself(frame) or not fits(frame, max_rows, max_bytes):
        return frame
    return F.broadcast(frame)
