"""What several operators need: folders all executors reach, and written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDER = "spark.checkpoint.dir"


def workspace(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run, below the one the cluster names in ``spark.checkpoint.dir``.

    Where that is unset, a local session gets one and keeps it in the same setting; a
    cluster is refused, as its machines would not see each other's files.
    """
    folder = spark.conf.get(FOLDER, None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {FOLDER} to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="postledger-llm-")
        spark.conf.set(FOLDER, folder)
    return f"{folder.rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def written(frame: DataFrame, path: str) -> DataFrame:
    """``frame`` as a table at ``path``: cuts the lineage, survives lost executors."""
    frame.write.mode("overwrite").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def text_of(column: str = "text") -> Column:
    """A text column, null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))
