"""Session settings the jobs are planned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Only planning settings; sizes of executors and the master belong to spark-submit.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Runtime-sized broadcast instead of estimates taken from file sizes.
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
    # Static broadcasts rest on exact sizes here: configuration, and tables a run wrote.
    "spark.sql.autoBroadcastJoinThreshold": "32MB",
    # Where the new rows of a run are too many to broadcast, they filter the staged rows
    # before the shuffle.
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1GB",
    "spark.sql.optimizer.runtime.bloomFilter.expectedNumItems": "20000000",
    "spark.sql.optimizer.runtime.bloomFilter.maxNumItems": "20000000",
    "spark.sql.optimizer.runtime.bloomFilter.numBits": "160000000",
    "spark.sql.optimizer.runtime.bloomFilter.maxNumBits": "160000000",
    # Ranked keys are looked up by value in the column indexes of sorted files.
    "spark.sql.parquet.pushdown.inFilterThreshold": "1000",
    # Rows already distributed by unique_key are not shuffled again for a join on
    # (unique_key, search_name, ...).
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.parquet.filterPushdown": "true",
    # A repeated field of an answer counts with its last value.
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Prompts carry whole texts, so batches for Python stay small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


def build_session(app: str, master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
