"""Exact deduplication by a tree merge of sorted digest runs, in DataFrame functions only.

Every row gets the SHA-256 of its text (null is the empty text), its length in bytes and an
independent 64-bit hash; two texts count as equal when all three agree, so a group is only
formed of texts verified by two unrelated digests and their length.  Each input partition
of the written digest table is a run.  At every level ``fan_in`` neighbouring runs are
merged into one: an aggregation keyed by (run // fan_in, digest) keeps, per digest, the
identifier that stays (the largest ``doc_id``) and the number of rows.  Spark's partial
aggregation merges inside each map task first, so a digest held by a third of all rows
leaves every task as one row, at every level; the rounds end when one run is left.

Rows learn their group by a join on the digest.  The largest groups, at most
``hot_groups`` of them by the pigeonhole bound on their size, are broadcast to their rows;
every other group holds fewer than rows / ``hot_groups`` rows, so no task of the shuffled
join gets a hot key.  Only digests and ids move: texts are hashed where they are read.

Defined results: a null text is the empty text; a null ``doc_id`` never stays while its
group has an id, and where all ids of a group are null, its rows have a null ``keep_id``
and count as kept.  Repeated rows (same id, same text) are all kept: they are the row that
stays.  An empty table gives an empty result.  The result has every input column but the
text; the columns made here replace input columns of the same names, and input columns
named like the internal ones (``__id``, ``__run``, ``__hot``, ``__digest``, ``__bytes``,
``__check``) are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postledger.llm.shared import workspace, written

MADE = ["keep_id", "group_size", "kept", "text_sha256"]
KEYS = ["__digest", "__bytes", "__check"]


@dataclass(frozen=True)
class Dedup:
    """``fan_in``: runs merged at each level.  ``hot_groups``: the most groups broadcast."""

    fan_in: int = 64
    hot_groups: int = 10_000

    def __post_init__(self):
        if self.fan_in < 2 or self.hot_groups < 1:
            raise ValueError("fan_in of 2 or more, hot_groups of 1 or more")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with its verified text key; the text itself left behind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    internal = {id_col, text_col, "__id", "__run", "__hot", *KEYS, *MADE}
    rest = [F.col(c) for c in docs.columns if c not in internal]
    return docs.select(
        F.col(id_col).cast("long").alias("__id"),
        *rest,
        F.sha2(text, 256).alias("__digest"),
        F.octet_length(text).cast("long").alias("__bytes"),
        F.xxhash64(text).alias("__check"),
    )


def merge_runs(keyed: DataFrame, config: Dedup = Dedup()) -> DataFrame:
    """One row per group of equal texts: its key, ``keep_id`` and ``group_size``."""
    runs = keyed.select(F.spark_partition_id().alias("__run"), "__id", *KEYS).select(
        "__run", *KEYS, F.col("__id").alias("keep_id"), F.lit(1).cast("long").alias("group_size")
    )
    count = keyed.select(F.spark_partition_id().alias("p")).agg(F.max("p").alias("p")).first()["p"]
    width = 1 if count is None else count + 1
    # One level at least, so that a single run is merged too.
    while True:
        width = -(-width // config.fan_in)
        runs = runs.groupBy((F.col("__run") / config.fan_in).cast("long").alias("__run"), *KEYS).agg(
            F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")
        )
        if width <= 1:
            return runs.drop("__run")


def mark(docs: DataFrame, config: Dedup = Dedup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` (but its text) with ``keep_id``, ``group_size``, ``kept`` and
    ``text_sha256``."""
    spark = docs.sparkSession
    folder = workspace(spark, "exact")
    keyed = written(digests(docs, id_col, text_col), f"{folder}/keyed")
    groups = written(merge_runs(keyed, config), f"{folder}/groups")

    rows = groups.agg(F.sum("group_size").alias("n")).first()["n"] or 0
    bound = max(1, -(-rows // config.hot_groups))
    # At most hot_groups groups can hold more than rows / hot_groups rows each.
    hot = groups.filter(F.col("group_size") > bound).withColumn("__hot", F.lit(True))
    cold = groups.filter(F.col("group_size") <= bound)
    tagged = keyed.join(F.broadcast(hot), KEYS, "left")
    found = tagged.filter(F.col("__hot").isNotNull()).drop("__hot")
    rest = tagged.filter(F.col("__hot").isNull()).drop("__hot", "keep_id", "group_size").join(cold, KEYS)
    both = found.unionByName(rest)
    others = [c for c in keyed.columns if c not in ("__id", *KEYS)]
    return both.select(
        F.col("__id").alias(id_col),
        *others,
        "keep_id",
        "group_size",
        F.col("__id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("__digest").alias("text_sha256"),
    )


def dedup_sql(table: str = "documents") -> str:
    """The same result in DuckDB SQL, grouping by the text itself."""
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM {table}),
g AS (SELECT t, max(doc_id) AS keep_id, CAST(count(*) AS BIGINT) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""
