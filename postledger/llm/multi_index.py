"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut into halves, and each half is quantised by its own centroids; a cell is a
pair of them.  A query walks the cells in order of their summed nearness with a heap, until
the cells visited hold a set share of all entries, and all entries met are ranked by the
exact inner product.

How large that share must be depends on the vectors: it is measured on a bounded sample, so
that the wanted recall is met.  Clustered vectors need a small share; vectors without
structure, in many dimensions, a large one.

Equal vectors are one entry with as many ids as a result can hold, so that a vector of a
third of all rows costs one entry.  Cells are joined to queries in blocks of bounded size
on both sides; each block returns its best entries per query only.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postledger.llm.shared import workspace, written


@dataclass(frozen=True)
class Index:
    """``centroids``: per half, at most 64.  ``recall``: wanted on the sample.  ``sample``
    and ``sample_bytes`` bound the rows that centroids and the share are fitted on, and
    ``trials`` the queries among them.  ``entries`` and ``queries`` bound a block."""

    centroids: int = 32
    recall: float = 0.96
    sample: int = 20_000
    sample_bytes: int = 64 << 20
    trials: int = 200
    rounds: int = 12
    entries: int = 4096
    queries: int = 1024

    def __post_init__(self):
        if not 1 <= self.centroids <= 64:
            raise ValueError("1 to 64 centroids per half")


@dataclass
class Codebook:
    """Centroids of the two halves, entries per cell, and the share of entries to visit."""

    halves: tuple[np.ndarray, np.ndarray]
    share: float = 1.0
    counts: np.ndarray | None = None

    @property
    def cut(self) -> int:
        return self.halves[0].shape[1]

    def cells(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(
            np.argmax(part @ c.T - (c * c).sum(1) / 2, axis=1)
            for part, c in zip((vectors[:, : self.cut], vectors[:, self.cut :]), self.halves)
        )

    def walk(self, vector: np.ndarray) -> Iterator[tuple[int, int]]:
        """All cells, the nearest by summed inner product first."""
        a, b = self.halves[0] @ vector[: self.cut], self.halves[1] @ vector[self.cut :]
        first, second = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
        a, b = a[first], b[second]
        # Of each row of pairs the next unvisited one waits in the heap.
        heap = [(-(a[0] + b[0]), 0, 0)]
        while heap:
            _, i, j = heapq.heappop(heap)
            yield int(first[i]), int(second[j])
            if j + 1 < len(b):
                heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (-(a[i + 1] + b[0]), i + 1, 0))

    def visit(self, vector: np.ndarray) -> dict[int, int]:
        """Per first centroid, the second ones to visit, as a bit mask."""
        wanted, met, masks = self.share * self.counts.sum(), 0, {}
        for i, j in self.walk(vector):
            if met >= wanted:
                break
            if self.counts[i, j]:
                met += self.counts[i, j]
                masks[i] = masks.get(i, 0) | 1 << j
        return masks


def _centroids(points: np.ndarray, k: int, rounds: int) -> np.ndarray:
    random = np.random.default_rng(11)
    points_used = np.unique(points, axis=0)
    k = min(k, len(points_used))
    found = points_used[random.choice(len(points_used), k, replace=False)]
    for _ in range(rounds):
        own = np.argmax(points @ found.T - (found * found).sum(1) / 2, axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, own, points)
        n = np.bincount(own, minlength=k)[:, None]
        found = np.where(n > 0, sums / np.maximum(n, 1), found)
    return found


def fit(sample: np.ndarray, index: Index, k: int) -> Codebook:
    """Centroids, and the share of entries that finds ``index.recall`` of the true ``k``
    nearest of the sample's own queries."""
    cut = sample.shape[1] // 2
    book = Codebook(tuple(_centroids(part, index.centroids, index.rounds) for part in (sample[:, :cut], sample[:, cut:])))
    if len(sample) <= 2 * k:
        return book
    first, second = book.cells(sample)
    counts = np.zeros([len(h) for h in book.halves], np.int64)
    np.add.at(counts, (first, second), 1)
    depths = []
    for q in range(min(index.trials, len(sample))):
        scores = sample @ sample[q]
        scores[q] = -np.inf
        nearest = np.argpartition(-scores, k)[:k]
        met, seen = 0, np.zeros_like(counts)
        for i, j in book.walk(sample[q]):
            met += counts[i, j]
            seen[i, j] = met
        depths.append(seen[first[nearest], second[nearest]])
    book.share = float(np.quantile(np.concatenate(depths), index.recall)) / len(sample)
    return book


def usable(vectors: DataFrame) -> DataFrame:
    """Rows that take part, as doubles: with an id, and a vector of the usual length that is
    not zero and has finite components only."""
    v = F.col("embedding")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).filter(
        F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)
    )
    usual = good.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return good.filter(F.size("embedding") == (usual["n"] if usual else 0))


def _block(key: str, of: Column) -> Column:
    return F.pmod(F.xxhash64(key), of.cast("long")).cast("int")


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, index: Index = Index(), folder: str | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for every query.

    ``vectors`` has vec_id and embedding; ``is_query`` tells which rows are queries, and all
    rows with another id are candidates.  The score is the inner product in double
    precision; ties go to the smaller vec_id.  With at most ``k`` candidates all are found.
    Vectors that are null, zero, of another length than most, or hold null or non-finite
    components take no part, nor do rows without an id.  Repeated rows count once; different
    vectors under one id are entries of their own.  Empty tables give empty results; other
    columns are not read.
    """
    spark = vectors.sparkSession
    folder = folder or workspace(spark, "nearest")
    good = written(usable(vectors).withColumn("is_query", F.coalesce(is_query, F.lit(False))), f"{folder}/vectors")
    # The k + 1 smallest ids of equal vectors are all that can be in a result.
    placed = good.withColumn("place", F.dense_rank().over(Window.partitionBy("embedding").orderBy("vec_id")))
    entries = (
        placed.filter(F.col("place") <= k + 1)
        .groupBy("embedding")
        .agg(F.min("vec_id").alias("entry"), F.array_sort(F.collect_set("vec_id")).alias("ids"))
    )
    # A number for each entry, as one id may have several vectors.
    entries = written(entries.withColumn("entry", F.xxhash64("entry", "embedding")), f"{folder}/entries")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    first = entries.select("embedding").first()
    if first is None:
        return empty
    dim = len(first["embedding"])
    rows = max(1, min(index.sample, index.sample_bytes // (8 * dim)))
    sample = entries.orderBy("entry").limit(rows).select("embedding").toArrow()["embedding"].combine_chunks()
    book = fit(np.asarray(sample.values, dtype=np.float64).reshape(-1, dim), index, k)
    ks = [len(h) for h in book.halves]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = book.cells(np.asarray(batch["embedding"].flatten()).reshape(-1, dim))
            yield pa.RecordBatch.from_arrays(
                [batch["entry"], batch["embedding"], batch["ids"], pa.array(one, pa.int32()), pa.array(two, pa.int32())],
                ["entry", "embedding", "ids", "one", "two"],
            )

    types = "entry long, embedding array<double>, ids array<long>, one int, two int"
    cells = written(entries.select("entry", "embedding", "ids").mapInArrow(assign, types), f"{folder}/cells")
    book.counts = np.zeros(ks, np.int64)
    for r in cells.groupBy("one", "two").count().collect():  # at most a row per cell
        book.counts[r["one"], r["two"]] = r["count"]

    asked = good.filter("is_query").select("vec_id", "embedding").join(entries.select("embedding", "entry"), "embedding")
    asked = written(asked.select(F.col("vec_id").alias("query_id"), "entry").distinct(), f"{folder}/queries")
    distinct = cells.select("entry", "embedding").join(asked.select("entry").distinct(), "entry", "left_semi")

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                vectors = np.asarray(part["embedding"].flatten()).reshape(-1, dim)
                rows = [(n, i, mask) for n, v in enumerate(vectors) for i, mask in book.visit(v).items()]
                at = pa.array([n for n, _, _ in rows], pa.int64())
                masks = np.array([m for _, _, m in rows], np.uint64).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part["entry"].take(at), part["embedding"].take(at), pa.array([i for _, i, _ in rows], pa.int32()), pa.array(masks)],
                    ["query", "embedding", "one", "mask"],
                )

    visits = written(distinct.mapInArrow(visit, "query long, embedding array<double>, one int, mask long"), f"{folder}/visits")
    n_visits = {r["one"]: r["count"] for r in visits.groupBy("one").count().collect()}
    e_blocks = F.lit([max(1, math.ceil(int(n) / index.entries)) for n in book.counts.sum(1)])
    q_blocks = F.lit([max(1, math.ceil(n_visits.get(i, 0) / index.queries)) for i in range(ks[0])])
    of_entries, of_queries = F.get(e_blocks, F.col("one")), F.get(q_blocks, F.col("one"))

    def all_of(n: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), n - 1))

    left = visits.withColumn("qb", _block("query", of_queries)).withColumn("eb", all_of(of_entries))
    right = cells.withColumn("eb", _block("entry", of_entries)).withColumn("qb", all_of(of_queries))

    def rank(asking: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        if not len(asking) or not len(there):
            return pd.DataFrame({"query": [], "entry": [], "ids": [], "score": []})
        there = there.sort_values("entry")
        q, e = np.stack(asking["embedding"].to_numpy()), np.stack(there["embedding"].to_numpy())
        scores = q @ e.T
        bits = asking["mask"].to_numpy().astype(np.uint64)[:, None] >> there["two"].to_numpy().astype(np.uint64)[None, :]
        scores[(bits & np.uint64(1)) == 0] = -np.inf
        n = min(k + 1, len(there))
        least = np.partition(scores, len(there) - n, axis=1)[:, len(there) - n]
        row, col = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
        return pd.DataFrame(
            {
                "query": asking["query"].to_numpy()[row],
                "entry": there["entry"].to_numpy()[col],
                "ids": there["ids"].to_numpy()[col],
                "score": scores[row, col],
            }
        )

    keys = ["one", "eb", "qb"]
    ranked = (
        left.groupBy(*keys)
        .cogroup(right.groupBy(*keys))
        .applyInPandas(rank, "query long, entry long, ids array<long>, score double")
    )
    ranked = ranked.withColumn("low", F.get("ids", F.lit(0)))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "low", "entry")
    ranked = ranked.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k + 1)
    ranked = written(ranked.select("query", "ids", "score"), f"{folder}/ranked")
    found = asked.withColumnRenamed("entry", "query").join(ranked, "query")
    found = found.select("query_id", "score", F.explode("ids").alias("vec_id")).filter("vec_id <> query_id").distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranks = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranks.select("query_id", "rank", "vec_id", "score")
