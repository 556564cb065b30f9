"""Hard-negative mining by an inverted multi-index with certified windows.

Vectors are quantised to integers (each component x becomes floor(256 x)); a row's score
against an anchor is their integer inner product, higher first, ties to the smaller id.  An
anchor's positives are its best other rows of its label; for each positive p, its hard
negatives are the best rows of other labels in the window 50 p <= 100 n <= 95 p.

Search.  The two halves of the vectors get codebooks of their own (k-means on a bounded,
deterministic sample); a row's cell is the pair of its nearest centroids, and each centroid
keeps the radius of its half, the largest distance of a member to it.  By Cauchy-Schwarz a
member x of cell (i, j) scores at most q1.c_i + |q1| r_i + q2.c_j + |q2| r_j against q, and
at least the same with the radii subtracted.  The first bound is a sum of two half-scores,
so a multi-sequence heap over the two sorted half lists visits cells in exactly falling
order of it.  A window stops when it is certified: it holds its k rows and the next cell's
bound is below the k-th score, or the bound fell below the window.  Rounds visit more cells
(four times as many entries each round) for the windows still open, so nothing is capped:
the last round may visit every cell.

At scale.  Entries are written once, keyed by cell and by a block within the cell (hot
cells, such as one vector a third of all rows share, are split into blocks of at most
``block`` rows); anchors go to the blocks of the cells they visit, spread over ``fan``
parts where many anchors visit one cell, and a cogroup scores an anchor block against an
entry block with one integer matrix product, returning only each window's best k.

Defined results: rows with a null label, a null vector, or a null or non-finite component
take no part; vectors shorter than the longest are read as padded with zeros.  Repeated
rows are candidates as often as they occur; a repeated anchor is searched once.  No anchor
or no valid row gives an empty result.  Extra input columns are not carried.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postledger.llm.shared import workspace, written

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
FOUND = "anchor_id long, w int, vec_id long, score long"
LOWEST, HIGHEST = -(1 << 62), 1 << 62


@dataclass(frozen=True)
class Mining:
    """``positives`` and ``negatives``: rows kept per anchor and per positive; the window is
    ``low`` to ``high`` percent of the positive's score.  Centroids per half: about the
    square root of rows / ``cell_rows``, at most ``centroids``, fitted on at most ``sample``
    rows, so that codebooks grow with the data; ``block``: entries scored at once; ``anchors``: anchors a part
    of a cell takes; ``first_entries``: entries the first round visits."""

    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95
    centroids: int = 64
    cell_rows: int = 2048
    sample: int = 20_000
    iterations: int = 12
    block: int = 4096
    anchors: int = 1024
    first_entries: int = 16384


def prepared(rows: DataFrame, relabel: Column | None = None) -> DataFrame:
    """Valid rows as (vec_id, label, q): q the quantised components, padded to one length."""
    x = F.col("embedding")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    label = F.col("label").cast("int") if relabel is None else relabel
    valid = rows.filter(F.col("label").isNotNull() & x.isNotNull() & ~bad).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        label.alias("label"),
        F.transform(x, lambda v: F.floor(v.cast("double") * 256).cast("long")).alias("q"),
    )
    width = valid.agg(F.max(F.size("q")).alias("d")).first()["d"] or 0
    pad = F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("q"))
    return valid.withColumn("q", F.concat("q", pad)), width


@dataclass
class Codebook:
    """Centroids and radii of the two halves, and the entries of every cell."""

    halves: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray]
    counts: np.ndarray

    @property
    def cut(self) -> int:
        return self.halves[0].shape[1]

    @property
    def size(self) -> int:
        return int(np.count_nonzero(self.counts))

    def cells(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Nearest centroid of each half, and the distance to it."""
        found = []
        for part, c in ((q[:, : self.cut], self.halves[0]), (q[:, self.cut :], self.halves[1])):
            near = np.argmin((c * c).sum(1)[None, :] - 2 * part @ c.T, axis=1) if len(c) else np.zeros(len(q), int)
            found.append((near, np.sqrt(((part - c[near]) ** 2).sum(1)) if len(c) else np.zeros(len(q))))
        return found[0][0], found[1][0], found[0][1], found[1][1]

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, ...]:
        """Per half, the upper and lower bounds of a member's half-score, with a margin for
        rounding."""
        out = []
        for part, c, r in ((q[: self.cut], self.halves[0], self.radii[0]), (q[self.cut :], self.halves[1], self.radii[1])):
            centre, reach = c @ part, np.linalg.norm(part) * r
            slack = 1e-9 * (np.abs(c) @ np.abs(part) + reach) + 1e-6
            out += [centre + reach + slack, centre - reach - slack]
        return tuple(out)

    def walk(self, q: np.ndarray) -> Iterator[tuple[int, int, float, float]]:
        """Non-empty cells (i, j, upper, lower), falling upper bound first (multi-sequence heap)."""
        up1, low1, up2, low2 = self.bounds(q)
        first, second = np.argsort(-up1, kind="stable"), np.argsort(-up2, kind="stable")
        top1, top2 = up1[first].tolist(), up2[second].tolist()
        first, second, low1, low2 = first.tolist(), second.tolist(), low1.tolist(), low2.tolist()
        counts = self.counts.tolist()
        # (a, b + 1) follows every pair, (a + 1, b) only those of the first column: each
        # pair enters the heap once, after a pair that bounds it.
        heap = [(-(top1[0] + top2[0]), 0, 0)]
        while heap:
            bound, a, b = heapq.heappop(heap)
            i, j = first[a], second[b]
            if counts[i][j]:
                yield i, j, -bound, low1[i] + low2[j]
            if b + 1 < len(top2):
                heapq.heappush(heap, (-(top1[a] + top2[b + 1]), a, b + 1))
            if b == 0 and a + 1 < len(top1):
                heapq.heappush(heap, (-(top1[a + 1] + top2[0]), a + 1, 0))


def _kmeans(points: np.ndarray, k: int, iterations: int) -> np.ndarray:
    """Lloyd's iterations from a farthest-first start; deterministic."""
    unique = np.unique(points, axis=0)
    k = min(k, len(unique))
    if k == 0:
        return np.zeros((0, points.shape[1]))
    centres = [unique[0]]
    gap = ((unique - centres[0]) ** 2).sum(1)
    for _ in range(1, k):
        centres.append(unique[int(np.argmax(gap))])
        gap = np.minimum(gap, ((unique - centres[-1]) ** 2).sum(1))
    c = np.array(centres, dtype=float)
    for _ in range(iterations):
        near = np.argmin((c * c).sum(1)[None, :] - 2 * points @ c.T, axis=1)
        for m in range(k):
            members = points[near == m]
            if len(members):
                c[m] = members.mean(0)
    return c


def fit(valid: DataFrame, width: int, k: int, config: Mining) -> tuple[np.ndarray, np.ndarray]:
    """Codebooks of ``k`` centroids for both halves from at most ``sample`` rows, chosen by a
    hash of the id."""
    sample = valid.orderBy(F.xxhash64("vec_id"), "vec_id").limit(config.sample).select("q").toPandas()
    points = np.array(sample["q"].tolist(), dtype=float).reshape(len(sample), width)
    cut = width // 2
    return _kmeans(points[:, :cut], k, config.iterations), _kmeans(points[:, cut:], k, config.iterations)


def _as_matrix(column: pd.Series, width: int) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.int64).reshape(len(column), width)


def entries(valid: DataFrame, halves, width: int) -> DataFrame:
    """Every valid row with its cell and the distances of its halves to their centroids."""
    book = Codebook(halves, (np.zeros(len(halves[0])), np.zeros(len(halves[1]))), np.zeros((1, 1)))

    def assign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            q = _as_matrix(part["q"], width).astype(float)
            i, j, r1, r2 = book.cells(q)
            yield part.assign(c1=i.astype("int32"), c2=j.astype("int32"), r1=r1, r2=r2)

    return valid.mapInPandas(assign, "vec_id long, label int, q array<long>, c1 int, c2 int, r1 double, r2 double")


def _top(found: DataFrame, k: int) -> DataFrame:
    """Per anchor and window, its best k rows."""
    order = F.row_number().over(Window.partitionBy("anchor_id", "w").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("__r", order).filter(F.col("__r") <= k).drop("__r")


def _best(s: np.ndarray, ok: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row of ``s``, the first ``k`` allowed columns by score, then smaller id: their
    (row, column) pairs.  Ties at the k-th score are all sorted, none dropped unseen."""
    low = np.iinfo(np.int64).min
    masked = np.where(ok, s, low)
    if masked.shape[1] > k:
        kth = np.partition(masked, masked.shape[1] - k, axis=1)[:, masked.shape[1] - k]
        ok = ok & (masked >= kth[:, None])
    rows, cols = np.nonzero(ok)
    order = np.lexsort((ids[cols], -s[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    first = np.searchsorted(rows, rows, side="left")
    keep = np.arange(rows.size) - first < k
    return rows[keep], cols[keep]


def search(
    anchors: DataFrame,
    stored: DataFrame,
    cells: DataFrame,
    book: Codebook,
    width: int,
    config: Mining,
    folder: str,
    same: bool,
    k: int,
) -> DataFrame:
    """For every anchor (anchor_id, label, q, wins, los, his), the best ``k`` rows of each
    window (rows of its label if ``same``, else of other labels, scores from lo to hi), as
    (anchor_id, w, vec_id, score), certified exactly."""
    spark = anchors.sparkSession
    info = written(anchors.select("anchor_id", "label", "q"), f"{folder}/anchors")
    state = anchors.select("anchor_id", "wins", "los", "his", F.lit(0).cast("long").alias("pos"))
    best = spark.createDataFrame([], FOUND)
    budget, round_no = config.first_entries, 0
    counts = book.counts.tolist()
    magnitude = float(info.agg(F.max(F.array_max(F.transform("q", lambda v: F.abs(v))))).first()[0] or 0)
    while True:

        def walk(parts: Iterator[pd.DataFrame], budget=budget) -> Iterator[pd.DataFrame]:
            for part in parts:
                rows = []
                for anchor, q, los, his, pos in part[["anchor_id", "q", "los", "his", "pos"]].itertuples(index=False):
                    open_ = list(zip(los.tolist(), his.tolist()))
                    floor_ = min(lo for lo, _ in open_)
                    # Steps count every non-empty cell in heap order; earlier rounds took
                    # the first ``pos`` of them.
                    taken, step, nxt, visited = 0, -1, -np.inf, 0
                    for i, j, up, low in book.walk(np.asarray(q, dtype=float)):
                        step += 1
                        if step < pos:
                            continue
                        if up < floor_:
                            break
                        if not any(up >= lo and low <= hi for lo, hi in open_):
                            continue
                        if taken >= budget:
                            nxt = up
                            break
                        rows.append((anchor, i, j))
                        visited += 1
                        taken += counts[i][j]
                    end = step if nxt > -np.inf else book.size
                    rows.append((anchor, -1, end, nxt))
                yield pd.DataFrame(
                    [(r[0], r[1], r[2], None, None) if len(r) == 3 else (r[0], -1, -1, r[2], r[3]) for r in rows],
                    columns=["anchor_id", "c1", "c2", "pos", "bound"],
                )

        opened = state.join(info, "anchor_id").repartition("anchor_id")
        visits = written(
            opened.mapInPandas(walk, "anchor_id long, c1 int, c2 int, pos long, bound double"), f"{folder}/visits{round_no}"
        )
        hits = visits.filter("c1 >= 0").select("anchor_id", "c1", "c2")
        fans = hits.groupBy("c1", "c2").agg(F.count("*").alias("n"))
        fans = fans.select("c1", "c2", F.greatest(F.lit(1), F.ceil(F.col("n") / config.anchors)).cast("int").alias("fan"))
        # At most one row per cell: a bounded broadcast.
        per_cell = F.broadcast(written(fans.join(cells, ["c1", "c2"]), f"{folder}/fans{round_no}"))
        probe = (
            hits.join(per_cell, ["c1", "c2"])
            .join(state.select("anchor_id", "wins", "los", "his"), "anchor_id")
            .join(info, "anchor_id")
            .withColumn("part", F.pmod(F.xxhash64("anchor_id"), F.col("fan")).cast("int"))
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("c1", "c2", "block", "part", "anchor_id", "label", "q", "wins", "los", "his")
        )
        stock = (
            stored.join(per_cell, ["c1", "c2"])
            .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("fan") - 1)))
            .select("c1", "c2", "block", "part", "vec_id", F.col("label").alias("e_label"), F.col("q").alias("e_q"))
        )

        def score(key, probes: pd.DataFrame, stock: pd.DataFrame) -> pd.DataFrame:
            found = []
            if len(probes) and len(stock):
                e = _as_matrix(stock["e_q"], width).T
                # Integer products in doubles are exact below 2**53, and far faster.
                exact = float(np.abs(e).max(initial=0)) * magnitude * max(width, 1) < 2.0**53
                e = e.astype(float) if exact else e
                ids, labels = stock["vec_id"].to_numpy(np.int64), stock["e_label"].to_numpy(np.int64)
                for start in range(0, len(probes), 256):
                    chunk = probes.iloc[start : start + 256]
                    a = _as_matrix(chunk["q"], width)
                    s = (a.astype(float) @ e).astype(np.int64) if exact else a @ e
                    anchor = chunk["anchor_id"].to_numpy(np.int64)
                    mine_ = chunk["label"].to_numpy(np.int64)[:, None] == labels[None, :]
                    ok = (mine_ if same else ~mine_) & (ids[None, :] != anchor[:, None])
                    wins, los, his = (list(chunk[c]) for c in ("wins", "los", "his"))
                    for t in range(max(len(w) for w in wins)):
                        has = np.array([len(w) > t for w in wins])
                        lo = np.array([l[t] if len(l) > t else HIGHEST for l in los], dtype=np.int64)
                        hi = np.array([h[t] if len(h) > t else LOWEST for h in his], dtype=np.int64)
                        w = np.array([x[t] if len(x) > t else 0 for x in wins], dtype=np.int64)
                        inside = ok & has[:, None] & (s >= lo[:, None]) & (s <= hi[:, None])
                        rows, cols = _best(s, inside, ids, k)
                        found.append(pd.DataFrame({"anchor_id": anchor[rows], "w": w[rows], "vec_id": ids[cols], "score": s[rows, cols]}))
            if not found:
                return pd.DataFrame({"anchor_id": [], "w": [], "vec_id": [], "score": []})
            return pd.concat(found, ignore_index=True)

        grouped = probe.groupBy("c1", "c2", "block", "part").cogroup(stock.groupBy("c1", "c2", "block", "part"))
        found = grouped.applyInPandas(score, FOUND)
        best = written(_top(best.unionByName(found), k), f"{folder}/best{round_no}")

        # A window is certified when its k-th score beats the next cell's bound, or the bound
        # fell below it; an anchor stays open while one of its windows is not.
        ends = visits.filter("c1 < 0").select("anchor_id", "pos", "bound")
        kth = best.groupBy("anchor_id", "w").agg(F.count("*").alias("n"), F.min("score").alias("kth"))
        windows = state.select(
            "anchor_id", F.explode(F.arrays_zip("wins", "los", "his")).alias("win")
        ).select("anchor_id", F.col("win.wins").alias("w"), F.col("win.los").alias("lo"), F.col("win.his").alias("hi"))
        windows = windows.join(ends, "anchor_id").join(kth, ["anchor_id", "w"], "left")
        bound = F.floor(F.col("bound"))
        done = (
            (F.col("bound") == float("-inf"))
            | (bound < F.col("lo"))
            | ((F.coalesce(F.col("n"), F.lit(0)) >= k) & (bound < F.col("kth")))
        )
        still = windows.filter(~done).groupBy("anchor_id", "pos").agg(
            F.sort_array(F.collect_list(F.struct("w", "lo", "hi"))).alias("open")
        )
        state = written(
            still.select("anchor_id", "open.w", "open.lo", "open.hi", "pos").toDF("anchor_id", "wins", "los", "his", "pos"),
            f"{folder}/state{round_no}",
        )
        if state.isEmpty():
            return best
        budget, round_no = budget * 4, round_no + 1


def mine(rows: DataFrame, is_anchor: Column, relabel: Column | None = None, config: Mining = Mining()) -> DataFrame:
    """Hard negatives of every anchor row, as (anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score)."""
    spark = rows.sparkSession
    folder = workspace(spark, "negatives")
    valid, width = prepared(rows, relabel)
    if width == 0:
        return spark.createDataFrame([], RESULT)
    valid = written(valid, f"{folder}/valid")
    k = max(1, min(config.centroids, round(math.sqrt(valid.count() / config.cell_rows))))
    halves = fit(valid, width, k, config)
    placed = written(entries(valid, halves, width), f"{folder}/entries")
    r1 = {r.c1: r.r for r in placed.groupBy("c1").agg(F.max("r1").alias("r")).collect()}
    r2 = {r.c2: r.r for r in placed.groupBy("c2").agg(F.max("r2").alias("r")).collect()}
    counts = np.zeros((len(halves[0]), len(halves[1])), dtype=np.int64)
    for r in placed.groupBy("c1", "c2").count().collect():
        counts[r.c1, r.c2] = r["count"]
    radii = tuple(np.array([found.get(i, 0.0) for i in range(len(h))]) for found, h in ((r1, halves[0]), (r2, halves[1])))
    book = Codebook(halves, radii, counts)
    cells = spark.createDataFrame(
        [(int(i), int(j), int(max(1, -(-counts[i, j] // config.block)))) for i, j in zip(*np.nonzero(counts))],
        "c1 int, c2 int, blocks int",
    )
    # A hot cell is split into blocks by a hash of the id.
    block = F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")
    stored = written(placed.join(F.broadcast(cells), ["c1", "c2"]).withColumn("block", block).drop("blocks"), f"{folder}/blocks")
    marks = rows.filter(is_anchor).select(F.col("vec_id").cast("long").alias("vec_id")).distinct()
    anchors = valid.join(marks, "vec_id", "left_semi").dropDuplicates(["vec_id", "label", "q"])

    first = anchors.select(
        F.col("vec_id").alias("anchor_id"),
        "label",
        "q",
        F.array(F.lit(1)).alias("wins"),
        F.array(F.lit(LOWEST)).alias("los"),
        F.array(F.lit(HIGHEST)).alias("his"),
    )
    positives = search(first, stored, cells, book, width, config, f"{folder}/positives", True, config.positives)
    positives = positives.withColumn("rank", F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")))
    positives = written(positives, f"{folder}/positive_rows")

    # The window 50 p <= 100 n <= 95 p in whole numbers: ceil(p / 2) to floor(0.95 p).
    p = F.col("score")
    window = F.struct(
        F.col("rank").cast("int").alias("w"),
        (-F.floor(-p * config.low / 100)).cast("long").alias("lo"),
        F.floor(p * config.high / 100).cast("long").alias("hi"),
    )
    second = positives.groupBy("anchor_id").agg(F.sort_array(F.collect_list(window)).alias("windows"))
    second = second.withColumn("windows", F.filter("windows", lambda w: w["lo"] <= w["hi"]))
    second = second.filter(F.size("windows") > 0).join(first.select("anchor_id", "label", "q"), "anchor_id")
    second = second.select("anchor_id", "label", "q", "windows.w", "windows.lo", "windows.hi").toDF(
        "anchor_id", "label", "q", "wins", "los", "his"
    )
    negatives = search(second, stored, cells, book, width, config, f"{folder}/negatives", False, config.negatives)
    order = Window.partitionBy("anchor_id", "w").orderBy(F.desc("score"), "vec_id")
    ranked = negatives.withColumn("rank", F.row_number().over(order).cast("int"))
    pos = positives.select("anchor_id", F.col("rank").cast("int").alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return ranked.join(pos, ["anchor_id", "w"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def mining_sql(table: str = "embeddings") -> str:
    """The same result in DuckDB SQL, by brute force over all pairs of anchor and row."""
    return f"""
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS lab,
           list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
    FROM {table}
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), a AS (SELECT DISTINCT vec_id, lab, q FROM v WHERE vec_id % 50 = 0),
s AS (
    SELECT a.vec_id AS anchor_id, a.lab AS alab, v.vec_id, v.lab,
           CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * v.q[i])) AS BIGINT) AS score
    FROM a, v WHERE v.vec_id <> a.vec_id
), p AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (
        SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE lab = alab
    ) WHERE r <= 5
), n AS (
    SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
           row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
    FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.lab <> s.alab
     AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM n WHERE rank <= 3
"""
