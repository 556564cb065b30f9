"""Mixing sources to target weights by temperature.

A source's share of all tokens is raised to an exponent between 0 (all sources alike) and 1
(as they are).  The exponent is bisected: the largest one at which the weights have the
wanted entropy and no source is repeated more often than allowed.  A weight times the
budget is a source's quota.

Quotas are realised in whole epochs and a part of one.  A source is cut into blocks by a
hash of its documents; every epoch has its own permutation of them, and the last one takes
blocks in that order until the quota is filled.  Whether a row belongs to it is a test
against one number per source, so rows are chosen where they lie.

Only DataFrame code.  Token counts and blocks are summed with a map-side combine, so that a
source of a third of all rows is no hot task.  The driver sees a grid of exponents, never
the sources.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postledger.llm.shared import text_of, workspace, written
from postledger.operators.bounds import broadcast_within

# Fixed value: tokens are counted as words.
WORD = r"[^\x20\x09-\x0D]+"

# Exponents per round of the bisection, rounds, and the decimals that are kept.
_GRID, _ROUNDS, _DECIMALS = 256, 4, 6
_BITS = 52
# Epochs this close to a whole number are whole.
_SLACK = 1e-9


@dataclass(frozen=True)
class Mix:
    """``entropy``: wanted share of the largest possible entropy of the weights.
    ``max_repeats``: most epochs of a source.  ``budget``: tokens; None takes as many as the
    corpus has, and ``every_document`` as many as leave no source below one epoch.
    ``blocks``: per source, at most."""

    entropy: float | None = 0.9
    max_repeats: float | None = 4.0
    budget: int | None = None
    every_document: bool = False
    blocks: int = 1024
    seed: int = 7


def n_words(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long")


def draw(*parts: Column) -> Column:
    """A number below 2**52 that looks random and is a function of ``parts``."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, _BITS // 4), 16, 10).cast("long")


def sized(docs: DataFrame, mix: Mix, tokens: Column | None = None) -> DataFrame:
    """``docs`` with ``n_tokens`` and ``block``."""
    return docs.withColumn("n_tokens", n_words(text_of()) if tokens is None else tokens).withColumn(
        "block", (draw(F.lit(mix.seed), F.col("doc_id")) % mix.blocks).cast("int")
    )


def exponent(sources: DataFrame, mix: Mix) -> tuple[float, float]:
    """The exponent, and the budget in tokens, for a table (source, tokens)."""
    there = sources.filter("tokens > 0")
    facts = there.agg(
        F.count("*").alias("n"), F.sum("tokens").alias("total"), F.min("tokens").alias("least"), F.max("tokens").alias("most")
    ).first()
    if not facts["n"]:
        return 1.0, 0.0
    n, total, least, most = facts["n"], float(facts["total"]), float(facts["least"]), float(facts["most"])

    def budget(alpha: float, z: float) -> float:
        if mix.every_document:
            return total * z * (most / total) ** (1 - alpha)
        return float(mix.budget or total)

    def meets(alpha: float, z: float, e: float) -> bool:
        entropy = math.log(z) - alpha * e / z
        if mix.entropy is not None and n > 1 and entropy < mix.entropy * math.log(n) - 1e-12:
            return False
        return True

    def repeats(alpha: float, z: float) -> float:
        return (least / total) ** (alpha - 1) / z * budget(alpha, z) / total

    def sums(alphas: list[float]) -> list:
        share = F.log(F.col("tokens") / total)
        grid = there.select(share.alias("s"), F.explode(F.lit(alphas)).alias("alpha"))
        power = F.exp(F.col("alpha") * F.col("s"))
        return grid.groupBy("alpha").agg(F.sum(power).alias("z"), F.sum(power * F.col("s")).alias("e")).orderBy("alpha").collect()

    def largest(test) -> float:
        """The largest exponent that passes; a test passes below it.  0 if none does."""
        low, high = 0.0, 1.0
        for _ in range(_ROUNDS):
            rows = sums([low + (high - low) * k / _GRID for k in range(_GRID + 1)])
            good = [r["alpha"] for r in rows if test(r)]
            bad = [r["alpha"] for r in rows if not test(r)]
            if not good or not bad:
                return high if good else low
            low, high = max(good), min(bad)
        return low

    flat = largest(lambda r: meets(r["alpha"], r["z"], r["e"]))
    # Repeats fall as the exponent grows: the smallest one that is allowed.
    steep = 0.0
    if mix.max_repeats is not None:
        steep = largest(lambda r: repeats(r["alpha"], r["z"]) > mix.max_repeats)
        if steep:
            steep = min(1.0, steep + 10.0**-_DECIMALS)
    alpha = round(max(math.floor(flat * 10**_DECIMALS) / 10**_DECIMALS, math.ceil(steep * 10**_DECIMALS) / 10**_DECIMALS), _DECIMALS)
    z = sums([alpha])[0]["z"]
    wanted = budget(alpha, z)
    if mix.max_repeats is not None:
        wanted = min(wanted, mix.max_repeats * total)
    return alpha, wanted


def plan(sizes: DataFrame, mix: Mix, folder: str) -> DataFrame:
    """One row per source: share, weight, epochs, whole epochs and the cutoff of the last one.

    ``sizes`` has source, block and n_tokens.  A source without tokens costs nothing and
    keeps every row once.
    """
    blocks = written(sizes.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens")), f"{folder}/blocks")
    sources = written(blocks.groupBy("source").agg(F.sum("tokens").alias("tokens")), f"{folder}/sources")
    alpha, budget = exponent(sources, mix)
    whole = sources.agg(F.sum("tokens").alias("total"), F.sum(F.when(F.col("tokens") > 0, 1)).alias("n")).first()
    total = float(whole["total"] or 0) or 1.0
    raised = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / total, F.lit(alpha))).otherwise(0.0)
    z = sources.agg(F.sum(raised)).first()[0] or 1.0
    epochs = F.when(F.col("tokens") > 0, raised / z * budget / F.col("tokens")).otherwise(1.0)
    sources = sources.select(
        "source", "tokens", (F.col("tokens") / total).alias("share"), (raised / z).alias("weight"), epochs.alias("epochs")
    ).withColumn("full", F.floor(F.col("epochs") + _SLACK).cast("int"))
    ordered = blocks.withColumnsRenamed({"source": "of", "tokens": "block_tokens"}).join(
        sources, F.col("of").eqNullSafe(F.col("source"))
    )
    ordered = ordered.withColumn("key", draw(F.lit(mix.seed), F.col("full"), F.col("source"), F.col("block")))
    before = Window.partitionBy("source").orderBy("key", "block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = F.sum("block_tokens").over(before) - F.col("block_tokens") / 2
    rest = (F.col("epochs") - F.col("full")) * F.col("tokens")
    cut = (
        ordered.withColumn("taken", (F.col("block_tokens") > 0) & (filled <= rest))
        .groupBy("source")
        .agg(F.max(F.when(F.col("taken"), F.col("key"))).alias("cutoff"))
        .select(F.col("source").alias("of"), F.coalesce("cutoff", F.lit(-1)).alias("cutoff"))
    )
    planned = sources.join(cut, F.col("of").eqNullSafe(F.col("source"))).drop("of")
    return written(planned.withColumn("exponent", F.lit(alpha)), f"{folder}/plan")


def realise(rows: DataFrame, planned: DataFrame, mix: Mix) -> DataFrame:
    """``rows`` as often as the plan says, with ``epoch`` and ``position``.

    Sorted by ``position`` the sources alternate by their weights from the start to the end.
    """
    facts = planned.select(F.col("source").alias("of"), "epochs", "full", "cutoff")
    joined = rows.join(broadcast_within(facts), F.col("of").eqNullSafe(F.col("source")))
    last = draw(F.lit(mix.seed), F.col("full"), F.col("source"), F.col("block")) <= F.col("cutoff")
    copies = F.col("full") + last.cast("int")
    once = joined.withColumn("epoch", F.explode(F.sequence(F.lit(0), copies))).filter(F.col("epoch") < copies)
    key = draw(F.lit(mix.seed), F.col("epoch"), F.col("source"), F.col("block"))
    position = F.round((F.col("epoch") + key / float(1 << _BITS)) / F.col("epochs"), 6)
    return once.withColumn("position", position).drop("of", "epochs", "full", "cutoff")


def mixed(docs: DataFrame, mix: Mix = Mix(), folder: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, block, epoch, position): a row for every use of a document.

    A null source is a source; a null text has no tokens; a document without tokens comes
    and goes with its block.  Repeated rows are mixed alike, each by itself.  An empty table
    gives an empty result; other columns are not read.
    """
    folder = folder or workspace(docs.sparkSession, "mix")
    sizes = sized(docs.select("doc_id", "source", "text"), mix).select("doc_id", "source", "n_tokens", "block")
    sizes = written(sizes, f"{folder}/sizes")
    return realise(sizes, plan(sizes, mix, folder), mix)


def mix_documents(docs: DataFrame, mix: Mix, folder: str | None = None) -> DataFrame:
    """``docs`` as often as the plan says, in their own columns."""
    folder = folder or workspace(docs.sparkSession, "mix")
    plain = docs.select("doc_id", "source", F.struct("*").alias("row"))
    rows = plain.withColumn("n_tokens", n_words(F.coalesce(F.col("row.text"), F.lit(""))))
    rows = rows.withColumn("block", (draw(F.lit(mix.seed), F.col("doc_id")) % mix.blocks).cast("int"))
    return realise(rows, plan(rows, mix, folder), mix).select("row.*")


def mixed_sql(mix: Mix = Mix()) -> str:
    """What the registered query must equal."""

    def key(*parts: str) -> str:
        text = " || ':' || ".join(f"coalesce(CAST({p} AS VARCHAR), '')" for p in parts)
        return f"CAST('0x' || substr(md5({text}), 1, {_BITS // 4}) AS BIGINT)"

    seed, unit = str(mix.seed), 10**_DECIMALS
    return f"""
    WITH RECURSIVE sizes AS (
        SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens,
               CAST({key(seed, "doc_id")} % {mix.blocks} AS INTEGER) AS block
        FROM documents
    ), sources AS (
        SELECT source, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM sizes GROUP BY source
    ), facts AS (
        SELECT count(*) AS n, sum(tokens) AS total, min(tokens) AS least FROM sources WHERE tokens > 0
    ), flat(k, low, high) AS (
        SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
        UNION ALL
        SELECT k + 1, CASE WHEN ok THEN mid ELSE low END, CASE WHEN ok THEN high ELSE mid END
        FROM (SELECT k, low, high, mid, ln(z) - mid * e / z >= {mix.entropy} * ln(n) - 1e-12 AS ok
              FROM (SELECT k, low, high, any_value((low + high) / 2) AS mid, any_value(n) AS n,
                           sum(pow(tokens / total, (low + high) / 2)) AS z,
                           sum(pow(tokens / total, (low + high) / 2) * ln(tokens / total)) AS e
                    FROM flat, facts, sources WHERE tokens > 0 AND k < 60 GROUP BY k, low, high))
    ), steep(k, low, high) AS (
        SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
        UNION ALL
        SELECT k + 1, CASE WHEN over THEN mid ELSE low END, CASE WHEN over THEN high ELSE mid END
        FROM (SELECT k, low, high, mid, pow(least / total, mid - 1) / z > {mix.max_repeats} AS over
              FROM (SELECT k, low, high, any_value((low + high) / 2) AS mid, any_value(least) AS least,
                           any_value(total) AS total, sum(pow(tokens / total, (low + high) / 2)) AS z
                    FROM steep, facts, sources WHERE tokens > 0 AND k < 60 GROUP BY k, low, high))
    ), chosen AS (
        SELECT round(greatest(
            floor((CASE WHEN f.high = 1 THEN 1 ELSE f.low END) * {unit}) / {unit},
            ceil((CASE WHEN s.low = 0 THEN 0 ELSE s.low + 1.0 / {unit} END) * {unit}) / {unit}), {_DECIMALS}) AS alpha
        FROM flat f, steep s WHERE f.k = 60 AND s.k = 60
    ), weights AS (
        SELECT source, tokens, pow(tokens / total, alpha) AS raised, total FROM sources, facts, chosen WHERE tokens > 0
    ), quotas AS (
        SELECT source, tokens, raised / (SELECT sum(raised) FROM weights) * total / tokens AS epochs FROM weights
        UNION ALL SELECT source, tokens, 1.0 FROM sources WHERE tokens = 0
    ), blocks AS (
        SELECT s.source, s.block, sum(n_tokens) AS block_tokens, any_value(q.tokens) AS tokens,
               any_value(epochs) AS epochs, any_value(CAST(floor(epochs + {_SLACK}) AS INTEGER)) AS whole
        FROM sizes s JOIN quotas q ON s.source IS NOT DISTINCT FROM q.source GROUP BY s.source, s.block
    ), ordered AS (
        SELECT *, {key(seed, "whole", "source", "block")} AS key FROM blocks
    ), filled AS (
        SELECT *, sum(block_tokens) OVER (PARTITION BY source ORDER BY key, block
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - block_tokens / 2 AS amount FROM ordered
    ), planned AS (
        SELECT source, any_value(epochs) AS epochs, any_value(whole) AS whole,
               coalesce(max(key) FILTER (WHERE block_tokens > 0 AND amount <= (epochs - whole) * tokens), -1) AS cutoff
        FROM filled GROUP BY source
    ), uses AS (
        SELECT s.*, p.epochs, unnest(range(whole + CAST({key(seed, "whole", "s.source", "block")} <= cutoff AS INTEGER))) AS epoch
        FROM sizes s JOIN planned p ON s.source IS NOT DISTINCT FROM p.source
    )
    SELECT doc_id, source, n_tokens, block, CAST(epoch AS INTEGER) AS epoch,
           round((epoch + {key(seed, "epoch", "source", "block")} / {float(1 << _BITS)}) / epochs, 6) AS position
    FROM uses
    """
