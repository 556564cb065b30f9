"""Quality rules: surface counts, then a hashed n-gram log-likelihood ratio.

Multinomials over hashed n-grams are counted: of the trusted documents, of those labelled
bad, and of the whole raw corpus, each distinct text once however many copies it has.  A
document's verdict is the mean log ratio of its n-grams, so that long and short documents
compare, against a fixed threshold: the same document always gets the same verdict for the
same tables.

Where labels call some documents bad, no n-gram is expected more often than labelled
documents have it: one they say nothing on, as of a language or source without labels, has
a ratio near 0.  Where nothing is labelled bad, the raw corpus is all there is to compare with.

Everything is DataFrame code.  Copies are found by digests and ids only; the rows passed
over are named, not those that count.  Counting is one pass that explodes n-grams into a hash
aggregation of ``buckets`` groups, combined before the shuffle; so one source holding a
third of all rows changes nothing.  Scoring is a projection without any shuffle: the log
ratios, ``buckets`` doubles, are a scalar subquery.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postledger.llm.shared import text_of, workspace, written
from postledger.operators.bounds import broadcast_within

# Words, white space, symbols and limits of the surface rules.
WORD = r"[^\x20\x09-\x0D]+"
WHITE_SPACE = " \t\n\u000b\f\r"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50

# n-grams are of these tokens: runs of letters and digits, or of other visible characters.
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"


@dataclass(frozen=True)
class Rules:
    """``buckets``: of hashed n-grams.  ``smoothing``: added to how often the target has a bucket
    and to how often it would by the other shares, so that rare buckets say little.  ``threshold``: least mean log ratio of a kept document.
    ``max_trusted``: how many documents labelled good the target multinomial is counted on, and
    how many labelled bad theirs, those of least hashed id."""

    buckets: int = 1 << 15
    smoothing: float = 5.0
    threshold: float = -0.35
    max_trusted: int = 20_000


_RATIOS = "log ratios by bucket"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def n_duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    return let(lines, lambda found: F.size(found) - F.size(F.array_distinct(found)))


def n_repeated_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more.

    Windows are told apart by 64-bit hashes.  Sorted with their positions, equal ones are
    neighbours, so the work is n log n however repetitive the text is.
    """

    def covered(at: Column) -> Column:
        step = F.transform(at, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - p, F.lit(3))))
        return F.aggregate(step, F.lit(0), lambda total, n: total + n)

    def repeated(placed: Column) -> Column:
        def again(window: Column, k: Column) -> Column:
            key = window["h"]
            return F.coalesce(F.get(placed, k - 1)["h"] == key, F.lit(False)) | F.coalesce(
                F.get(placed, k + 1)["h"] == key, F.lit(False)
            )

        return F.transform(F.filter(placed, again), lambda window: window["p"])

    def positions(windows: Column) -> Column:
        placed = F.transform(windows, lambda h, p: F.struct(h.alias("h"), p.alias("p")))
        return F.array_sort(let(F.sort_array(placed), repeated))

    def among(windows: Column) -> Column:
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(
            let(positions(windows), covered)
        )

    def windows(found: Column) -> Column:
        return F.transform(
            F.slice(found, 1, F.size(found) - 2),
            lambda word, k: F.xxhash64(word, F.get(found, k + 1), F.get(found, k + 2)),
        )

    return let(words, lambda found: F.when(F.size(found) < 4, F.lit(0)).otherwise(let(windows(found), among)))


def surface(text: Column) -> dict[str, Column]:
    """The surface counts of a text, null counting as empty."""
    bare = F.length(F.translate(text, WHITE_SPACE, ""))
    words = words_of(text)
    counts = {
        "n_words": F.size(words),
        "word_chars": bare,
        "n_symbols": F.length(text) - F.length(F.translate(text, SYMBOLS, "")),
        "n_dup_lines": n_duplicate_lines(text),
        "n_repeat_words": n_repeated_words(words),
    }
    return {name: count.cast("long") for name, count in counts.items()}


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")
    )


def ngram_buckets(text: Column, buckets: int) -> Column:
    """The buckets of all tokens and of all pairs of neighbouring tokens."""

    def hashed(tokens: Column) -> Column:
        single = F.transform(tokens, lambda t: F.pmod(F.hash(t), F.lit(buckets)))
        pairs = F.transform(
            F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))),
            lambda t, k: F.pmod(F.hash(t, F.get(tokens, k + 1)), F.lit(buckets)),
        )
        return F.concat(single, pairs)

    return let(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), hashed)


def trusted(labels: DataFrame, rules: Rules, quality: int = 1) -> DataFrame:
    """Ids of the documents labelled good, or those of another label, at most
    ``rules.max_trusted``, always the same ones."""
    chosen = labels.filter((F.col("quality") == quality) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rules.max_trusted)


def distinct_texts(docs: DataFrame, labels: DataFrame, rules: Rules, folder: str) -> DataFrame:
    """(text, is_trusted, is_bad) of every distinct text of ``docs``, once; a mark is null or 1.

    A text has the marks of all its copies.
    """
    rows = docs.select("doc_id", text_of().alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    keys = written(rows.groupBy("doc_id", "digest").agg(F.count("*").alias("n")), f"{folder}/keys")
    good = F.broadcast(trusted(labels, rules).withColumn("is_trusted", F.lit(1)))
    bad = F.broadcast(trusted(labels, rules, 0).withColumn("is_bad", F.lit(1)))
    texts = (
        keys.join(good, "doc_id", "left")
        .join(bad, "doc_id", "left")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("least_id"), F.max("is_trusted").alias("is_trusted"), F.max("is_bad").alias("is_bad"))
    )
    texts = written(texts, f"{folder}/texts")
    marks = texts.filter("is_trusted = 1 or is_bad = 1").select("digest", "is_trusted", "is_bad")

    def at(named: DataFrame) -> tuple[DataFrame, Column]:
        named = named.select(F.col("doc_id").alias("other_id"), F.col("digest").alias("other_digest"))
        return named, F.col("doc_id").eqNullSafe(F.col("other_id")) & (F.col("digest") == F.col("other_digest"))

    counted, same = at(texts.withColumnRenamed("least_id", "doc_id"))
    copies = written(keys.join(counted, same, "left_anti").select("doc_id", "digest"), f"{folder}/copies")
    copies, same = at(copies)
    once = rows.join(broadcast_within(copies), same, "left_anti")
    repeated = written(keys.filter("n > 1").select("doc_id", "digest"), f"{folder}/repeated")
    if not repeated.isEmpty():
        repeated, same = at(repeated)
        repeated = broadcast_within(repeated)
        twice = once.join(repeated, same, "left_semi").dropDuplicates(["digest"])
        once = once.join(repeated, same, "left_anti").unionByName(twice)
    return once.join(F.broadcast(marks), "digest", "left").select("text", "is_trusted", "is_bad")


def log_ratios(docs: DataFrame, labels: DataFrame, rules: Rules, folder: str) -> DataFrame:
    """One row: the log ratio of every bucket, as an array.

    Without trusted documents all ratios are 0 and only the surface rules decide.
    """
    grams = distinct_texts(docs, labels, rules, folder)
    counts = (
        grams.select("is_trusted", "is_bad", F.explode(ngram_buckets(F.col("text"), rules.buckets)).alias("bucket"))
        .groupBy("bucket")
        .agg(F.count("*").alias("raw"), F.count("is_trusted").alias("target"), F.count("is_bad").alias("bad"))
    )
    all_buckets = docs.sparkSession.range(rules.buckets).select(F.col("id").cast("int").alias("bucket"))
    counts = all_buckets.join(counts, "bucket", "left").fillna(0, ["raw", "target", "bad"])
    counts = written(counts, f"{folder}/ngrams")
    sums = counts.agg(F.struct(*[F.sum(c).alias(c) for c in ("raw", "target", "bad")])).scalar()
    raw = (F.col("raw") + 1) / (sums["raw"] + rules.buckets)
    known = (F.col("target") + F.col("bad") + 1) / (sums["target"] + sums["bad"] + rules.buckets)
    share = F.when(sums["bad"] > 0, F.least(raw, known)).otherwise(raw)
    ratio = (F.col("target") + rules.smoothing) / (sums["target"] * share + rules.smoothing)
    return counts.select("bucket", F.log(ratio).alias("ratio")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("bucket", "ratio"))), lambda r: r["ratio"]).alias("ratios")
    )


def mean_log_ratio(text: Column, ratios: Column, buckets: int) -> Column:
    """The length-normalised log ratio of a text; 0 without n-grams."""

    def mean(grams: Column) -> Column:
        total = F.aggregate(grams, F.lit(0.0), lambda t, g: t + F.get(ratios, g))
        return F.when(F.size(grams) == 0, F.lit(0.0)).otherwise(total / F.size(grams))

    return let(ngram_buckets(text, buckets), mean)


def judge(docs: DataFrame, labels: DataFrame, rules: Rules = Rules(), folder: str | None = None) -> DataFrame:
    """``docs`` with the surface counts, ``base_failed``, ``log_ratio`` and ``kept``.

    Needs ``doc_id`` and ``text``; columns of these names are replaced, others pass
    through.  A null text counts as empty and fails the surface rules.  Repeated rows and
    rows without an id are judged each by itself; a text counts once in the corpus however
    many rows have it.  An empty table gives an empty result.
    """
    folder = folder or workspace(docs.sparkSession, "quality")
    ratios = log_ratios(docs, labels, rules, folder).scalar()
    text = text_of()
    # A subquery may not stand inside a higher-order function, hence the column for it.
    scored = (
        docs.withColumn(_RATIOS, ratios)
        .withColumns({**surface(text), "log_ratio": mean_log_ratio(text, F.col(_RATIOS), rules.buckets)})
        .drop(_RATIOS)
        .withColumn("base_failed", base_failed())
    )
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("log_ratio") >= rules.threshold))
