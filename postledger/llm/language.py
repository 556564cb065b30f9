"""Language identification by Bayesian fusion of evidence.

Four kinds of evidence are combined per row: the likelihood of the text under each
language, the language its markup declares, and a prior of its host that is smoothed by the
prior of the domain, that by the prior of the address suffix, and that by all rows.

Text likelihoods are multinomials over hashed word features, counted on all labelled texts
in one pass whose tasks send counts only.  Texts stay where they lie.  Priors are sums of
text posteriors by host, combined before the shuffle, so a host of a third of all rows is
no hot task; a row's own posterior is taken out of its priors, lest it vouch for itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postledger.llm.shared import text_of, workspace, written
from postledger.operators.bounds import broadcast_within

_WORDS = re.compile(r"[^\W\d_]+")
_SLICE = 500
LEVELS = ("suffix", "domain", "host")


@dataclass(frozen=True)
class Evidence:
    """``buckets``: of hashed features.  ``alpha``: their pseudo-count.  ``words``: how many
    words a text's evidence counts for at most, as words are not independent.  ``trust``:
    prior share of declarations that are right, worth ``declared`` rows.  ``kappa``: rows
    that the wider level of a prior is worth.  ``languages``: most languages, which bounds
    the broadcast model to ``languages * buckets`` doubles."""

    buckets: int = 1 << 15
    alpha: float = 0.1
    words: int = 50
    trust: float = 0.9
    declared: float = 100.0
    kappa: float = 20.0
    languages: int = 64


class Features(dict):
    """The buckets of a word: of itself, its beginning and its end; remembered up to a bound."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, word: str) -> tuple[int, int, int]:
        found = tuple(
            xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) % self.buckets
            for x in ("=" + word, "<" + word[:2], word[-3:] + ">")
        )
        if len(self) < 200_000 and len(word) <= 64:
            self[word] = found
        return found

    def of(self, text: str) -> np.ndarray:
        """The buckets of all words of a text, three each."""
        words = _WORDS.findall(text.lower())
        flat = [b for f in map(self.__getitem__, words) for b in f]
        return np.array(flat, np.int64)


def _counts(labelled: DataFrame, setting: Evidence) -> DataFrame:
    """(lang, bucket, n) over all labelled texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, sums = Features(setting.buckets), {}
        for batch in batches:
            for begin in range(0, batch.num_rows, _SLICE):
                part = batch.slice(begin, _SLICE)
                for lang, text in zip(part["lang"].to_pylist(), part["text"].to_pylist()):
                    own = sums.setdefault(lang, np.zeros(setting.buckets, np.int64))
                    np.add.at(own, features.of(text), 1)
        for lang, own in sums.items():
            there = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(there), pa.string()), pa.array(there, pa.int64()), pa.array(own[there])],
                ["lang", "bucket", "n"],
            )

    parts = labelled.select("lang", "text").mapInArrow(count, "lang string, bucket long, n long")
    return parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def text_model(labelled: DataFrame, setting: Evidence, folder: str) -> tuple[list[str], np.ndarray]:
    """The languages in order, and the log likelihood of every bucket under each."""
    counts = written(_counts(labelled.filter(F.col("lang").isNotNull()), setting), f"{folder}/counts")
    languages = [r["lang"] for r in counts.select("lang").distinct().limit(setting.languages + 1).collect()]
    if len(languages) > setting.languages:
        raise ValueError(f"more than {setting.languages} languages")
    languages.sort()
    table = np.full((setting.buckets, max(1, len(languages))), setting.alpha)
    for lang, bucket, n in counts.collect():  # at most a row per language and bucket
        table[bucket, languages.index(lang)] += n
    return languages, np.log(table / table.sum(0))


def text_evidence(rows: DataFrame, keys: list[str], model: np.ndarray, setting: Evidence) -> DataFrame:
    """``keys`` of ``rows`` with ``ll``, the log likelihoods of ``text``, tempered.

    The model is broadcast; its size is bounded by ``setting``.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)
    schema = rows.select(*keys).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, table = Features(setting.buckets), shared.value
        for batch in batches:
            for begin in range(0, batch.num_rows, _SLICE):
                part, found = batch.slice(begin, _SLICE), []
                for text in part["text"].to_pylist():
                    own = features.of(text)
                    n = len(own) // 3
                    sums = table[own].sum(0) if n else np.zeros(table.shape[1])
                    found.append(sums / 3 * min(1.0, setting.words / n) if n else sums)
                yield pa.RecordBatch.from_arrays(
                    [*(part[k] for k in keys), pa.array(found, pa.list_(pa.float64()))], [*keys, "ll"]
                )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return rows.select(*keys, "text").mapInArrow(score, f"{fields}, ll array<double>")


def _normal(scores: Column) -> Column:
    """Softmax of an array."""
    top = F.array_max(scores)
    powers = F.transform(scores, lambda x: F.exp(x - top))
    return F.transform(powers, lambda p: p / F.aggregate(powers, F.lit(0.0), lambda t, x: t + x))


def identify(rows: DataFrame, labelled: DataFrame, keys: list[str], setting: Evidence = Evidence(), folder: str | None = None) -> DataFrame:
    """``keys`` of every row with ``lang``, its ``probability`` and ``text_lang``.

    ``rows`` has text, declared, host, domain and suffix, of which any may be null:
    evidence that is missing says nothing, and a row without any gets the overall prior.
    ``labelled`` has text and lang; rows without a lang are left out, and the languages are
    those it holds.  Declarations of other languages say nothing.  Ties go to the language
    that comes first.  Repeated rows are rows of their own; empty tables give an empty
    result; without labelled texts ``lang`` is null.  Other columns are not read.
    """
    folder = folder or workspace(rows.sparkSession, "language")
    languages, model = text_model(labelled.withColumn("text", text_of()), setting, folder)
    n = len(languages)
    if not n:
        return rows.select(*keys, *[F.lit(None).cast(t).alias(c) for c, t in (("lang", "string"), ("probability", "double"), ("text_lang", "string"))])
    carried = [*keys, "declared", *LEVELS]
    seen = text_evidence(rows.withColumn("text", text_of()), carried, model, setting)
    seen = written(seen.withColumn("p", _normal(F.col("ll"))), f"{folder}/evidence")

    sums = [F.sum(F.get("p", F.lit(i))).alias(f"s{i}") for i in range(n)]
    as_array = F.array(*[F.coalesce(f"s{i}", F.lit(0.0)) for i in range(n)])
    whole = seen.agg(*sums).select(as_array.alias("a")).first()["a"]
    overall = [(w + 1.0) / (sum(whole) + n) for w in whole]

    # Narrower levels know their wider ones, so that one join brings all.
    by = {}
    for k, level in enumerate(LEVELS):
        by[level] = seen.groupBy(*LEVELS[: k + 1]).agg(*sums).select(*LEVELS[: k + 1], as_array.alias(f"n_{level}"))
    hosts = by["host"]
    for k, level in enumerate(LEVELS[:-1]):
        wide = by[level].select(*[F.col(c).alias(f"of_{c}") for c in LEVELS[: k + 1]], f"n_{level}")
        same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in LEVELS[: k + 1]]
        hosts = hosts.join(wide, same).drop(*[f"of_{c}" for c in LEVELS[: k + 1]])
    hosts = written(hosts.select(*[F.col(c).alias(f"its_{c}") for c in LEVELS], *[f"n_{c}" for c in LEVELS]), f"{folder}/hosts")

    # How often each language is declared as which: at most a row per pair of languages.
    told = seen.filter(F.col("declared").isin(languages)).groupBy("declared").agg(*sums).select("declared", as_array.alias("a"))
    told = {r["declared"]: r["a"] for r in told.collect()}
    wrong = (1 - setting.trust) / max(1, n - 1)
    matrix = np.array([told.get(d, [0.0] * n) for d in languages]).T  # by language, then declared
    matrix = matrix + setting.declared * np.where(np.eye(n, dtype=bool), setting.trust, wrong)
    says = np.log(matrix / matrix.sum(1, keepdims=True)).T  # by declared, then language
    declared = F.create_map(*[x for d, row in zip(languages, says) for x in (F.lit(d), F.lit([float(v) for v in row]))])

    same = [F.col(c).eqNullSafe(F.col(f"its_{c}")) for c in LEVELS]
    joined = seen.join(broadcast_within(hosts), same)
    prior = F.lit(overall)
    for level in LEVELS:
        without_own = F.zip_with(f"n_{level}", "p", lambda s, p: F.greatest(s - p, F.lit(0.0)))
        rows_there = F.aggregate(without_own, F.lit(0.0), lambda t, x: t + x)
        smoothed = F.zip_with(without_own, prior, lambda s, q: (s + setting.kappa * q) / (rows_there + setting.kappa))
        joined = joined.withColumn(f"prior_{level}", F.when(F.col(level).isNull(), prior).otherwise(smoothed))
        prior = F.col(f"prior_{level}")
    nothing = F.lit([0.0] * n)
    fused = F.zip_with(
        F.zip_with("ll", F.coalesce(F.try_element_at(declared, F.col("declared")), nothing), lambda a, b: a + b),
        F.transform(prior, lambda q: F.log(q)),
        lambda a, b: a + b,
    )
    names = F.lit(languages)

    def best(scores: Column) -> Column:
        return F.get(names, (F.array_position(scores, F.array_max(scores)) - 1).cast("int"))

    return joined.withColumn("fused", _normal(fused)).select(
        *keys,
        best(F.col("fused")).alias("lang"),
        F.round(F.array_max("fused"), 6).alias("probability"),
        best(F.col("p")).alias("text_lang"),
    )


def page_rows(pages: DataFrame) -> DataFrame:
    """Pages (page_id, url, html) as rows for :func:`identify`."""
    html = F.coalesce("html", F.lit(""))
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[#\w]+;", " ")
    declared = F.lower(F.regexp_extract(html, r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})\b""", 1))
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    labels = F.split("host", r"\.")
    return (
        pages.select("page_id", bare.alias("text"), F.nullif(declared, F.lit("")).alias("declared"), F.nullif(host, F.lit("")).alias("host"))
        .withColumn("suffix", F.element_at(labels, -1))
        .withColumn("domain", F.substring_index("host", ".", -2))
    )
