"""Near-duplicates by DartMinHash signatures, banded joining and exact checks.

**Signature.**  A text is the multiset of its five-word shingles.  Each copy of a shingle
owns a unit region; darts land on it at places that depend on the shingle and the number of
the copy alone, as a Poisson process over ranks.  Every dart names one of ``size``
coordinates, and a coordinate keeps its earliest dart.  Ranks are thrown in doubling layers
until all coordinates are filled, so long and short texts cost about ``size log size``
darts each.  Two texts agree in a coordinate with the probability of their weighted
Jaccard similarity.

**Classes.**  Texts with the same words are one entry.  Entries that agree in all rows of a
band share a bucket, and every bucket links its members to its centre, the member that
shares buckets most often: no pairs within a group are listed.  Links are checked exactly.
Where the check fails, a member may still be near another one of the bucket, so such
members are compared with those of the bucket which may be near by the triangle inequality
and are not yet in the same class.

Classes are connected components over verified links.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postledger.llm.shared import text_of, workspace, written
from postledger.operators.bounds import broadcast_within

# Fixed value: what a word is.
WORD = r"[^\x20\x09-\x0D]+"
_WORDS = re.compile(WORD)

_U = np.uint64
# Multipliers of the splitmix64 generator.
_STEP, _MIX1, _MIX2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
# The first layer of ranks ends at 2**FIRST, each following one at twice the rank, until
# layers are LONGEST long.
_FIRST, _LONGEST = -6, 256.0
# Rows of an Arrow batch that are Python objects at a time.
_SLICE = 500


@dataclass(frozen=True)
class Near:
    words: int = 5
    similarity: float = 0.8
    bands: int = 24
    rows: int = 5

    @property
    def size(self) -> int:
        return self.bands * self.rows


def mixed(x: np.ndarray) -> np.ndarray:
    """A well mixed 64-bit function of 64-bit integers."""
    x = x + _STEP
    x ^= x >> _U(30)
    x *= _MIX1
    x ^= x >> _U(27)
    x *= _MIX2
    x ^= x >> _U(31)
    return x


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) < 200_000 and len(word) <= 64:
            self[word] = value
        return value


def shingles(text: str, words: int, hashes: WordHashes) -> np.ndarray:
    """The hashes of all shingles, copies included.  Shorter texts are one shingle."""
    found = _WORDS.findall(text)
    if not found:
        return np.empty(0, _U)
    h = np.fromiter(map(hashes.__getitem__, found), _U, len(found))
    width = min(words, len(h))
    n = len(h) - width + 1
    out = h[:n].copy()
    with np.errstate(over="ignore"):
        for k in range(1, width):
            out *= _STEP
            out += h[k : n + k]
        return mixed(out)


def regions(grams: np.ndarray) -> np.ndarray:
    """One value per copy of each shingle: equal shingles get the numbers of their copies."""
    grams = np.sort(grams)
    starts = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
    copy = np.arange(len(grams)) - np.repeat(starts, np.diff(np.r_[starts, len(grams)]))
    with np.errstate(over="ignore"):
        return mixed(grams + copy.astype(_U) * _MIX2)


def _layer_bounds(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of layers by number."""
    doubling = int(np.log2(_LONGEST)) - _FIRST + 1
    power = 2.0 ** (_FIRST + np.minimum(k, doubling) - 1.0)
    begin = np.where(k == 0, 0.0, power + _LONGEST * np.maximum(k - doubling, 0))
    return begin, np.where(k == 0, 2.0**_FIRST, np.minimum(power, _LONGEST))


def _uniform(x: np.ndarray) -> np.ndarray:
    return (x >> _U(11)).astype(np.float64) * 2.0**-53


def _throw(areas: np.ndarray, layers: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rank, coordinate and name of every dart on the regions in the given layers.

    How many darts a region has in a layer is Poisson distributed with the layer's length
    as its mean, by inversion of a hash.
    """
    begin, length = _layer_bounds(layers)
    own = mixed(areas[None, :] ^ mixed(layers.astype(_U))[:, None])
    draws = _uniform(own)
    none = np.exp(-length)
    layer, region = np.nonzero(draws >= none[:, None])
    draw, mean, own = draws[layer, region], length[layer], own[layer, region]
    counts = np.ones(len(draw), np.int64)
    term = none[layer] * mean
    total = none[layer] + term
    more = draw >= total
    for n in range(2, 40 + int(8 * _LONGEST)):
        if not more.any():
            break
        counts += more
        term = term * mean / n
        total = total + term
        more = draw >= total
    ends = np.cumsum(counts)
    number = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)
    darts = mixed(np.repeat(own, counts) + (number.astype(_U) + _U(1)) * _MIX1)
    layer = np.repeat(layer, counts)
    ranks = begin[layer] + length[layer] * _uniform(mixed(darts ^ _STEP))
    return ranks, (mixed(darts ^ _MIX2) % _U(size)).astype(np.int64), darts


def signature(areas: np.ndarray, size: int) -> np.ndarray:
    """The earliest dart of every coordinate over the given regions, as 64-bit names.

    The layers that hold about eight darts per coordinate are thrown at once, later ones in
    turn.  Layers come in the order of ranks, so a filled coordinate is final.
    """
    names, empty = np.zeros(size, _U), np.ones(size, bool)
    first, last = 0, max(1, int(np.log2(8 * size / len(areas))) - _FIRST + 1)
    with np.errstate(over="ignore"):
        while empty.any():
            ranks, at, darts = _throw(areas, np.arange(first, last), size)
            earliest = np.full(size, np.inf)
            np.minimum.at(earliest, at, ranks)
            won = np.flatnonzero((ranks == earliest[at]) & empty[at])
            names[at[won]] = darts[won]
            empty[at[won]] = False
            first, last = last, last + 1
    return names


def band_keys(names: np.ndarray, near: Near) -> np.ndarray:
    keys = np.arange(near.bands, dtype=_U)
    with np.errstate(over="ignore"):
        for k in range(near.rows):
            keys = mixed(keys ^ names[k :: near.rows])
    return keys.astype(np.int64)


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two texts' regions: their multisets of shingles intersected, by their union."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared) if shared else 0.0


def entry_of(text: Column) -> Column:
    """What texts with the same words share: a digest of the words.  The digest of no words
    is that of the empty text."""
    words = F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))
    return F.unhex(F.sha2(words, 256))


def _signed(entries: DataFrame, near: Near) -> DataFrame:
    """(id, buckets, prints) of every text with words: a bucket per band, and the low byte of
    every coordinate, eight to a number."""
    padding = -near.size % 8

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for begin in range(0, batch.num_rows, _SLICE):
                part = batch.slice(begin, _SLICE)
                ids, keys, prints = [], [], []
                for key, text in zip(part["id"].to_pylist(), part["text"].to_pylist()):
                    grams = shingles(text, near.words, hashes)
                    if len(grams):
                        names = signature(regions(grams), near.size)
                        ids.append(key)
                        keys.append(band_keys(names, near))
                        prints.append(np.pad(names.astype(np.uint8), (0, padding)).view(np.int64))
                numbers = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(keys, numbers), pa.array(prints, numbers)],
                    ["id", "buckets", "prints"],
                )

    return entries.select("id", "text").mapInArrow(sign, "id long, buckets array<long>, prints array<long>")


def _differing(near: Near) -> Column:
    """In how many coordinates the signatures of ``prints`` and ``x_prints`` differ."""
    low = F.lit(0x0101010101010101)

    def of(k: int) -> Column:
        x = F.get("prints", F.lit(k)).bitwiseXOR(F.get("x_prints", F.lit(k)))
        # Each byte's lowest bit becomes the OR of its bits.
        for step in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, step))
        return F.bit_count(x.bitwiseAND(low))

    return reduce(Column.__add__, [of(k) for k in range((near.size + 7) // 8)])


def _measured(pairs: DataFrame, texts: DataFrame, near: Near) -> DataFrame:
    """``pairs`` (a, b) with the size of a, the exact similarity, and what only a has."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held = WordHashes(), (None, None)
        for batch in batches:
            for begin in range(0, batch.num_rows, _SLICE):
                part, sizes, similar, rests = batch.slice(begin, _SLICE), [], [], []
                for b, left, right in zip(*(part[c].to_pylist() for c in ("b", "a_text", "b_text"))):
                    if held[0] != b:
                        held = (b, regions(shingles(right, near.words, hashes)))
                    own = regions(shingles(left, near.words, hashes))
                    sizes.append(len(own))
                    similar.append(weighted_jaccard(own, held[1]))
                    rests.append(np.setdiff1d(own, held[1], assume_unique=True).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        part["a"], part["b"], pa.array(sizes, pa.int64()), pa.array(similar, pa.float64()),
                        pa.array(rests, pa.list_(pa.int64())),
                    ],
                    ["a", "b", "a_size", "similarity", "rest"],
                )

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("a_text"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("b_text"))
    joined = pairs.join(left, "a").join(right, "b")
    return joined.select("a", "b", "a_text", "b_text").mapInArrow(measure, "a long, b long, a_size long, similarity double, rest array<long>")


def _mark(links: DataFrame) -> tuple:
    """Equal for equal sets of links, and else different but for chance."""
    h = F.xxhash64("a", "b")
    return tuple(links.agg(F.count("*"), F.bit_xor(h), F.sum(h % F.lit(1 << 31))).first())


def components(links: DataFrame, folder: str) -> DataFrame:
    """(id, class) for every linked id; a class is named by its smallest id.

    Large-star and small-star rounds over (a, b): each replaces links by links to smaller
    ids, and a written table ends each round.  The number of rounds grows with the
    logarithm of the longest chain.
    """
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    links = written(links, f"{folder}/links-0")
    for k in range(1, 200):
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        # Large star: every larger neighbour is linked to the smallest neighbour.
        large = (
            both.join(low, "a")
            .filter(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.col("low").alias("b"))
            .distinct()
        )
        # Small star: every smaller neighbour and the id itself are linked to the smallest one.
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("low").alias("b")).union(least.select("a", F.col("low").alias("b")))
        after = written(small.filter("a > b").distinct(), f"{folder}/links-{k}")
        settled, links = _mark(after) == _mark(links), after
        if settled:
            break
    else:
        raise RuntimeError("the classes did not settle")
    stars = links.select(F.col("a").alias("id"), F.col("b").alias("class"))
    return stars.union(links.select(F.col("b").alias("id"), F.col("b").alias("class")).distinct())


def near_classes(docs: DataFrame, near: Near = Near(), folder: str | None = None) -> DataFrame:
    """(doc_id, class_id, class_size) for every document id; a class is named by its smallest id.

    Two documents are linked if their multisets of shingles have a weighted Jaccard
    similarity of at least ``near.similarity``; classes are what links connect.  Texts of
    fewer words than a shingle are one shingle of all their words.  Texts without words
    (null and empty ones) are copies of each other and near nothing else.  Repeated rows
    count once.  Of several texts under one id that of the least digest counts.  Rows
    without an id have no class.  Empty tables give empty results; other columns are not read.
    """
    folder = folder or workspace(docs.sparkSession, "near")
    rows = docs.select("doc_id", text_of().alias("text")).filter(F.col("doc_id").isNotNull())
    keyed = rows.withColumn("entry", entry_of(F.col("text")))
    keys = written(keyed.select("doc_id", "entry"), f"{folder}/keys")
    versions = keys.groupBy("doc_id").agg(F.min("entry").alias("entry"))
    entries = written(
        versions.groupBy("entry").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")), f"{folder}/entries"
    )
    # Rows that stand for no entry are named, not those that do: they are far fewer.
    chosen = entries.select(F.col("id").alias("doc_id"), "entry")
    others = written(keys.join(chosen, ["doc_id", "entry"], "left_anti").distinct(), f"{folder}/others")
    texts = keyed.join(broadcast_within(others), ["doc_id", "entry"], "left_anti")
    texts = texts.select(F.col("doc_id").alias("id"), "text")

    signed = written(_signed(texts, near), f"{folder}/signed")
    banded = signed.select(F.explode("buckets").alias("bucket"), "id").distinct()
    sizes = banded.groupBy("bucket").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n"))
    shared = written(banded.join(sizes.filter("low < high"), "bucket"), f"{folder}/shared")
    # The original of many copies shares more buckets than any two copies do with each other.
    wanted = written(shared.groupBy("id").agg(F.sum("n").alias("met")), f"{folder}/wanted")
    most = F.min(F.struct((-F.col("met")).alias("less"), "id")).alias("most")
    centres = shared.join(wanted, "id").groupBy("bucket").agg(most).select("bucket", F.col("most.id").alias("centre"))
    shared = written(shared.select("bucket", "id").join(centres, "bucket"), f"{folder}/centred")
    wanted = wanted.select("id")
    texts = texts.join(broadcast_within(wanted), "id", "left_semi").dropDuplicates(["id"])
    texts = written(texts, f"{folder}/texts")

    pairs = shared.filter("id <> centre").select(F.col("id").alias("a"), F.col("centre").alias("b")).distinct()
    stars = written(_measured(pairs, texts, near), f"{folder}/stars")
    links = stars.filter(F.col("similarity") >= near.similarity).select("a", "b")
    classes = components(links, f"{folder}/classes")

    rest = written(_unsettled(shared, stars, classes, signed, near), f"{folder}/rest")
    if not rest.isEmpty():
        more = _measured(rest, texts, near).filter(F.col("similarity") >= near.similarity).select("a", "b")
        classes = components(links.union(written(more, f"{folder}/more")), f"{folder}/all-classes")

    named = entries.join(classes, "id", "left").withColumn("class_id", F.coalesce("class", "id"))
    sizes = named.groupBy("class_id").agg(F.sum("n").alias("class_size"))
    named = named.select("entry", "class_id").join(sizes, "class_id")
    return versions.join(named, "entry").select("doc_id", "class_id", "class_size")


def _unsettled(shared: DataFrame, stars: DataFrame, classes: DataFrame, signed: DataFrame, near: Near) -> DataFrame:
    """Pairs (a, b) of a bucket that may be near, though they are in different classes so far.

    One of the two is then in another class than the bucket's centre.  By the triangle
    inequality, distances to the centre that differ by more than the limit rule a pair out,
    and so do sizes.  What two members share is either shared with the centre too, or is
    among what both have beyond the centre: where the first is too little and the second
    nothing, they are not near.  All this is exact.  What is left must agree in as many
    coordinates as near texts do but for four standard deviations; that misses a pair at
    the very limit about as rarely as the bands do.
    """
    own = classes.select("id", F.col("class").alias("own"))
    centre = classes.select(F.col("id").alias("centre"), F.col("class").alias("of_centre"))
    stars = stars.withColumnsRenamed({"a": "id", "b": "centre"})
    members = (
        shared.filter("id <> centre")
        .join(own, "id", "left")
        .join(centre, "centre", "left")
        .select("bucket", "id", "centre", F.coalesce("own", "id").alias("own"), F.coalesce("of_centre", "centre").alias("of_centre"))
    )
    open_buckets = members.filter("own <> of_centre").select("bucket").distinct()
    members = (
        members.join(open_buckets, "bucket", "left_semi")
        .join(stars, ["id", "centre"])
        .join(signed.select("id", "prints").dropDuplicates(["id"]), "id")
    )
    told = ("id", "a_size", "similarity", "own", "rest", "prints")
    outside = members.filter("own <> of_centre").select("bucket", *[F.col(c).alias(f"x_{c}") for c in told])
    limit, far = near.similarity, 1.0 - near.similarity + 1e-9
    spread = math.sqrt(near.size * limit * (1.0 - limit))
    most = math.ceil(near.size * (1.0 - limit) + 4.0 * spread)
    needed = limit / (1.0 + limit) * (F.col("x_a_size") + F.col("a_size")) - 1e-6
    with_centre = F.least(F.col("x_a_size") - F.size("x_rest"), F.col("a_size") - F.size("rest"))
    return (
        outside.join(members, "bucket")
        .filter("x_own <> own")
        .filter(F.abs(F.col("x_similarity") - F.col("similarity")) <= far)
        .filter(F.least("x_a_size", "a_size") >= limit * F.greatest("x_a_size", "a_size"))
        .filter(_differing(near) <= most)
        .filter((with_centre >= needed) | F.arrays_overlap("x_rest", "rest"))
        .select(F.greatest("x_id", "id").alias("a"), F.least("x_id", "id").alias("b"))
        .distinct()
    )


def keep_one(docs: DataFrame, near: Near = Near(), folder: str | None = None) -> DataFrame:
    """The rows of ``docs`` whose document names its class; repeated rows of it stay once.

    Of an id held by several different texts, the version that decided its class stays:
    that of the least digest (``near_classes``).  Rows without an id stay.  Columns are
    those of ``docs``; names used here inside begin with two underscores.
    """
    folder = folder or workspace(docs.sparkSession, "near")
    classes = written(near_classes(docs, near, folder), f"{folder}/result")
    copies = classes.filter("doc_id <> class_id").select(F.col("doc_id").alias("__copy"))
    kept = docs.join(broadcast_within(copies), docs["doc_id"] == copies["__copy"], "left_anti")
    keys = docs.sparkSession.read.parquet(f"{folder}/keys")
    repeated = written(
        keys.groupBy(F.col("doc_id").alias("__again")).count().filter("count > 1").select("__again"), f"{folder}/repeated"
    )
    if repeated.isEmpty():
        return kept
    repeated = broadcast_within(repeated)
    once = kept.join(repeated, kept["doc_id"] == repeated["__again"], "left_anti")
    twice = kept.join(repeated, kept["doc_id"] == repeated["__again"], "left_semi")
    versions = twice.withColumn("__entry", entry_of(text_of()))
    least = versions.groupBy(F.col("doc_id").alias("__id")).agg(F.min("__entry").alias("__least"))
    chosen = versions.join(least, (versions["doc_id"] == least["__id"]) & (versions["__entry"] == least["__least"]))
    return once.unionByName(chosen.dropDuplicates(["doc_id", "__entry"]).select(*docs.columns))
