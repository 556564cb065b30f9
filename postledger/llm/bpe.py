"""Byte pair encoding and decoding by a contiguous rank array.

A word is a list of parts with the rank of every adjacent pair beside it.  The smallest
rank is found by scanning, the boundary between its two parts is deleted, and the two
neighbouring ranks are looked up again.  For short words that beats any queue.  Words of
more than ``SHORT`` parts would make the scan quadratic, so they take the same steps from
a heap.

Texts are encoded where they lie: no shuffle, some rows at a time.  The vocabulary
file is read on the driver and broadcast; ``MAX_VOCABULARY_BYTES`` bounds it.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postledger.llm.shared import text_of

SHORT = 64
MAX_VOCABULARY_BYTES = 64 << 20
# Words a task remembers, and the longest of them; more are merged again each time.
MEMO_WORDS = 200_000
MEMO_CHARS = 64
# Above this many characters words are taken one by one instead of as a list.
LIST_CHARS = 1 << 20

_NEVER = 1 << 60


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 characters stand for themselves; the other bytes follow, in order,
    from code point 256 on.
    """
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """A BPE model of a tokenizers file: its pieces, merge ranks and how texts become words."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("continuing_subword_prefix"):
            raise ValueError("a BPE model over bytes is needed")
        self.ids: dict[str, int] = dict(model["vocab"])
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.ranks.setdefault(self.ids[left] << 32 | self.ids[right], rank)
            self.made.append(self.ids[left + right])
        self.symbols = byte_symbols()
        self.inner = [self.ids[s] for s in self.symbols]
        self.final = [self.ids[s + self.suffix] for s in self.symbols]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec.get("added_tokens", ())):
            raise ValueError("added tokens must be plain strings")
        self.pieces = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.special.items()}
        self.normalise, pattern = _reading(spec)
        self.words = regex.compile(pattern)
        self.later = regex.compile(f"[{later_letters()}]")
        self.older_words = regex.compile(_without(pattern, later_letters()), regex.V1)
        # Of several special strings that begin at one place the longest counts.
        wanted = sorted(self.special, key=len, reverse=True)
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, wanted)) + ")") if wanted else None

    def parts(self, word: str) -> list[int]:
        raw = word.encode("utf-8")
        parts = [self.inner[b] for b in raw]
        parts[-1] = self.final[raw[-1]]
        return parts

    def encode_word(self, word: str) -> list[int]:
        parts = self.parts(word)
        return merge_short(parts, self) if len(parts) <= SHORT else merge_long(parts, self)

    def segments(self, text: str) -> Iterator[tuple[bool, str]]:
        """The text in order, cut at special strings: (is special, segment)."""
        if self.special_split is None or not any(s in text for s in self.special):
            yield False, text
            return
        for k, segment in enumerate(self.special_split.split(text)):
            if segment:
                yield bool(k % 2), segment

    def words_of(self, segment: str) -> Iterator[str]:
        segment = self.normalise(segment)
        words = self.words
        if not segment.isascii() and self.later.search(segment):
            words = self.older_words
        if len(segment) <= LIST_CHARS:
            return words.findall(segment)
        return (m.group() for m in words.finditer(segment))


# The tokenizers library knows Unicode 16 letters and numbers and Unicode 17
# lower case.  The regex module also holds these later ranges for letters or numbers ...
_LATER = (
    "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf "
    "10940-10959 10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1-11df1 1246f 12475-1247f "
    "12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 "
    "18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff "
    "1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e "
    "2cea2-2cead 323b0-33479 3d000-3fc3f"
).split()
# ... and Python's own tables lack the lower case of these: code point, its lower case, how many.
_LOWER = [
    (0x1C89, 0x1C8A, 1), (0xA7CB, 0x264, 1), (0xA7CC, 0xA7CD, 1), (0xA7CE, 0xA7CF, 1), (0xA7D2, 0xA7D3, 1),
    (0xA7D4, 0xA7D5, 1), (0xA7DA, 0xA7DB, 1), (0xA7DC, 0x19B, 1), (0x10D50, 0x10D70, 22), (0x16EA0, 0x16EBB, 25),
]
_LOWERED = {upper + k: lower + k for upper, lower, n in _LOWER for k in range(n)}
_LOWERABLE = regex.compile("[" + "".join(map(chr, _LOWERED)) + "]")


def later_letters() -> str:
    """The later ranges as the inside of a character class."""
    return "".join(f"\\U{int(r.split('-')[0], 16):08x}-\\U{int(r.split('-')[-1], 16):08x}" for r in _LATER)


def _without(pattern: str, later: str) -> str:
    for kind in (r"\p{L}", r"\p{N}"):
        pattern = pattern.replace(kind, f"[{kind}--[{later}]]")
    return pattern


def _lowered(text: str) -> str:
    # Character by character: without the special form of sigma at the end of a word.
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
    return text.translate(_LOWERED) if _LOWERABLE.search(text) else text


# How the two kinds of file cut texts into words.
_BYTE_LEVEL_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NORMALISERS = ["NFC", "Replace", "Lowercase"]


def _reading(spec: dict) -> tuple[Callable[[str], str], str]:
    before, cut = spec.get("normalizer"), spec["pre_tokenizer"]
    if before is None and cut["type"] == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"]:
        return (lambda text: text), _BYTE_LEVEL_WORDS
    if (
        before is not None
        and [n["type"] for n in before.get("normalizers", ())] == _NORMALISERS
        and [c["type"] for c in cut.get("pretokenizers", ())] == ["Split", "ByteLevel"]
        and cut["pretokenizers"][0]["invert"]
        and cut["pretokenizers"][0]["behavior"] == "Removed"
    ):
        # Runs of white space become one blank first; no word holds any, so that changes nothing.
        return _lowered, cut["pretokenizers"][0]["pattern"]["Regex"]
    raise ValueError("this way of cutting texts is not known")


def merge_short(parts: list[int], vocabulary: Vocabulary) -> list[int]:
    """Merges ``parts`` in place, scanning the rank array for the minimum."""
    rank_of, made = vocabulary.ranks, vocabulary.made
    ranks = [rank_of.get(a << 32 | b, _NEVER) for a, b in zip(parts, parts[1:])]
    while ranks:
        low = min(ranks)
        if low == _NEVER:
            break
        at = ranks.index(low)
        parts[at] = made[low]
        del parts[at + 1], ranks[at]
        if at:
            ranks[at - 1] = rank_of.get(parts[at - 1] << 32 | parts[at], _NEVER)
        if at < len(ranks):
            ranks[at] = rank_of.get(parts[at] << 32 | parts[at + 1], _NEVER)
    return parts


def merge_long(parts: list[int], vocabulary: Vocabulary) -> list[int]:
    """The same merges in the same order, from a heap, for long words."""
    rank_of, made, n = vocabulary.ranks, vocabulary.made, len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []

    def offer(at: int) -> None:
        if at >= 0 and after[at] < n:
            pair = parts[at] << 32 | parts[after[at]]
            if (rank := rank_of.get(pair)) is not None:
                heapq.heappush(heap, (rank, at, pair))

    for at in range(n - 1):
        offer(at)
    while heap:
        rank, at, pair = heapq.heappop(heap)
        right = after[at]
        if right >= n or parts[at] < 0 or parts[at] << 32 | parts[right] != pair:
            continue
        parts[at], parts[right] = made[rank], -1
        after[at] = after[right]
        if after[at] < n:
            before[after[at]] = at
        offer(before[at])
        offer(at)
    return [p for p in parts if p >= 0]


class Memo(dict):
    """What ``make`` gives for a word, remembered within ``MEMO_WORDS`` and ``MEMO_CHARS``."""

    def __init__(self, make: Callable[[str], object], known: dict | None = None):
        super().__init__(known or {})
        self.make, self.room = make, MEMO_WORDS

    def __missing__(self, word: str):
        value = self.make(word)
        if self.room and len(word) <= MEMO_CHARS:
            self[word] = value
            self.room -= 1
        return value


class Codec:
    """Packs the ids of texts as little-endian unsigned 32-bit integers, and back."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.packed = Memo(lambda word: _pack(vocabulary.encode_word(word)))
        self.special = {s: _pack([i]) for s, i in vocabulary.special.items()}

    def encode(self, text: str) -> bytes:
        packed, out = self.packed, []
        for is_special, segment in self.vocabulary.segments(text):
            if is_special:
                out.append(self.special[segment])
            else:
                out.append(b"".join(map(packed.__getitem__, self.vocabulary.words_of(segment))))
        return b"".join(out)

    def decode(self, packed: bytes) -> str:
        return " ".join(map(self.vocabulary.pieces.__getitem__, unpack(packed)))


def _pack(ids: list[int]) -> bytes:
    return b"".join(i.to_bytes(4, "little") for i in ids)


def unpack(packed: bytes) -> list[int]:
    ids = array("I", packed)
    if ids.itemsize != 4:
        raise RuntimeError("no 32-bit integers here")
    if _BIG_ENDIAN:
        ids.byteswap()
    return ids.tolist()


_BIG_ENDIAN = array("I", [1]).tobytes()[0] == 0


def shared_vocabulary(spark: SparkSession, path: str):
    """The content of a vocabulary file as a broadcast of checked size."""
    content = Path(path).read_text(encoding="utf-8")
    if len(content) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} has more than {MAX_VOCABULARY_BYTES} characters")
    return spark.sparkContext.broadcast(content)


def kept_beside(content, name: str, make: Callable[[], object]):
    """What ``make`` gives, kept on the broadcast, which a Python worker holds from task to task."""
    if not hasattr(content, name):
        setattr(content, name, make())
    return getattr(content, name)


def _codec(content) -> Codec:
    return kept_beside(content, "codec", lambda: Codec(Vocabulary(content.value)))


def encode(docs: DataFrame, path: str, text: str = "text", to: str = "packed_ids") -> DataFrame:
    """``docs`` with the ids of every whole text, packed as in :class:`Codec`, in ``to``.

    ``path`` is a tokenizers file.  No special tokens are added, those inside texts are
    recognised, nothing is truncated or padded.  A null text counts as empty and has no
    ids.  Each row is encoded by itself, so repeated rows stay, the order of rows plays no
    part, other columns pass through, and an empty table stays empty.
    """
    content = shared_vocabulary(docs.sparkSession, path)

    @F.pandas_udf("binary")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _codec(content)
        for batch in batches:
            yield pd.Series([codec.encode(t) for t in batch], dtype=object)

    return docs.withColumn(to, encoded(text_of(text)))


def decode(frame: DataFrame, path: str, packed: str = "packed_ids", to: str = "decoded") -> DataFrame:
    """``frame`` with the texts that packed ids stand for, special tokens kept.

    Pieces are joined by blanks, as the tokenizers library does for files that name no
    decoder.  Null ids give the empty text.
    """
    content = shared_vocabulary(frame.sparkSession, path)

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _codec(content)
        for batch in batches:
            yield pd.Series([codec.decode(p) for p in batch], dtype=object)

    return frame.withColumn(to, decoded(F.coalesce(F.col(packed), F.lit(b""))))


def coded(docs: DataFrame, path: str, carried: list[str], text: str = "text") -> DataFrame:
    """``carried`` columns of ``docs`` with ``packed_ids`` of every text and what they decode to.

    Encoding and decoding in one step.  Texts go to Python a hundred rows at a time, not in
    Arrow batches: those hold up to 10,000 whole texts, in several copies on either side.
    Nulls, repeated rows and empty tables as in :func:`encode`; other columns are not read.
    """
    content = shared_vocabulary(docs.sparkSession, path)

    @F.udf("packed_ids binary, decoded string", useArrow=False)
    def code(text: str) -> tuple[bytes, str]:
        codec = _codec(content)
        packed = codec.encode(text)
        return packed, codec.decode(packed)

    rows = docs.select(*carried, code(text_of(text)).alias("coded text"))
    return rows.select(*carried, "`coded text`.packed_ids", "`coded text`.decoded")


def round_trip(docs: DataFrame, path: str, carried: list[str], text: str = "text") -> DataFrame:
    """Encodes and decodes every text: counts and digests of the ids and of the decoded text."""
    return coded(docs, path, carried, text).select(
        *carried,
        F.expr("octet_length(packed_ids) div 4").alias("n_tokens"),
        "packed_ids",
        F.sha2("packed_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
