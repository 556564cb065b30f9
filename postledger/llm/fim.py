"""Fill-in-the-middle by displacement scatter.

A text is cut into lines (``[^\\n]*\\n|[^\\n]+``); two cut points, in lines, split it into
prefix, middle and suffix, and the output moves the parts behind sentinels:

    psm: <P>prefix<S>suffix<M>middle      spm: <S>suffix<P>prefix<M>middle

Where each part goes is no loop over texts.  Every text of a batch is one slice of a single
UTF-8 byte array; difference arrays hold, at each cut, the change of output shift, and
their cumulative sum is the shift of every byte.  One numpy scatter then writes all outputs
of the batch at once, and the inverse gather, with shifts found from the sentinels in the
output, rebuilds the texts.  Lines end at a ``\\n`` byte, so byte cuts are code point cuts.

Cuts and forms come from the document id alone: h1 to h4 are the first four 8-digit groups
of the hex SHA-256 of ``7:`` and the decimal id (a null id: of ``7:`` alone), read as
unsigned integers.  With n lines, the prefix ends after the smaller of h1 % (n + 1) and
h2 % (n + 1) lines, and the middle after the larger.  A text is left plain when it is empty (a null text is empty), when
it holds a sentinel, or when h3 % 100 >= ``rate``; else it is spm when h4 % 100 < ``spm``,
psm otherwise.  Plain rows have null cuts.  Repeated rows give repeated results; any extra
columns of the input pass through, and the columns made here replace input columns of the
same names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

# The sentinels, and the tag of the id hash.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = "7:"
WIDTH = 3

FORMS = ("plain", "psm", "spm")
MADE = ["fim_text", "form", "n_lines", "prefix_chars", "middle_chars"]


@dataclass(frozen=True)
class Fim:
    """``rate``: percent of texts transformed; ``spm``: percent of those in spm order.
    ``batch_bytes`` bounds the bytes of texts scattered at once."""

    rate: int = 100
    spm: int = 50
    batch_bytes: int = 4 << 20


def draws(doc_id) -> tuple[int, int, int, int]:
    """h1 to h4 of a document id."""
    seed = SEED + ("" if doc_id is None or pd.isna(doc_id) else str(int(doc_id)))
    digest = hashlib.sha256(seed.encode()).hexdigest()
    return tuple(int(digest[8 * k : 8 * k + 8], 16) for k in range(4))


def _line_ends(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per text, its number of lines; all newline offsets, the index of each text's first
    one and its number of them."""
    newlines = np.flatnonzero(buf == 10)
    first = np.searchsorted(newlines, starts)
    count = np.searchsorted(newlines, ends) - first
    # Behind the last byte a newline, which the empty text's end looks at.
    last = np.append(buf, np.uint8(10))[np.where(ends > starts, ends - 1, -1)]
    tail = (ends > starts) & (last != 10)
    return count + tail, newlines, first, count


def _end_of(k: np.ndarray, starts, ends, newlines, first, count_nl) -> np.ndarray:
    """Byte offset, in the batch, where line ``k`` of each text ends (0 lines: its start)."""
    inside = (k > 0) & (k <= count_nl)
    where = np.where(inside, first + k - 1, 0)
    at = newlines[where] + 1 if newlines.size else np.zeros_like(k)
    return np.where(k == 0, starts, np.where(inside, at, ends))


def _chars(buf: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Code points in each byte range: bytes that are no continuation byte."""
    lead = np.zeros(buf.size + 1, dtype=np.int32 if buf.size < (1 << 30) else np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=lead[1:])
    return (lead[hi] - lead[lo]).astype(np.int64)


def _scatter(texts: list[str], ids: list, config: Fim) -> dict[str, list]:
    raw = [t.encode("utf-8") for t in texts]
    lengths = np.fromiter((len(b) for b in raw), dtype=np.int64, count=len(raw))
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    ends = starts + lengths
    buf = np.frombuffer(b"".join(raw), dtype=np.uint8)
    n_lines, newlines, first, count_nl = _line_ends(buf, starts, ends)

    h = np.array([draws(i) for i in ids], dtype=np.int64).reshape(-1, 4)
    sentinel = np.array([any(s in t for s in (PREFIX, SUFFIX, MIDDLE)) for t in texts], dtype=bool)
    fim = (lengths > 0) & ~sentinel & (h[:, 2] % 100 < config.rate)
    spm = fim & (h[:, 3] % 100 < config.spm)
    first_cut, second_cut = h[:, 0] % (n_lines + 1), h[:, 1] % (n_lines + 1)
    a, b = np.minimum(first_cut, second_cut), np.maximum(first_cut, second_cut)
    c1 = _end_of(a, starts, ends, newlines, first, count_nl)
    c2 = _end_of(b, starts, ends, newlines, first, count_nl)

    # Where each text's output starts, and the shift of each of its parts within it.
    out_len = lengths + np.where(fim, 3 * WIDTH, 0)
    out_start = np.concatenate([[0], np.cumsum(out_len)[:-1]]).astype(np.int64)
    p_len, m_len, s_len = c1 - starts, c2 - c1, ends - c2
    zero = np.zeros_like(lengths)
    # psm: <P> prefix <S> suffix <M> middle;  spm: <S> suffix <P> prefix <M> middle.
    at_prefix = np.where(spm, 2 * WIDTH + s_len, np.where(fim, WIDTH, zero))
    at_suffix = np.where(spm, WIDTH, np.where(fim, 2 * WIDTH + p_len, p_len + m_len))
    at_middle = np.where(fim, 3 * WIDTH + p_len + s_len, p_len)
    base = out_start - starts
    shift_p, shift_m, shift_s = base + at_prefix, base + at_middle - p_len, base + at_suffix - p_len - m_len
    target = _positions(buf.size, ((starts, shift_p), (c1, shift_m - shift_p), (c2, shift_s - shift_m), (ends, -shift_s)))
    out = np.zeros(int(out_len.sum()), dtype=np.uint8)
    out[target] = buf
    for mark, where in ((PREFIX, at_prefix - WIDTH), (SUFFIX, at_suffix - WIDTH), (MIDDLE, at_middle - WIDTH)):
        rows = np.flatnonzero(fim)
        for k, byte in enumerate(mark.encode()):
            out[out_start[rows] + where[rows] + k] = byte
    data = out.tobytes()
    outputs = [data[s : s + n].decode("utf-8") for s, n in zip(out_start.tolist(), out_len.tolist())]
    prefix_chars = _chars(buf, starts, c1)
    middle_chars = _chars(buf, c1, c2)
    return {
        "fim_text": outputs,
        "form": [FORMS[0] if not f else FORMS[2] if s else FORMS[1] for f, s in zip(fim, spm)],
        "n_lines": n_lines.tolist(),
        "prefix_chars": [int(x) if f else None for x, f in zip(prefix_chars, fim)],
        "middle_chars": [int(x) if f else None for x, f in zip(middle_chars, fim)],
    }


def _restore(outputs: list[str], forms: list[str]) -> list[str]:
    """Texts rebuilt from outputs and forms alone: sentinels are found in the output, and one
    inverse gather over the batch puts every byte back."""
    raw = [o.encode("utf-8") for o in outputs]
    out_len = np.fromiter((len(b) for b in raw), dtype=np.int64, count=len(raw))
    out_start = np.concatenate([[0], np.cumsum(out_len)[:-1]]).astype(np.int64)
    buf = np.frombuffer(b"".join(raw), dtype=np.uint8)
    fim = np.array([f != FORMS[0] for f in forms], dtype=bool)
    spm = np.array([f == FORMS[2] for f in forms], dtype=bool)
    # Sentinels cannot arise across part boundaries, and plain texts are not searched.
    hit = np.zeros(buf.size, dtype=bool)
    if buf.size >= WIDTH:
        hit[: buf.size - 2] = (buf[:-2] == ord("<")) & (buf[2:] == ord(">"))
    found = {}
    for mark in (PREFIX, SUFFIX, MIDDLE):
        where = np.flatnonzero(hit & np.concatenate([buf[1:] == ord(mark[1]), [False]]))
        owner = np.searchsorted(out_start, where, side="right") - 1
        pos = np.full(len(raw), -1, dtype=np.int64)
        keep = fim[owner]
        pos[owner[keep]] = where[keep] - out_start[owner[keep]]
        found[mark] = pos
    lengths = out_len - np.where(fim, 3 * WIDTH, 0)
    # Part lengths and their places in the output, per form.
    at_p, at_s, at_m = found[PREFIX] + WIDTH, found[SUFFIX] + WIDTH, found[MIDDLE] + WIDTH
    p_len = np.where(spm, found[MIDDLE] - at_p, found[SUFFIX] - at_p)
    s_len = np.where(spm, found[PREFIX] - at_s, found[MIDDLE] - at_s)
    m_len = out_len - at_m
    p_len, s_len, m_len = (np.where(fim, x, 0) for x in (p_len, s_len, m_len))
    at_p, at_s, at_m = (np.where(fim, x, 0) for x in (at_p, at_s, at_m))
    m_len = np.where(fim, m_len, lengths)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    c1, c2, ends = starts + p_len, starts + p_len + m_len, starts + lengths
    base = out_start - starts
    take_p, take_m, take_s = base + at_p, base + at_m - p_len, base + at_s - p_len - m_len
    source = _positions(int(lengths.sum()), ((starts, take_p), (c1, take_m - take_p), (c2, take_s - take_m), (ends, -take_s)))
    text = buf[source].tobytes()
    return [text[s : s + n].decode("utf-8") for s, n in zip(starts.tolist(), lengths.tolist())]


def _positions(size: int, steps) -> np.ndarray:
    """Index plus shift of every byte, the shifts given as changes at offsets: a difference
    array and its running sum.  Offsets of a batch fit 32 bits (batches are a few MB)."""
    kind = np.int32 if size < (1 << 30) else np.int64
    diff = np.zeros(size + 1, dtype=kind)
    for at, change in steps:
        np.add.at(diff, at, change.astype(kind))
    shift = np.cumsum(diff[:-1], dtype=kind)
    shift += np.arange(size, dtype=kind)
    return shift


def _batches(frame: pd.DataFrame, limit: int, column: str = "__text") -> Iterator[pd.DataFrame]:
    """Row slices of at most ``limit`` characters of text (a longer text alone)."""
    sizes = frame[column].str.len().fillna(0).to_numpy()
    start, total = 0, 0
    for k, size in enumerate(sizes):
        if k > start and total + size > limit:
            yield frame.iloc[start:k]
            start, total = k, 0
        total += size
    if start < len(frame):
        yield frame.iloc[start:]


def transform(docs: DataFrame, config: Fim = Fim(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``fim_text`` (the output), ``form``, ``n_lines``, ``prefix_chars`` and
    ``middle_chars`` (code points; null when plain).  One pass, no shuffle."""
    rest = [c for c in docs.columns if c not in MADE]
    frame = docs.select(*rest, F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    made = StructType(
        [
            StructField("fim_text", StringType()),
            StructField("form", StringType()),
            StructField("n_lines", LongType()),
            StructField("prefix_chars", LongType()),
            StructField("middle_chars", LongType()),
        ]
    )
    schema = StructType([f for f in frame.schema.fields if f.name not in ("__id", "__text")] + made.fields)
    keep = [f.name for f in schema.fields if f.name not in MADE]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for piece in _batches(part.reset_index(drop=True), config.batch_bytes):
                ids = [None if pd.isna(i) else int(i) for i in piece["__id"]]
                made_cols = _scatter(piece["__text"].tolist(), ids, config)
                result = piece[keep].reset_index(drop=True)
                for name in MADE:
                    result[name] = pd.Series(made_cols[name], dtype="object" if name in ("fim_text", "form") else "Int64")
                yield result

    return frame.mapInPandas(run, schema)


def restore(
    frame: DataFrame, output_col: str = "fim_text", form_col: str = "form", as_col: str = "restored", config: Fim = Fim()
) -> DataFrame:
    """``frame`` with ``as_col``: the text rebuilt from the output and the form alone."""
    schema = StructType(frame.schema.fields + [StructField(as_col, StringType())])
    if as_col in frame.columns:
        frame = frame.drop(as_col)
        schema = StructType(frame.schema.fields + [StructField(as_col, StringType())])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for piece in _batches(part.reset_index(drop=True), config.batch_bytes, output_col):
                piece = piece.reset_index(drop=True)
                outputs = piece[output_col].fillna("").tolist()
                forms = piece[form_col].fillna(FORMS[0]).tolist()
                piece[as_col] = _restore(outputs, forms) if len(piece) else []
                yield piece

    return frame.mapInPandas(run, schema)


# The same result in DuckDB SQL: lines by the same pattern, cuts by the same hashes.
FIM_SQL = r"""WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
    FROM documents
), l AS (
    SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS lines,
           CAST(('0x' || substr(h, 1, 8)) AS UBIGINT) AS h1, CAST(('0x' || substr(h, 9, 8)) AS UBIGINT) AS h2,
           CAST(('0x' || substr(h, 17, 8)) AS UBIGINT) AS h3, CAST(('0x' || substr(h, 25, 8)) AS UBIGINT) AS h4
    FROM d
), c AS (
    SELECT *, len(lines) AS n,
           least(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS a,
           greatest(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS b,
           CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
                WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
    FROM l
), p AS (
    SELECT doc_id, t, n, form,
           array_to_string(lines[1:a], '') AS pre,
           array_to_string(lines[a + 1:b], '') AS mid,
           array_to_string(lines[b + 1:n], '') AS suf
    FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form = 'plain' THEN NULL ELSE CAST(length(pre) AS BIGINT) END AS prefix_chars,
       CASE WHEN form = 'plain' THEN NULL ELSE CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
