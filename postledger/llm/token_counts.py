"""Token counts by the whole-token shortcut.

Most words of a text are one token.  Which vocabulary strings are is proved once, on the
driver, before any text is read: a string is whole if merging its own bytes ends in one
part.  Words that match a whole string count one each; only the others are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postledger.llm.bpe import Memo, Vocabulary, kept_beside, shared_vocabulary
from postledger.llm.shared import text_of


def whole_tokens(vocabulary: Vocabulary) -> list[str]:
    """The vocabulary strings that, as words of a text, encode as exactly one token."""
    byte_of = {s: b for b, s in enumerate(vocabulary.symbols)}
    whole = []
    for piece in vocabulary.ids:
        if vocabulary.suffix:
            if not piece.endswith(vocabulary.suffix):
                continue
            piece = piece.removesuffix(vocabulary.suffix)
        if not piece or any(c not in byte_of for c in piece):
            continue
        try:
            word = bytes(byte_of[c] for c in piece).decode("utf-8")
        except UnicodeDecodeError:  # part of a character: never a word
            continue
        if len(vocabulary.encode_word(word)) == 1:
            whole.append(word)
    return whole


class Counter:
    """Counts the tokens of texts."""

    def __init__(self, vocabulary: Vocabulary, whole: list[str]):
        self.vocabulary = vocabulary
        self.n_tokens = Memo(lambda word: len(vocabulary.encode_word(word)), dict.fromkeys(whole, 1))

    def count(self, text: str) -> int:
        n = 0
        for is_special, segment in self.vocabulary.segments(text):
            n += 1 if is_special else sum(map(self.n_tokens.__getitem__, self.vocabulary.words_of(segment)))
        return n


def count_tokens(docs: DataFrame, path: str, text: str = "text", to: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens of every whole text in ``to``.

    ``path`` is a tokenizers file; counts are those of its library without added special
    tokens, truncation or padding.  A null or empty text has none.  Rows are counted one by
    one where they lie: repeated rows stay, other columns pass through, an empty table
    stays empty.  The proved strings are broadcast; they are fewer than the vocabulary.
    """
    content = shared_vocabulary(docs.sparkSession, path)
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(Vocabulary(content.value)))

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = kept_beside(content, "counter", lambda: Counter(Vocabulary(content.value), whole.value))
        for batch in batches:
            yield pd.Series([counter.count(t) for t in batch], dtype="int64")

    return docs.withColumn(to, counted(text_of(text)))
