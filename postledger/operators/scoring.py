"""Prompts, the batch scorer, reading its answers, and storing scores."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postledger import schemas
from postledger.functions.answers import with_answer_columns
from postledger.functions.prompts import prompt
from postledger.operators.matching import MODEL_STAGE

ScoreBatch = Callable[[list[str]], list[str]]

ANSWER_KEYS = ["unique_key", "search_name", "profile_hash", "requirements_hash"]


def offline_scorer(prompts: list[str]) -> list[str]:
    """Stands in for a model where there is none: scores drawn from the prompt's digest."""
    answers = []
    for text in prompts:
        digest = hashlib.md5(text.encode("utf-8")).hexdigest()
        fit, desirability = int(digest[:8], 16) % 101, int(digest[8:16], 16) % 101
        answers.append(json.dumps({"fit_score": fit, "desirability_score": desirability, "hard_fail": False}))
    return answers


def render_prompts(pairs: DataFrame, searches: DataFrame) -> DataFrame:
    """Pairs with their text and ``prompt``."""
    texts = searches.select(F.col("name").alias("search_name"), "profile", "hard_text", "soft_text")
    columns = ("profile", "hard_text", "soft_text", "title", "company", "location", "department")
    return pairs.join(texts, "search_name").select(
        *ANSWER_KEYS, prompt(*[F.col(name) for name in (*columns, "description")]).alias("prompt")
    )


def ask(prompts: DataFrame, score_batch: ScoreBatch = offline_scorer, tasks: int | None = None) -> DataFrame:
    """One answer, or the error of the model, per prompt.

    The callable sees one Arrow batch of prompts at a time; ``tasks`` says how many run at
    most, which otherwise follows from the size of the prompts.
    """

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            told = _replies(batch.column("prompt").to_pylist(), score_batch)
            keys = [batch.column(name) for name in ANSWER_KEYS]
            replies, errors = (pa.array([row[k] for row in told], pa.string()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([*keys, replies, errors], [*ANSWER_KEYS, "answer", "error"])

    rows = prompts.select(*ANSWER_KEYS, "prompt")
    if tasks:
        rows = rows.repartition(tasks)
    return rows.mapInArrow(answer, schemas.ANSWERS)


def _replies(prompts: list[str], score_batch: ScoreBatch) -> list[tuple[str | None, str | None]]:
    """(answer, error) per prompt.  A batch that fails is asked again in halves, so that one
    refused prompt costs no other one its answer."""
    try:
        replies = score_batch(prompts)
    except Exception as error:  # whatever a model client raises
        if len(prompts) == 1:
            return [(None, repr(error)[:1000])]
        half = len(prompts) // 2
        return _replies(prompts[:half], score_batch) + _replies(prompts[half:], score_batch)
    if len(replies) != len(prompts):
        raise ValueError(f"{len(prompts)} prompts but {len(replies)} answers")
    return [(reply, None) for reply in replies]


def read_answers(answers: DataFrame) -> DataFrame:
    """Score rows of answers.  An answer that does not parse scores zero."""
    rows = with_answer_columns(answers.select(*ANSWER_KEYS, "answer"))
    return rows.withColumn("stage_reached", F.lit(MODEL_STAGE))


def upsert_scores(scores: DataFrame, fresh: DataFrame) -> DataFrame:
    """Replace whole rows per (unique_key, search_name).  ``fresh`` holds one row per pair.

    Both may hold any columns of a score, so that only narrow ones need to be rewritten.
    """
    kept = scores.join(fresh.select("unique_key", "search_name"), ["unique_key", "search_name"], "left_anti")
    return kept.unionByName(fresh)
