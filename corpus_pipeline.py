"""The training-data pipeline: documents through five stages, each written and read again.

Counts as part of ``postledger.llm``.  Every stage is whole documents in, whole documents
out, in the columns of ``documents``; the last one gives token ids.
"""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parent)
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

import postledger  # noqa: E402
from postledger.llm import bpe, dart_minhash, mixing, quality, secret_scan  # noqa: E402
from postledger.llm.queries import table, tokenizer_file  # noqa: E402
from postledger.llm.shared import workspace, written  # noqa: E402

# Workers need not find the package on their path.  A cluster job ships it with --py-files.
cloudpickle.register_pickle_by_value(postledger)

# Small sources are repeated up to twice, and every document is used at least once.
MIX = mixing.Mix(entropy=0.95, max_repeats=2.0, every_document=True)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    judged = quality.judge(docs, table(spark, sf_dir, "labels"))
    return judged.filter("kept").select(*docs.columns)


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return dart_minhash.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by what they were."""
    ledger = secret_scan.BlobLedger(spark, workspace(spark, "ledger"))
    return secret_scan.redact(docs, ledger).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the weights of their sources ask."""
    return mixing.mix_documents(docs, MIX)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document, packed, with their digest and that of the decoded text."""
    return bpe.round_trip(docs, tokenizer_file("word_bpe_49k.json"), ["doc_id", "lang", "source"])


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_near),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("bpe", encode),
]

# Shingle signatures have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    folder, docs = workspace(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
