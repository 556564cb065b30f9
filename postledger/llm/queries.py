"""The registered queries of the operators, each over its whole table, and the SQL they must equal."""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postledger.llm import (
    bpe,
    chat,
    dart_minhash,
    exact_dedup,
    fim,
    hard_negatives,
    language,
    mixing,
    multi_index,
    quality,
    secret_scan,
    token_counts,
    warc,
)
from postledger.llm.shared import text_of, workspace


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    return str(Path(public_tokenizers.path(name)))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, tokenizer_file("byte_bpe_50k.json"))
    return counted.select(
        "doc_id",
        F.octet_length(text_of()).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > 512).alias("over_limit"),
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.round_trip(pages, warc.Archive(workspace(spark, "warc"))).drop("url")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = secret_scan.BlobLedger(spark, workspace(spark, "ledger"))
    found = secret_scan.scan(table(spark, sf_dir, "documents"), ledger)
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"].isin([rule.kind for rule in secret_scan.BASE_RULES]))
    return found.select(
        "doc_id",
        *[secret_scan.count_of(spans, rule.kind).alias(f"n_{rule.kind}") for rule in secret_scan.BASE_RULES],
        F.sha2(secret_scan.shown(base), 256).alias("base_sha256"),
        secret_scan.shown(spans).alias("spans"),
    )


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.round_trip(docs, tokenizer_file("word_bpe_49k.json"), ["doc_id"]).drop("packed_ids")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality.judge(docs, table(spark, sf_dir, "labels"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *counts, "base_failed", "kept", "log_ratio")


def op6_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return multi_index.nearest(vectors, F.col("vec_id") % 20 == 0)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = [(-1, 0, "user", chat.PROBE), (-1, 1, "assistant", chat.PROBE)]
    turns = turns.unionByName(spark.createDataFrame(probe, turns.schema))
    return chat.digest(chat.format_chats(turns))


def op9_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_minhash.near_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages by text, markup, suffix and host, and all documents by text and source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    pages = language.page_rows(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    none = F.lit(None).cast("string")
    plain = docs.select(
        "doc_id", "text", none.alias("declared"), F.col("source").alias("host"), none.alias("domain"), none.alias("suffix")
    )
    rows = plain.unionByName(pages, allowMissingColumns=True)
    return language.identify(rows, docs.select("text", "lang"), ["doc_id", "page_id"])


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    relabel = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("int")
    return hard_negatives.mine(rows, F.col("vec_id") % 50 == 0, relabel)


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.mark(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = fim.restore(fim.transform(docs))
    return made.select(
        "doc_id",
        F.col("n_lines").alias("n"),
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("fim_text", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"),
    )


QUERIES = {
    "op1_token_counts": (op1_token_counts, None),
    "op2_warc": (op2_warc, warc.round_trip_sql()),
    "op3_secret_scan": (op3_secret_scan, secret_scan.report_sql()),
    "op4_bpe": (op4_bpe, None),
    "op5_quality": (op5_quality, None),
    "op6_multi_index": (op6_multi_index, None),
    "op7_mixing": (op7_mixing, mixing.mixed_sql()),
    "op8_chat": (op8_chat, chat.digest_sql()),
    "op9_dart_minhash": (op9_dart_minhash, None),
    "op10_language": (op10_language, None),
    "op11_hard_negatives": (op11_hard_negatives, hard_negatives.mining_sql()),
    "op12_exact_dedup": (op12_exact_dedup, exact_dedup.dedup_sql()),
    "op13_fim": (op13_fim, fim.FIM_SQL),
}
