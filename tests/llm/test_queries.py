"""The registered queries against their SQL, and the pipeline as a whole."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from oracle import compare, connect  # noqa: E402

import corpus_pipeline  # noqa: E402
from postledger.llm.queries import QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in QUERIES.items() if sql))
def test_against_sql(spark, name):
    query, sql = QUERIES[name]
    assert compare(connect(SF), query(spark, SF), sql) == ""


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in QUERIES.items() if not sql))
def test_runs(spark, name):
    query, _ = QUERIES[name]
    assert query(spark, SF).count() > 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    result = corpus_pipeline.run(spark, SF)
    rows = result.collect()
    assert rows and {r.doc_id for r in rows} <= {r.doc_id for r in docs.select("doc_id").collect()}
    assert all(len(r.packed_ids) == 4 * r.n_tokens for r in rows)
