"""Hard negatives (op11), exact dedup (op12) and fill-in-middle (op13) against plain Python."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from postledger.llm import exact_dedup, fim, hard_negatives

# ---------------------------------------------------------------- fill-in-middle


def fim_by_hand(doc_id, text):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    h = fim.draws(doc_id)
    a, b = sorted([h[0] % (n + 1), h[1] % (n + 1)])
    pre, mid, suf = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 100:
        return n, "plain", None, None, text
    if h[3] % 100 < 50:
        return n, "spm", len(pre), len(mid), "<S>" + suf + "<P>" + pre + "<M>" + mid
    return n, "psm", len(pre), len(mid), "<P>" + pre + "<S>" + suf + "<M>" + mid


def test_fim_scatter_equals_plain_python():
    rng = random.Random(7)
    alphabet = ["a", "é", "😀", "\n", "\n", "<", "P", ">", "S", "M", " ", "中", "\r"]
    texts = ["", "x", "\n", "\n\n", "a\nb", "a\nb\n", "<P>", "ab<", "a<S\n>", "x<M>y"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(2000)]
    ids = list(range(len(texts)))
    ids[3] = None
    got = fim._scatter(texts, ids, fim.Fim())
    for k, (i, t) in enumerate(zip(ids, texts)):
        made = (got["n_lines"][k], got["form"][k], got["prefix_chars"][k], got["middle_chars"][k], got["fim_text"][k])
        assert made == fim_by_hand(i, t), (i, t)
    assert fim._restore(got["fim_text"], got["form"]) == texts
    assert {"plain", "psm", "spm"} <= set(got["form"])


def test_fim_on_spark_nulls_long_repeated_and_clashing_columns(spark):
    long = "word " * 50_000 + "\n" + "line\n" * 20_000
    rows = [(1, None, "x"), (2, "", "x"), (3, long, "y"), (3, long, "y"), (None, "a\nb\nc", "z"), (5, "<P>kept", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string").withColumn("fim_text", F.lit(1))
    out = fim.restore(fim.transform(docs)).orderBy("doc_id").collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.restored == (r.text or "")
        n, form, pc, mc, text = fim_by_hand(r.doc_id, r.text)
        assert (r.n_lines, r.form, r.prefix_chars, r.middle_chars, r.fim_text) == (n, form, pc, mc, text)
    assert out[0].doc_id is None and out[-1].form == "plain"
    assert fim.transform(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- exact dedup


def dedup_by_hand(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(text or "", []).append(doc_id)
    out = []
    for doc_id, text in rows:
        members = groups[text or ""]
        ids = [m for m in members if m is not None]
        keep = max(ids) if ids else None
        sha = hashlib.sha256((text or "").encode()).hexdigest()
        out.append((doc_id, keep, len(members), doc_id == keep, sha))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot_groups", [1, 2, 10_000])
def test_exact_dedup_against_plain_python(spark, hot_groups):
    rng = random.Random(3)
    texts = ["a", "b", "", None, "a b", "x" * 100_000, "é😀"]
    rows = [(i, rng.choice(texts)) for i in range(400)]
    rows += [(400, None), (400, None), (None, "only null ids"), (None, "only null ids"), (None, "a"), (7, rows[7][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    docs = docs.withColumn("kept", F.lit("clash")).withColumn("__digest", F.lit(0))
    got = exact_dedup.mark(docs, exact_dedup.Dedup(fan_in=2, hot_groups=hot_groups))
    assert "text" not in got.columns and "__digest" not in got.columns
    found = sorted(
        ((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got.collect()), key=repr
    )
    expected = dedup_by_hand(rows)
    # An all-null group's rows count as kept.
    expected = sorted(((d, k, n, True if d is None and k is None else kept, s) for d, k, n, kept, s in expected), key=repr)
    assert found == expected


def test_exact_dedup_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.mark(docs).count() == 0


# ---------------------------------------------------------------- hard negatives


def mining_by_hand(rows, positives=5, negatives=3):
    valid = {}
    for vec_id, vec, label in rows:
        if label is None or vec is None or any(x is None or not np.isfinite(x) for x in vec):
            continue
        lab = (label + 1) % 10 if vec_id % 7 == 0 else label
        valid.setdefault(vec_id, []).append((lab, [int(np.floor(256 * float(x))) for x in vec]))
    flat = [(i, lab, q) for i, versions in valid.items() for lab, q in versions]
    out = []
    anchors = {(i, lab, tuple(q)) for i, lab, q in flat if i % 50 == 0}
    for a, alab, aq in anchors:
        scored = sorted(((-int(np.dot(aq, q)), i, lab) for i, lab, q in flat if i != a), key=lambda t: (t[0], t[1]))
        pos = [(i, -s) for s, i, lab in scored if lab == alab][:positives]
        for p, ps in pos:
            window = [(i, -s) for s, i, lab in scored if lab != alab and 50 * ps <= -100 * s <= 95 * ps]
            for rank, (n, ns) in enumerate(window[:negatives], 1):
                out.append((a, p, rank, n, ps, ns))
    return sorted(out)


@pytest.mark.parametrize("config", [hard_negatives.Mining(), hard_negatives.Mining(centroids=4, cell_rows=8, block=3, anchors=2, first_entries=5)])
def test_hard_negatives_against_plain_python(spark, config):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(6, 8))
    rows = []
    for i in range(600):
        vec = base[i % 6] + 0.3 * rng.normal(size=8)
        vec = vec / np.linalg.norm(vec)
        rows.append((i, [float(x) for x in vec], int(rng.integers(0, 4))))
    # Ties, repeated rows, and rows that take no part.
    rows += [(600, rows[0][1], 1), (650, rows[0][1], 2), (650, rows[0][1], 2), (700, None, 1), (750, rows[3][1], None)]
    rows += [(800, [1.0, None] + [0.0] * 6, 1), (850, [float("nan")] + [0.1] * 7, 2), (900, [0.5] * 8, 3)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rank", F.lit(1))
    relabel = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("int")
    got = hard_negatives.mine(frame, F.col("vec_id") % 50 == 0, relabel, config)
    found = sorted(tuple(r) for r in got.collect())
    as_float = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
    assert found == mining_by_hand(as_float)
    assert found


def test_hard_negatives_without_rows(spark):
    frame = spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.mine(frame, F.col("vec_id") % 50 == 0).count() == 0
