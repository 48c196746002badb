"""Quality selection: counts against plain ones, the top-k against sorting, and accuracy on labelled documents."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import BASE
from tidemark.llm.catalog import CASES
from tidemark.llm.common import text_buffer
from tidemark.llm.quality import BUCKETS, best_cut, fit_selection, gram_counts, judge, keep_good, kth_largest, log_ratios, row_grams

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=600):
    rng = random.Random(0)
    words = [f"w{i}" for i in range(200)]
    texts, labels = {}, []
    for i in range(n):
        t = [rng.choice(words) for _ in range(rng.randrange(20, 60))]
        kind = "junk" if i % 5 == 1 else "toxic" if i % 10 == 2 else "good"
        if kind == "junk":
            t = [w + " %%%" for w in t]
        if kind == "toxic":
            t[5] = "vile"
        texts[i] = " ".join(t)
        if i % 3 == 0:
            labels.append((i, int(kind != "junk"), int(kind == "toxic")))
    return texts, labels


def test_grams_are_distinct_words_and_pairs():
    texts = ["A b a B!! b", None, "", "x", "é%%é"]
    row, first, second = row_grams(*text_buffer(pa.array(texts)))
    tokens = [re.findall(r"[a-z0-9_\x80-\U0010ffff]+|[^\sa-z0-9_\x80-\U0010ffff]+", (t or "").lower()) for t in texts]
    want = [len(set(t)) + len(set(zip(t, t[1:]))) for t in tokens]
    assert np.bincount(row, minlength=5).tolist() == want
    assert (first < 2 * BUCKETS).all() and (second >= 2 * BUCKETS).all() and (second < 4 * BUCKETS).all()


def test_counts_cover_every_document(documents, spark):
    texts, _ = corpus(90)
    df = documents(texts).repartition(5).withColumn("good", F.col("doc_id") % 2 == 0).select("text", "good")
    counts = gram_counts(df)
    _, first, second = row_grams(*text_buffer(pa.array(list(texts.values()))))
    both = np.bincount(np.concatenate([first, second]), minlength=4 * BUCKETS)
    assert (counts["raw"][:-1] == both).all() and counts["raw"][-1] == 90 and counts["target"][-1] == 45


def test_good_documents_stay_and_others_go(documents, spark):
    texts, labels = corpus()
    df = documents(texts)
    out = keep_good(df, spark.createDataFrame(labels, LABELS))
    assert out.columns == df.columns
    kept = {r.doc_id for r in out.collect()}
    assert all((i in kept) == ("%%%" not in t and "vile" not in t) for i, t in texts.items())


def test_labelled_documents_of_the_tables(spark):
    rows = CASES["op8_quality"].run(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    good = [r.kept for r in rows if r.quality == 1 and r.toxic == 0]
    bad = [r.kept for r in rows if r.quality == 0 or r.toxic == 1]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.4


def test_odd_rows_and_labels(documents, spark):
    df = documents([(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "c"), (4, "long " * 30_000)])
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (None, 1, 0), (4, None, 1)], LABELS)
    got = judge(df, labels).collect()
    assert len(got) == 6 and all(r.kept and r.log_weight == 0 for r in got)
    none = spark.createDataFrame([], LABELS)
    assert keep_good(documents({}), none).collect() == [] and keep_good(df, none).count() == 6


def test_noise_depends_on_the_key_alone(documents, spark):
    texts, labels = corpus(200)
    known = spark.createDataFrame(labels, LABELS)
    a = {r.doc_id: (r.score, r.kept) for r in judge(documents(texts), known).collect()}
    b = {r.doc_id: (r.score, r.kept) for r in judge(documents(texts).repartition(7), known).collect()}
    assert a == b and len({s for s, _ in a.values()}) == 200
    chosen = fit_selection(documents(texts), known)
    assert sum(k for _, k in a.values()) == sum(s >= chosen.cut[0] for s, _ in a.values())


@pytest.mark.parametrize("few", [3, 5000])
def test_kth_largest(spark, few):
    rng = random.Random(1)
    rows = [(rng.choice([rng.gauss(0, 1), 0.5, -1e6, 7.0]), i) for i in range(400)]
    df = spark.createDataFrame(rows, "score double, id long")
    order = sorted(rows, key=lambda r: (-r[0], r[1]))
    for k in (1, 17, 200, 400):
        score, last = kth_largest(df, k, few)
        assert score == order[k - 1][0] and (last is None or last == order[k - 1][1])


def test_cut_between_scores():
    assert best_cut([0, 0, -3, -5], [True, True, False, False]) == -1.5
    assert best_cut([1, 2], [True, True]) == -math.inf and best_cut([], []) == -math.inf
    assert best_cut([0.0, 0.0], [True, False]) == -math.inf


def test_chance_differences_weigh_nothing():
    raw = np.zeros(4 * BUCKETS + 1, dtype=np.int64)
    raw[:1000], raw[-1] = 40, 1000
    target = np.zeros_like(raw)
    target[:1000], target[-1] = 12, 300
    target[7] = 0
    assert np.flatnonzero(log_ratios({"raw": raw, "target": target}).ratio).tolist() == [7]
