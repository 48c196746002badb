"""The latent axes are fitted on all passages, not on the sample that they start from."""

import random

import numpy as np

from tidemark.llm import decontaminate as dc


def texts():
    rng = random.Random(5)
    topics = [[f"w{t}x{i}" for i in range(12)] for t in range(70)]
    return ["", None, *[" ".join(rng.choice(topics[n % 70]) for _ in range(rng.choice([1, 39, 40, 41, 130]))) for n in range(420)]]


def matrix(rows, idf):
    """All passages of the texts as unit TF-IDF rows, plainly."""
    out = []
    for text in filter(None, rows):
        b = dc._bucket(dc.words_of(*dc.text_buffer(dc.pa.array([text])))[0])
        for low in range(0, len(b), dc.PASSAGE):
            row = np.zeros(dc.BUCKETS)
            at, w = dc._weighted(b[low : low + dc.PASSAGE], idf)
            row[at] = w
            out.append(row)
    return np.array(out)


def test_product_and_axes_are_those_of_all_passages(spark, monkeypatch):
    rows = texts()
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    idf = np.random.default_rng(1).uniform(0.1, 5, dc.BUCKETS)
    a = matrix(rows, idf)
    m = np.random.default_rng(2).standard_normal((dc.BUCKETS, 7))
    got = dc._times_gram(dc._scan(docs, "text", 0.0), idf, m)
    assert np.abs(got - a.T @ (a @ m)).max() < 1e-3

    monkeypatch.setattr(dc, "SAMPLE", 40)
    kept = []
    whole = dc.whole_svd

    def noted(scanned, own, idf, axes, share):
        out = whole(scanned, own, idf, axes, share)
        kept.append((idf, axes, *out, share))
        return out

    monkeypatch.setattr(dc, "whole_svd", noted)
    assert dc.fit_finder(docs, spark.createDataFrame([(1, rows[5] or "w1x1 w1x2 w1x3")], "item_id long, text string")) is not None
    idf, start, axes, values, share = kept[0]
    a = matrix(rows, idf)
    energy = lambda v: float(((a @ np.linalg.qr(v)[0]) ** 2).sum())
    best = float((np.linalg.svd(a @ a.T, compute_uv=False)[: axes.shape[1]]).sum())
    assert np.abs(axes.T @ axes - np.eye(axes.shape[1])).max() < 1e-6 and share == 40 / len(a)
    assert energy(start) < energy(axes) <= best * (1 + 1e-9)
    assert np.all(np.diff(values) <= 1e-9)
