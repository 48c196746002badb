"""Language profiles: accuracy on held-out documents, and the counting against a plain one."""

import zlib
from collections import Counter

import numpy as np

from tests.llm.conftest import BASE
from tidemark.llm.catalog import CASES
from tidemark.llm.language import gram_counts, identify, learn_profiles


def plain_grams(text):
    marks = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text or "")
    marks = " " + " ".join(marks.split()) + " " if marks.strip() else ""
    out = Counter()
    for n in (1, 2, 3):
        for i in range(len(marks) - n + 1):
            gram = marks[i : i + n]
            if gram.strip() and not (n == 3 and gram[1] == " "):
                out[gram] += 1
    return out


def read_gram(code):
    return "".join(chr(c) for c in (code >> 32 & 0xFFFF, code >> 16 & 0xFFFF, code & 0xFFFF) if c)


def test_counts_equal_plain_ones():
    texts = ["Ab a-ab  Ça.", None, "", "12 34", "ß Ünïcode日本 x", " x ", "aaa"]
    row, gram, n = gram_counts(texts)
    for i, t in enumerate(texts):
        got = {read_gram(int(g)): int(c) for r, g, c in zip(row, gram, n) if r == i}
        assert got == plain_grams(t), t


def test_query_learns_and_predicts(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{BASE}/documents.parquet").collect()}
    got = CASES["op5_language_id"].run(spark, BASE).collect()
    assert len(got) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    judged = [r.lang_pred == lang[r.doc_id] for r in got if r.held_out and lang[r.doc_id]]
    assert np.mean(judged) > 0.97


def test_profiles_rank_by_count_then_gram(spark):
    df = spark.createDataFrame([("aab", "x"), ("ab", "x"), (None, "x"), ("zz", None), ("q", "y")], "text string, lang string")
    got = {(r.lang, read_gram(r.gram)): r["rank"] for r in learn_profiles(df).collect()}
    want = plain_grams("aab") + plain_grams("ab")
    order = sorted(want, key=lambda g: (-want[g], [ord(c) for c in g.ljust(3, "\0")]))
    assert {g: k for k, g in enumerate(order)} == {g: k for (lang, g), k in got.items() if lang == "x"}


def test_odd_texts_and_no_profiles(documents, spark):
    df = documents([(1, None), (2, ""), (3, "123 ..."), (4, "la maison de la rue " * 4000), (5, "der die das und"), (5, "der die das und")])
    learned = spark.createDataFrame([("la maison de la rue et le jardin", "fr"), ("der die das und nicht", "de")], "text string, lang string")
    got = [(r.doc_id, r.lang_pred) for r in identify(df, learn_profiles(learned)).collect()]
    assert sorted(got) == [(1, "und"), (2, "und"), (3, "und"), (4, "fr"), (5, "de"), (5, "de")]
    none = learn_profiles(learned.filter("lang is null"))
    assert {r.lang_pred for r in identify(df, none).collect()} == {"und"}
    assert identify(documents({}), learn_profiles(learned)).collect() == []
