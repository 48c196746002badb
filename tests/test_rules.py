"""Published examples and edge cases of single rules."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import names as nm
from tidemark.functions import text as tx
from tidemark.operators import events as ev
from tidemark.operators import labels as lb
from tidemark.operators import metrics as mt
from tidemark.operators import segments as sg
from tidemark.sources import readers as rd
from tidemark.streaming import streams as st


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "v string").select(make(F.col("v")).alias("o")).first()["o"]


def merged(spark, pairs, **kw):
    rows = spark.createDataFrame([(1, i, float(t), float(s)) for i, (t, s) in enumerate(pairs)], "k int, cand_no long, t double, score double")
    out = ev.with_clock(ev.merge_candidates(rows, ["k"], "cand_no", **kw)).orderBy("rank").collect()
    return [(r["t"], r["score"], r["merged"], r["mmss"]) for r in out]


def test_merging(spark):
    assert merged(spark, [(610, 0.51), (632, 0.94)]) == [(621.0, 0.94, 2, "10:21")]
    assert merged(spark, [(610, 0.9), (630, 0.8), (650, 0.7)], pool=3)[0][:3:2] == (630.0, 3)
    assert len(merged(spark, [(600, 0.9), (700, 0.8)])) == 2
    assert merged(spark, [(100, 0.4)]) == [(100.0, 0.4, 1, "01:40")]


def test_clock_formats(spark):
    f = lambda t, fn: spark.range(1).select(fn(F.lit(t)).alias("o")).first()["o"]
    assert f(59.996, nm.format_ts) == "[01:00.00]"
    assert f(-3.0, nm.format_ts) == "[00:00.00]"
    assert f(3661.5, nm.format_srt_ts) == "01:01:01,500"
    assert f(75.4, nm.format_sec) == "1分15秒"
    assert f(1536.0, nm.human_size) == "1.5 KB"


@pytest.mark.parametrize(
    "raw,want",
    [("０１『x", "01『x』"), ("con", "_con"), ("a. ", "a"), ("y" * 130, "y" * 120), ("", "unnamed"), ('"1. b"', "b")],
)
def test_safe_names(spark, raw, want):
    assert one(spark, raw, nm.safe_name) == want


def test_names_never_collide(spark):
    rows = spark.createDataFrame(list(enumerate(["a", "a", "a (2)", "b", "a", "a (2)"])), "n long, name string")
    out = [r["unique_name"] for r in sg.dedupe_names(rows, "n", "name").orderBy("n").collect()]
    assert out == ["a", "a (2)", "a (2) (2)", "b", "a (3)", "a (2) (3)"]


def test_aligned_array(spark):
    parse = lambda text, n: one(spark, text, lambda c: tx.parse_aligned_array(c, F.lit(n)))
    assert parse('x [{"zh":"a"},{"text":"b"}] y', 2) == ["a", "b"]
    assert parse('["a","b"]', 3) is None
    assert parse("none", 1) is None


def test_split_keeps_words_whole(spark):
    text = "あああ。いいい、ううう。" + "x" * 25
    assert one(spark, text, lambda c: sg.split_text(c, 10)) == ["あああ。", "いいい、ううう。", "x" * 10, "x" * 10, "x" * 5]


def test_rule_lines(spark):
    lines = ["a=>b", "a->b->c", "x→y # note", "# c=>d", "=>z", "plain"]
    rows = spark.createDataFrame(list(enumerate(lines)), "ord long, line string")
    assert [(r["a"], r["b"]) for r in rd.parse_rules(rows, "ord").orderBy("ord").collect()] == [("a", "b"), ("a", "b->c"), ("x", "y")]


def test_truth_blocks_keep_zero_tracks(spark):
    lines = ["・00:10", "【トラック1】0回", "【トラック2】1回", "・01:05", "other"]
    rows = spark.createDataFrame([(7, i, x) for i, x in enumerate(lines)], "w int, n long, line string")
    tracks, marks = rd.parse_truth_blocks(rows, ["w"], "n")
    assert sorted(r["track"] for r in tracks.collect()) == [1, 2]
    assert [(r["track"], r["t"]) for r in marks.collect()] == [(2, 65)]


def test_deleted_marks_stay_deleted(spark):
    rows = spark.createDataFrame([("x", 1.0, "add", 1), ("x", 1.0, "del", 2), ("x", 1.0, "add", 3), ("x", 2.0, "add", 4)], "audio string, time double, action string, line_no long")
    assert [r["time"] for r in lb.live_marks(rows).collect()] == [2.0]


@pytest.mark.parametrize("fault", ["drop", "merge", "blank", "raise"])
def test_batches_are_halved_until_aligned(spark, fault):
    rows = spark.createDataFrame([(1, i, f"t{i}", 0) for i in range(7)], "k int, seq int, text string, batch_no long").withColumnRenamed("seq", "seg_no")

    def fn(lines):
        if len(lines) > 2:
            if fault == "raise":
                raise RuntimeError("remote")
            return {"drop": lines[1:], "merge": [" ".join(lines)], "blank": [" "] * len(lines)}[fault]
        return ["<" + x + ">" for x in lines]

    out = sg.batched_apply(rows, ["k"], fn).orderBy("seg_no").collect()
    assert [r["translation"] for r in out] == [f"<t{i}>" for i in range(7)]


def test_hopeless_text_is_left_blank(spark):
    rows = spark.createDataFrame([(1, 0, "a", 0), (1, 1, "b", 0)], "k int, seg_no int, text string, batch_no long")
    out = sg.batched_apply(rows, ["k"], lambda lines: None).collect()
    assert [r["translation"] for r in out] == ["", ""]


def test_undefined_metrics_are_null(spark):
    folds = spark.createDataFrame([("a", 0, 0, 2, 0), ("b", 2, 1, 1, 1)], "w string, outputs long, hits long, truths long, covered long")
    row = mt.precision_recall(folds).first()
    assert row["macro_precision"] == 0.5 and row["macro_recall"] == 0.5
    single = spark.createDataFrame([(1, 0.3, True)], "k int, s double, hit boolean")
    assert mt.auc(single, ["k"], "s", "hit").first()["auc"] is None
    tied = spark.createDataFrame([(1, 0.5, True), (1, 0.5, False)], "k int, s double, hit boolean")
    assert mt.auc(tied, ["k"], "s", "hit").first()["auc"] == 0.5


def test_zero_truth_tracks_count_and_unlabelled_do_not(spark):
    from tidemark.operators.joins import match_events

    events = spark.createDataFrame([(1, 10.0), (2, 10.0), (3, 10.0)], "k int, t double")
    truth = spark.createDataFrame([(1, 12.0)], "k int, t double")
    labelled = spark.createDataFrame([(1,), (2,)], "k int")
    hits, covered = match_events(events, truth, labelled, ["k"])
    assert sorted((r["k"], r["hit"]) for r in hits.collect()) == [(1, True), (2, False)]
    assert covered.count() == 1


def test_stream_over_several_files_equals_batch(spark, tmp_path):
    import random

    rnd = random.Random(3)
    rows = [(rnd.randint(0, 3), float(rnd.randint(0, 9)), rnd.choice(["add", "del", "add"]), i) for i in range(90)]
    schema = "audio long, time double, action string, line_no long"
    for part in range(3):
        spark.createDataFrame(rows[part * 30 : part * 30 + 30], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    log = st.file_stream(spark, str(tmp_path / "log"), "*.parquet", spark.read.parquet(str(tmp_path / "log")).schema)
    emitted = st.run_available(st.live_marks_state(log))
    assert emitted.select("_batch").distinct().count() == 3
    got = {(r["audio"], r["time"]) for r in st.latest_by_key(emitted, ["audio", "time"]).filter("live").collect()}
    want = {(r["audio"], r["time"]) for r in lb.live_marks(spark.createDataFrame(rows, schema)).collect()}
    assert got == want


def test_timed_text_format(spark, tmp_path):
    (tmp_path / "a.lrc").write_text("﻿[00:01.50]x\n[ti:t]\n[01:02:25]y\n[00:03]\n", encoding="utf-8")
    same = rd.read_timed_lines(spark, str(tmp_path)).orderBy("t").collect()
    assert [(r["t"], r["text"]) for r in same] == [(1.5, "x"), (62.25, "y")]
    assert rd.read_timed_lines(spark, str(tmp_path), "keep").count() == 2


def test_model_contract(spark, tmp_path):
    from tidemark.operators import models as md

    rows = spark.createDataFrame([(float(i % 7), float(i % 3), float(i % 2)) for i in range(60)], "a double, b double, label double")
    model = md.fit_classifiers(rows, ["a", "b"], {"lr": md.classifiers()["lr"]})["lr"]
    md.save_model(model, str(tmp_path), ["a", "b"], {"n": 60}, spark)
    assert md.load_model(str(tmp_path), ["a", "b"], spark)[1]["n"] == 60
    with pytest.raises(ValueError):
        md.load_model(str(tmp_path), ["b", "a"], spark)
