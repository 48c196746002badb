"""Mixing against SQL, a plain rule for targets, and nearness to them."""

import random
from collections import Counter

import pytest

from tests.check import compare, duck
from tests.llm.conftest import BASE
from tidemark.llm.catalog import CASES
from tidemark.llm.mixing import copies, mix


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    """Targets by giving out the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, stopped = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in stopped)
        open_ = [s for s in names if s not in stopped]
        found = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = {s for s in open_ if found[s] > most * sizes[s]}
        if not over:
            return {**found, **{s: float(most * sizes[s]) for s in stopped}}
        stopped |= over


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, source string, size string, copies string")


@pytest.mark.parametrize("base", [BASE, "/root/testdata/sf0.01"])
def test_query_equals_sql(spark, base):
    case = CASES["op13_mix"]
    assert compare(duck(base), case.run(spark, base), case.sql) is None


@pytest.mark.parametrize("seed", range(3))
def test_targets_and_nearness(spark, seed):
    rng = random.Random(seed)
    rows, n = [], 0
    for source, docs in [("b", 400), ("é", 30), ("a", 5), (None, 200), ("", 90), ("Z", 600), ("~", 1)]:
        for _ in range(docs):
            rows.append((n, " ".join(["w"] * min(3000, int(rng.lognormvariate(4, 1.2)))), source))
            n += 1
    docs = frame(spark, rows)
    got = copies(docs).collect()
    assert sorted(r.doc_id for r in got) == list(range(n))
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(text.split())
    want = plain_targets(sizes)
    taken = Counter()
    for r in got:
        assert r.size == len(rows[r.doc_id][1].split()) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source], rel=1e-12)
        assert 0 <= r.copies <= 3 and r.copies - int(r.target / r.source_size) in (0, 1)
        taken[r.source] += r.size * r.copies
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    for source, target in want.items():
        largest = max(len(t.split()) for _, t, s in rows if s == source)
        assert abs(taken[source] - target) <= max(0.03 * target, largest if sizes[source] < 5 * largest else 0), source
    assert sorted(map(tuple, copies(docs.repartition(7)).collect()), key=repr) == sorted(map(tuple, got), key=repr)


def test_many_small_documents_come_near(spark):
    docs = spark.range(60_000).selectExpr("id AS doc_id", "repeat('w ', int(1 + id % 50)) AS text", "concat('s', int(pow(id % 100, 2)) % 3) AS source")
    rows = copies(docs).groupBy("source").agg({"target": "max", "size": "sum"}).collect()
    taken = {r[0]: r[1] for r in copies(docs).selectExpr("source", "size * copies AS t").groupBy("source").sum("t").collect()}
    for r in rows:
        assert taken[r.source] == pytest.approx(r["max(target)"], rel=0.02)


def test_mixed_rows_have_all_their_columns(spark):
    rows = [(k, "w " * (k % 9), "abc"[k % 3]) for k in range(60)] + [(3, "w w w", "a"), (None, "n", None), (8, None, "b"), (9, "", None)]
    docs = frame(spark, rows)
    out = mix(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    want = Counter()
    for r in copies(docs).collect():
        want[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in out.collect()) == +want


def test_odd_tables(spark):
    assert copies(frame(spark, [])).collect() == [] and mix(frame(spark, [])).collect() == []
    row = copies(frame(spark, [(1, None, "a"), (2, "", None)])).collect()
    assert {(r.doc_id, r.size, r.source_size, r.target, r.copies) for r in row} == {(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)}
    # rows that repeat a key and a size draw alike, one source alone keeps its size
    row = copies(frame(spark, [(1, "a b", "s")] * 40 + [(2, "c", "s")])).collect()
    assert {r.target for r in row} == {82.0 - 1.0} and {r.copies for r in row} == {1}
    many = copies(frame(spark, [(k, "a b", f"s{k:04}") for k in range(300)])).collect()
    assert {r.target for r in many} == {3.75, 1.5, 0.75}


def test_sources_over_blocks(spark):
    rows = [(k, "a b c", f"s{k:03}") for k in range(90)] + [(99, "a " * 400, None)]
    plain = sorted(map(tuple, copies(frame(spark, rows)).collect()))
    spark.conf.set("spark.tidemark.blockRows", "16")
    try:
        assert sorted(map(tuple, copies(frame(spark, rows)).collect())) == plain
    finally:
        spark.conf.unset("spark.tidemark.blockRows")
