"""Text comparison reports by key: every track is gated and reported."""

from pyspark.sql import functions as F

from tests.check import compare, duck
from tidemark.catalog import cases
from tidemark.operators.metrics import text_compare_report

BASE = "/root/testdata/sf0.001"


def test_every_track_equals_sql(spark):
    con = duck(BASE)
    for name in ("a2_text_compare_by_track", "a2_text_compare_gated", "a2_text_compare_report"):
        case = cases()[name]
        assert compare(con, case.run(spark, BASE), case.sql) is None
    tracks = {r.track_id for r in cases()["a2_text_compare_by_track"].run(spark, BASE).collect()}
    assert max(tracks) >= 6


def test_gate_of_each_key(spark):
    pairs = spark.createDataFrame([(1, "a", "a"), (1, "b", "bb"), (2, "c", "c"), (None, "d", "d"), (3, "e", "e")], "k long, ours string, theirs string")
    ref = spark.createDataFrame([(1, 2, "no"), (1, 1, "YES"), (2, 1, "no"), (2, 2, "YES"), (None, 1, "YES"), (9, 1, "YES")], "k long, t long, theirs string")
    out = text_compare_report(pairs, "ours", "theirs", ref, ["t"], "[A-Z]", ["k"])
    assert sorted(((r.k or 0), r.pairs, r.same_share) for r in out.collect()) == [(0, 1, 1.0), (1, 2, 0.5)]
    assert text_compare_report(pairs, "ours", "theirs", ref.filter("k = 2"), ["t"], "[A-Z]").count() == 0
    assert text_compare_report(pairs, "ours", "theirs", ref.filter(F.col("k") == 1), ["t"], "[A-Z]").first().pairs == 5
    assert text_compare_report(pairs.filter("k > 9"), "ours", "theirs").count() == 0
