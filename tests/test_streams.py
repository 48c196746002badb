"""Streams with late and repeated input against plain rules and their batch twins."""

import random

import pytest
from pyspark.sql import functions as F

from tests.check import compare, duck
from tidemark.catalog import cases
from tidemark.session import scratch_path
from tidemark.sources.sinks import append_log_stream
from tidemark.streaming import stateful
from tidemark.streaming import streams as st

BASE = "/root/testdata/sf0.001"
NAMES = """st3_envelope_closed st4_time_left st5_alerts st5_alert_stream st6_current_line_stream st7_log_tail_stream st8_sessions_closed
k5_append_log_stream""".split()


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    case = cases()[name]
    assert compare(duck(BASE), case.run(spark, BASE), case.sql) is None


def files(spark, parts, schema):
    path = scratch_path(spark, "parts")
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return st.file_stream(spark, path, "*.parquet", spark.createDataFrame([], schema).schema)


def plain_alerts(rows, events):
    out, last, number, fired = [], None, 0, set()
    for seq, t in sorted(rows):
        if last is not None and t < last - 0.4:
            number, fired = number + 1, set()
        last = t
        for no, at in events:
            kind = "hit" if 0 <= t - at < 4 else "approaching" if -3 <= t - at < 0 else None
            if kind and (no, kind) not in fired:
                fired.add((no, kind))
                out.append((number, no, kind, seq))
    return sorted(out)


@pytest.mark.parametrize("slot", [60, 3600])
def test_alerts_of_disordered_reports(spark, slot):
    rng = random.Random(slot)
    events = {k: [(n + 1, rng.uniform(0, 60)) for n in range(rng.randrange(4))] for k in range(6)}
    rows, seq = [], 0
    for k in range(6):
        t = 0.0
        for _ in range(600 if k == 0 else 80):  # one track has most of all reports
            t = rng.uniform(0, 60) if rng.random() < 0.06 else t + rng.uniform(0, 2)
            rows.append((k, seq, t, seq * 10))
            seq += 1
    # a report arrives up to 300 places, 3000 seconds, behind its turn
    rows.sort(key=lambda r: r[1] + rng.uniform(0, 300))
    parts = [rows[n : n + 140] for n in range(0, len(rows), 140)]
    dead = [(0, 10**6 + n, 1.0, 5) for n in range(3)]  # far too late: left out
    parts = [*parts[:-1], [*parts[-1], *dead], [(None, None, None, 10**9)]]
    stream = files(spark, parts, "track_id long, seq long, t double, s long").withColumn("at", F.timestamp_seconds("s"))
    static = spark.createDataFrame([(k, n, t) for k, v in events.items() for n, t in v], "track_id long, event_no int, t double")
    emitted = st.run_available(stateful.alert_stream(stream, static, "track_id", delay="3600 seconds", slot_seconds=slot), "append", conf=stateful.STORE)
    got = {k: [] for k in range(6)}
    for r in emitted.collect():
        got[r.track_id].append((r.pass_no, r.event_no, r.kind, r.seq))
    assert {k: sorted(v) for k, v in got.items()} == {k: plain_alerts([r[1:3] for r in rows if r[0] == k], events[k]) for k in range(6)}
    # and equal to the batch operators
    batch = spark.createDataFrame([r[:3] for r in rows], "track_id long, seq long, t double")
    twin = st.alerts(st.playback_passes(batch, ["track_id"]), static, "track_id").collect()
    assert sorted(map(tuple, twin)) == sorted((k, *x) for k, v in got.items() for x in v)


@pytest.mark.parametrize("limit,drop", [(50, 10), (7, 3), (5000, 1000)])
def test_tails_forget_whole_chunks(spark, limit, drop):
    rng = random.Random(limit)
    logs = {k: [f"{k}:{n}" for n in range(rng.choice([0, 3, 90, 260]))] for k in range(8)}
    parts = []
    for n in range(0, 260, 45):
        rows = [(k, i, line, None) for k, v in logs.items() for i, line in enumerate(v[n : n + 45])]
        rng.shuffle(rows)
        parts.append(rows)
    parts.append([(k, None, None, s) for k in logs for s in (0, 40)])
    stream = files(spark, parts, "run_id long, place long, line string, since long")
    got = sorted(map(tuple, st.run_available(stateful.tail_stream(stream, "run_id", limit, drop), "append", conf=stateful.STORE).drop("_batch").collect()))
    want = []
    for k, lines in logs.items():
        held, first = [], 0
        for line in lines:
            held.append(line)
            if len(held) > limit:
                held, first = held[drop:], first + drop
        want += [(k, since, first + i, line) for since in (0, 40) for i, line in enumerate(held) if first + i >= since]
    assert got == sorted(want)


@pytest.mark.parametrize("limit, drop, most", [(50, 10, 2), (1000, 100, 30)])
def test_log_tail_touches_little_state(limit, drop, most):
    """A batch of a short log costs one reading and one writing; of a long one, the closed chunks stay untouched."""
    import pandas as pd

    seen = []

    class Held:
        def __init__(self):
            self.held = {}

        def __getattr__(self, name):
            def call(key=None, value=None):
                seen.append(name)
                if name in ("get", "getValue"):
                    return self.held.get(key)
                if name in ("exists", "containsKey"):
                    return key in self.held
                if name == "removeKey":
                    return self.held.pop(key)
                self.held.update({key: value} if name == "updateValue" else {None: key})

            return call

    class Handle:
        def __getattr__(self, name):
            return lambda *_: Held()

    log = stateful.RetainedLines("run_id", limit, drop)
    log.init(Handle())
    for batch in range(8):
        seen.clear()
        at = range(batch * 300, batch * 300 + 300) if limit > 50 else range(batch * 16, batch * 16 + 16)
        list(log.handleInputRows((1,), iter([pd.DataFrame({"place": at, "line": [str(i) for i in at], "since": [None] * len(at)})]), None))
        assert len(seen) <= most, seen
    n = at[-1] + 1
    gone = -(-(n - limit) // drop) * drop
    out = list(log.handleInputRows((1,), iter([pd.DataFrame({"place": [None], "line": [None], "since": [0]})]), None))
    assert [x for f in out for x in zip(f["line_no"], f["line"])] == [(i, str(i)) for i in range(gone, n)]


def test_shown_lines_read_only_their_slots(spark):
    def lines(n):
        return spark.range(n).selectExpr("id % 5 AS track_id", "CAST(id * 0.9 AS DOUBLE) AS start", "id AS seg_no")

    positions = spark.range(200).selectExpr("id % 6 AS track_id", "id AS seq", "CAST(id * 0.77 AS DOUBLE) AS t")
    read = []
    for n in (500, 5000):
        path = scratch_path(spark, "lines")
        st.store_shown_lines(lines(n), ["track_id"], path)
        got = st.shown_line(positions, path, ["track_id"])
        want = st.current_line(positions, lines(n), ["track_id"])
        assert sorted(map(tuple, got.select("track_id", "seq", "line_no").collect())) == sorted(map(tuple, want.select("track_id", "seq", "line_no").collect()))
        slots = [r[0] for r in positions.select(F.floor((F.col("t") + st.LINE_LEAD) / st.LINE_SLOT).alias("s")).distinct().collect()]
        read.append(spark.read.parquet(f"{path}/ending").filter(F.col("slot").isin(slots)).count() + spark.read.parquet(f"{path}/last").count())
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [slot" in plan or "PartitionFilters: [isnotnull(slot" in plan
    assert read[0] == read[1]


def test_shown_lines_with_ties_blanks_and_no_lines(spark):
    rows = [(1, 1.0, 1), (1, 1.0, 2), (1, 200.0, 3), (2, None, 4), (3, 5.0, 5)]
    at = [(1, 0, 0.0), (1, 1, 0.9), (1, 2, 150.0), (1, 3, 199.9), (1, 4, 9e5), (2, 5, 3.0), (3, 6, 4.0), (3, 7, 5.0), (9, 8, 1.0), (1, 9, None)]
    positions = spark.createDataFrame(at, "track_id long, seq long, t double")
    for some in (rows, rows[3:], []):
        frame = spark.createDataFrame(some, "track_id long, start double, seg_no long")
        path = scratch_path(spark, "lines")
        st.store_shown_lines(frame, ["track_id"], path)
        got = {r.seq: r.line_no for r in st.shown_line(positions, path, ["track_id"]).collect()}
        def shown(k, t):
            return max(((s, n) for i, s, n in some if i == k and s is not None and t is not None and s <= t + 0.15), default=(None, None))[1]

        assert got == {seq: shown(k, t) for k, seq, t in at}


def test_a_repeated_stream_writes_no_record_twice(spark):
    parts = [[(n, "add" if n % 3 else None) for n in range(k, k + 20)] for k in (0, 20, 40)]
    path = scratch_path(spark, "log")
    for _ in range(2):
        append_log_stream(files(spark, parts, "n long, action string"), path, scratch_path(spark, "state"), ["action"], {"action": ["add"]}).awaitTermination()
    assert sorted(r.n for r in spark.read.schema("n long, action string").json(path).collect()) == [n for n in range(60) if n % 3]
