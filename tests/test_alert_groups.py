"""Many tracks in one group of the alert processor, on plain stand-ins for its state."""

import random

import pandas as pd
from pyspark.sql import functions as F

from tests.test_alert_timers import Clock, Entries, Value
from tests.test_streams import files, plain_alerts
from tidemark.streaming import stateful
from tidemark.streaming import streams as st
from tidemark.streaming.stateful import SHARES, PassAlerts


class Handle:
    def __init__(self):
        self.calls, self.timers = [], set()
        self.registerTimer, self.deleteTimer = self.timers.add, self.timers.remove

    def noted(self, kind):
        handle = self

        class Noted(kind):
            def __getattribute__(self, name):
                if name in ("get", "update", "getValue", "updateValue", "removeKey", "containsKey"):
                    handle.calls.append(name)
                return super().__getattribute__(name)

        return Noted()

    def getValueState(self, *_):
        return self.noted(Value)

    def getMapState(self, *_):
        return self.noted(Entries)


def test_state_is_touched_per_slot_not_per_track():
    rng, tracks = random.Random(3), 400
    rows = [(k, k * 1000 + n, rng.uniform(0, 30), n * 500_000) for k in range(tracks) for n in range(8)]
    events = [(1, 10.0), (2, 20.0)]
    near = [[no * 2 + (t >= at) for no, at in events if -3 <= t - at < 4] for _, _, t, _ in rows]
    chunk = pd.DataFrame(rows, columns=["k", "seq", "t", "at"]).assign(near=near).sample(frac=1, random_state=1)
    chunk = pd.concat([chunk, pd.DataFrame({"k": [5, 6], "seq": [None, 7], "t": [1.0, None], "at": [0, 0], "near": [None, None]})])
    handle = Handle()
    found = PassAlerts("k", 1000)
    found.init(handle)
    list(found.handleInputRows((17,), iter([chunk[:1000], chunk[1000:]]), None))
    out = [pd.concat(found.handleExpiredTimer((17,), Clock(2000), Clock(2000))), pd.concat(found.handleExpiredTimer((17,), Clock(9000), Clock(4000)))]
    got = {k: [] for k in range(tracks)}
    for k, *row in pd.concat(out)[["k", "pass_no", "event_no", "kind", "seq"]].values.tolist():
        got[k].append(tuple(row))
    assert {k: sorted(v) for k, v in got.items()} == {k: plain_alerts([r[1:3] for r in rows if r[0] == k], events) for k in range(tracks)}
    # four slots, and two walks that each read and write every share of the tracks once
    assert len(handle.calls) <= 4 * 4 + 2 * 3 * SHARES + 8 < 2 * tracks
    assert not handle.timers - {1000, 3000}


def test_alerts_keep_their_tracks_beside_rows_without_one(spark):
    rows = [(None if n % 4 == 0 else n % 3 + 2**60, n, float(n % 7), n) for n in range(60)]
    parts = [rows[:30], [*rows[30:], (None, None, None, 10**9)]]
    stream = files(spark, parts, "track_id long, seq long, t double, s long").withColumn("at", F.timestamp_seconds("s"))
    static = spark.createDataFrame([(k + 2**60, 1, 5.0) for k in range(3)], "track_id long, event_no int, t double")
    emitted = st.run_available(stateful.alert_stream(stream, static, "track_id", slot_seconds=20), "append", conf=stateful.STORE)
    want = [(k, *x) for k in range(2**60, 2**60 + 3) for x in plain_alerts([r[1:3] for r in rows if r[0] == k], [(1, 5.0)])]
    assert sorted(map(tuple, emitted.drop("_batch").collect())) == sorted(want)
