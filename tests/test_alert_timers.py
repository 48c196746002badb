"""Timers of the alert processor, on plain stand-ins for its state."""

import pandas as pd

from tidemark.streaming.stateful import PassAlerts


class Value:
    def __init__(self):
        self.held = None

    def get(self):
        return self.held

    def exists(self):
        return self.held is not None

    def update(self, held):
        self.held = held


class Entries(dict):
    containsKey, getValue, updateValue, removeKey = dict.__contains__, dict.__getitem__, dict.__setitem__, dict.__delitem__


class Handle:
    def __init__(self):
        self.timers = set()
        self.registerTimer, self.deleteTimer = self.timers.add, self.timers.remove

    def getValueState(self, *_):
        return Value()

    def getMapState(self, *_):
        return Entries()


class Clock:
    def __init__(self, now):
        self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: now


def test_a_key_has_one_timer():
    handle = Handle()
    found = PassAlerts("k", 1000)
    found.init(handle)
    chunk = pd.DataFrame({"seq": range(10), "t": [float(i) for i in range(10)], "at": [i * 1_000_000 for i in range(10)], "near": [[3]] * 5 + [[5]] * 5})
    list(found.handleInputRows((7,), iter([chunk[5:], chunk[:5]]), None))
    assert handle.timers == {1000}
    handle.timers.clear()
    out = pd.concat(found.handleExpiredTimer((7,), Clock(6500), Clock(1000)))
    assert out[["k", "pass_no", "event_no", "kind", "seq"]].values.tolist() == [[7, 0, 1, "hit", 0], [7, 0, 2, "hit", 5]]
    assert handle.timers == {7000} and sorted(found.waiting) == [(6,), (7,), (8,), (9,)]
