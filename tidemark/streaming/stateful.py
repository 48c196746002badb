"""Keyed state processors: alerts of playback passes in event-time order, and log tails of bounded length.

Both need the RocksDB state store (``STORE``), which keeps single entries of a key's state apart.
"""

from __future__ import annotations

import itertools
import math
import pickle
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.streaming.streams import LOG_DROP, LOG_LIMIT, SEEK_BACK, near_events

STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
}
#: Groups that share the state of alerts, shares of a group's tracks that are read and written at once, rows or tracks of a group in memory, about.
GROUPS = 128
SHARES = 64
HELD_ROWS = 50_000
#: Lines of a log that stand with its counts, at least one chunk.
OPEN_LINES = 256


class PassAlerts(StatefulProcessor):
    """Alerts once per pass. Positions wait in slots of event time; slots are walked in order and evicted when the watermark
    has passed their ends, so neither disorder within the delay nor the cut into batches changes a result.

    The state of a group serves all of its tracks, so state is read and written per slot and per share of the tracks, not per
    track; rows without a column ``key`` belong to the track that the group is named after. A group has one timer, at the end of
    its first waiting slot, which walks all slots that have ended by then.
    """

    def __init__(self, key: str, slot_ms: int) -> None:
        self.key, self.slot_ms = key, slot_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slots = handle.getValueState("slots", "slots array<bigint>, timer bigint")
        # pickled lists of a slot's tracks, times, numbers, positions and codes; pickled last position, pass and fired codes by track
        self.waiting = handle.getMapState("waiting", "slot bigint", "rows binary")
        self.now = handle.getMapState("now", "share bigint", "tracks binary")

    def _wait(self, slots: set, timer: int | None) -> None:
        """Remember the waiting slots, and see that the first one's end has the group's timer."""
        first = (min(slots) + 1) * self.slot_ms if slots else None
        if first is not None and (timer is None or first < timer):
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(first)
            timer = first
        self.slots.update((sorted(slots), timer))

    def _hold(self, known: set, fresh: dict[int, tuple[list, ...]]) -> None:
        """Append rows to their slots."""
        for slot, more in fresh.items():
            held = pickle.loads(self.waiting.getValue((slot,))[0]) if slot in known else ()
            rows = tuple([*a, *b] for a, b in zip(held, more)) if held else more
            self.waiting.updateValue((slot,), (pickle.dumps(rows, pickle.HIGHEST_PROTOCOL),))
            known.add(slot)
        fresh.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        known, timer = self.slots.get() or ([], None)
        known, fresh, count = set(known), {}, 0
        for chunk in rows:
            chunk = chunk[chunk["seq"].notna() & chunk["t"].notna() & chunk["at"].notna()]
            if "known" in chunk:
                chunk = chunk[chunk["known"]]
            n = len(chunk)
            if not n:
                continue
            tracks = chunk[self.key].tolist() if self.key in chunk else [key[0]] * n
            near = [[int(x) for x in codes] if codes is not None else [] for codes in chunk["near"]]
            at = chunk["at"].astype("int64")
            for slot, *row in zip((at // (self.slot_ms * 1000)).tolist(), tracks, at.tolist(), chunk["seq"].astype("int64").tolist(), chunk["t"].astype("float64").tolist(), near):
                for column, value in zip(fresh.setdefault(slot, ([], [], [], [], [])), row):
                    column.append(value)
            count += n
            if count >= HELD_ROWS:
                self._hold(known, fresh)
                count = 0
        self._hold(known, fresh)
        if known:
            self._wait(known, timer)
        return iter(())

    def _share(self, track) -> int:
        return zlib.crc32(repr(track).encode()) % SHARES

    def _keep(self, shares: dict[int, dict]) -> None:
        for share, tracks in shares.items():
            self.now.updateValue((share,), (pickle.dumps(tracks, pickle.HIGHEST_PROTOCOL),))
        shares.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        known = set((self.slots.get() or ([], None))[0])
        until = timerValues.getCurrentWatermarkInMs()
        fires = expiredTimerInfo.getExpiryTimeInMs()
        ended = sorted(s for s in known if (s + 1) * self.slot_ms < until or (s + 1) * self.slot_ms <= fires)
        shares: dict[int, dict] = {}
        places: dict = {}  # the state of each track met, and its share's dict
        found: list[tuple] = []

        def frame() -> "pd.DataFrame":
            out = pd.DataFrame(found, columns=[self.key, "pass_no", "event_no", "kind", "seq"])
            found.clear()
            return out.assign(kind=out["kind"].astype(object))

        for slot in ended:
            rows = sorted(zip(*pickle.loads(self.waiting.getValue((slot,))[0])), key=lambda r: r[1:3])
            self.waiting.removeKey((slot,))
            for track, _, seq, t, near in rows:
                state = places.get(track)
                if state is None:
                    share = self._share(track)
                    if share not in shares:
                        shares[share] = pickle.loads(self.now.getValue((share,))[0]) if self.now.containsKey((share,)) else {}
                    state = places[track] = shares[share].setdefault(track, [None, 0, set()])
                if state[0] is not None and t < state[0] - SEEK_BACK:
                    state[1], state[2] = state[1] + 1, set()
                state[0] = t
                for code in near:
                    if code not in state[2]:
                        state[2].add(code)
                        found.append((track, state[1], code // 2, "hit" if code % 2 else "approaching", seq))
            if len(places) >= HELD_ROWS:
                self._keep(shares)
                places.clear()
            if len(found) >= HELD_ROWS:
                yield frame()
        self._keep(shares)
        self._wait(known.difference(ended), None)
        if found:
            yield frame()

    def close(self) -> None:
        pass


def alert_stream(
    positions: DataFrame, events: DataFrame, key: str, at: str = "at", delay: str = "1 hour", slot_seconds: int = 3600, groups: int = GROUPS
) -> DataFrame:
    """``(key, pass_no, event_no, kind, seq)`` as a stream (append mode, store ``STORE``): the streaming form of ``playback_passes``
    and ``alerts``.

    ``positions`` has the key, ``seq``, ``t`` and the event time ``at``, in any order up to ``delay``; order within a key is ``at``,
    then ``seq``. Later rows are dropped. ``events`` is a static frame of few selected events per key. State per key: the
    last position, its pass, the flags of that pass (at most two for each event), and the positions of the slots that the
    watermark hasn't closed. Keys are dealt by hash to ``groups`` that hold their state together, a number that must stay as it
    is while a checkpoint is in use and should be at least that of the cores. A row with a null key or ``t`` moves the
    watermark and nothing else.
    """
    rows = near_events(positions.withWatermark(at, delay), events, key)
    kind = positions.schema[key].dataType.simpleString()
    micros = F.unix_micros(at)
    known = F.col(key).isNotNull() & F.col("seq").isNotNull() & F.col("t").isNotNull() & micros.isNotNull()
    # a null among the integers of a batch would turn all of them into floats
    track = F.coalesce(F.col(key), F.lit(0).cast(kind)) if kind in ("tinyint", "smallint", "int", "bigint") else F.col(key)
    whole = [F.coalesce(c, F.lit(0)).cast("long").alias(n) for n, c in (("seq", F.col("seq")), ("at", micros))]
    group = F.coalesce(F.pmod(F.xxhash64(key), F.lit(groups)), F.lit(0)).cast("int").alias("_group")
    return rows.select(group, track.alias(key), *whole, "t", "near", known.alias("known"), F.col(at).alias("event_time")).groupBy("_group").transformWithStateInPandas(
        PassAlerts(key, slot_seconds * 1000), f"{key} {kind}, pass_no bigint, event_no int, kind string, seq bigint", "append", "EventTime"
    )


class RetainedLines(StatefulProcessor):
    """The last lines of a log; whole chunks are forgotten when it grows beyond its limit.

    The newest lines stand in one value with the counts, so a batch of a short log costs one reading and one writing of state. When they
    are more than ``OPEN_LINES``, their whole chunks move to a map, where they are neither read nor written until asked for or forgotten.
    """

    def __init__(self, key: str, limit: int, drop: int) -> None:
        self.key, self.limit, self.drop = key, limit, drop

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.log = handle.getValueState("log", "lines bigint, first bigint, open array<string>")
        self.chunks = handle.getMapState("chunks", "chunk bigint", "lines array<string>")

    def _append(self, state: tuple, lines: list) -> tuple:
        n, first, held = state
        at, total = n - len(held), n + len(lines)  # chunks below ``at`` are in the map
        keep = max(first, math.ceil(max(0, total - self.limit) / self.drop) * self.drop)
        for chunk in range(first // self.drop, min(keep, at) // self.drop):
            self.chunks.removeKey((chunk,))
        held = [*held, *lines][max(0, keep - at) :]
        at = max(at, keep)
        if len(held) > max(OPEN_LINES, self.drop):
            for low in range(0, len(held) - self.drop + 1, self.drop):
                self.chunks.updateValue(((at + low) // self.drop,), (held[low : low + self.drop],))
            held = held[len(held) // self.drop * self.drop :]
        self.log.update((total, keep, held))
        return total, keep, held

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        lines, asked = [], []
        for chunk in rows:
            # plain lists: the few rows of a key cost less than a pandas selection
            for place, line, since in zip(chunk["place"].tolist(), chunk["line"].tolist(), chunk["since"].tolist()):
                if pd.isna(since):
                    lines.append((place, line))
                else:
                    asked.append(int(since))
        state = self.log.get() or (0, 0, [])
        if lines:
            state = self._append(state, [line for _, line in sorted(lines, key=lambda x: x[0])])
        n, first, held = state
        at = n - len(held)
        for since in asked:
            low = max(since, first)
            stored = ((c * self.drop, self.chunks.getValue((c,))[0]) for c in range(low // self.drop, at // self.drop))
            for begin, part in itertools.chain(stored, [(at, held)]):
                skip = max(0, low - begin)
                numbers = range(begin + skip, begin + len(part))
                if numbers:
                    # strings as objects: frames of one key are concatenated before they become one Arrow array
                    shown = pd.Series(list(part[skip:]), dtype=object)
                    yield pd.DataFrame({self.key: [key[0]] * len(numbers), "since": [since] * len(numbers), "line_no": list(numbers), "line": shown})

    def close(self) -> None:
        pass


def tail_stream(log: DataFrame, key: str, limit: int = LOG_LIMIT, drop: int = LOG_DROP) -> DataFrame:
    """Answers of a log kept in state (append mode, store ``STORE``): ``(key, since, line_no, line)`` of the lines retained from ``since`` on.

    ``log`` has the key, ``place``, ``line`` and ``since``; a row with ``since`` is a request, answered after the lines of its batch, any
    other one is a line. Lines are numbered from 0 in the order of batches, then ``place``. A log of more than ``limit``
    lines forgets its first ``drop``, as ``log_tail`` does, so its state never holds more than ``limit`` lines.
    """
    kind = log.schema[key].dataType.simpleString()
    return log.select(key, "place", "line", "since").groupBy(key).transformWithStateInPandas(
        RetainedLines(key, limit, drop), f"{key} {kind}, since bigint, line_no bigint, line string", "append", "None"
    )
