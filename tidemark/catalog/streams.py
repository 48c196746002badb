"""Streaming queries: the events file is streamed to completion, SQL gives the batch truth."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import fixtures as fx
from tidemark.catalog.base import Case, r6, show, sql
from tidemark.catalog.events import E1, events
from tidemark.catalog.labels import LAST, LIVE
from tidemark.catalog.signal import KEYS
from tidemark.session import cut, scratch_path
from tidemark.streaming import stateful
from tidemark.streaming import streams as st


PARTS = 4


def event_stream(spark, base, disorder=False, closing=None):
    """The events as a stream of several files in time order, one to a micro-batch.

    With ``disorder`` the rows of a file are shuffled, a third of those of the last 12 hours of a file comes with the next one, and some
    of the first file come with the last one, days too late. ``closing`` adds rows as a last file.
    """
    events_ = fx.table(spark, base, "events")
    path = scratch_path(spark, "events-in")
    bounds = events_.agg(F.max("event_id")).first()
    part = F.floor(F.col("event_id") * PARTS / ((bounds[0] or 0) + 1)).cast("int")
    rows = events_.withColumn("_file", part)
    if disorder:
        ends = rows.groupBy("_file").agg(F.max("ts").alias("_end"))
        late = (F.unix_micros(F.col("_end").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp")) < LATE_HOURS * 3_600_000_000) & (F.col("event_id") % 3 == 0)
        home = F.when(too_late(F.col("_file")), PARTS - 1).when(late & (F.col("_file") < PARTS - 1), F.col("_file") + 1).otherwise(F.col("_file"))
        rows = rows.join(ends, "_file").withColumn("_file", home).drop("_end")
    rows = cut(rows)
    for k in range(PARTS):
        one = rows.filter(F.col("_file") == k).drop("_file").coalesce(1)
        (one.sortWithinPartitions(F.xxhash64("event_id")) if disorder else one).write.mode("append").parquet(path)
    if closing is not None:
        closing.coalesce(1).write.mode("append").parquet(path)
    return st.file_stream(spark, path, "*.parquet", events_.schema)


LATE_HOURS = 12
DELAY = "24 hours"


def too_late(part):
    """Rows of the first file that come after the watermark."""
    return (part == 0) & (F.col("event_id") % 97 == 5)


def heartbeat(spark, base):
    """One row without content, far in the future: it closes all windows behind it."""
    blank = fx.table(spark, base, "events").limit(0)
    return spark.createDataFrame([(None,) * len(blank.columns)], blank.schema).withColumn("ts", F.lit("2030-01-01").cast(blank.schema["ts"].dataType))


# the same rows in SQL: all but those that come too late
IN_TIME = f"(SELECT * FROM events WHERE NOT (floor(event_id * {PARTS} / ((SELECT max(event_id) FROM events) + 1)) = 0 AND event_id % 97 = 5))"


def _st1(spark, base):
    log = event_stream(spark, base).filter(F.col("event_type").isin("click", "error")).select(
        F.col("user_id").alias("audio"), F.round("value", 0).alias("time"),
        F.when(F.col("event_type") == "click", "add").otherwise("del").alias("action"),
    )
    emitted = st.run_available(st.live_marks_state(log))
    return st.latest_by_key(emitted, ["audio", "time"]).filter("live").select("audio", "time")


def _st2(spark, base):
    rest = F.col("event_id") % 5
    log = event_stream(spark, base).select(
        F.col("user_id").alias("audio"), F.round(F.col("value") / 10, 0).alias("time"),
        F.when(rest == 0, None).when(rest.isin(1, 2), 0).otherwise(1).alias("verdict"), F.col("event_id").alias("line_no"),
    )
    emitted = st.run_available(st.latest_verdict_state(log))
    return st.latest_by_key(emitted, ["audio", "time"]).select("audio", "time", "verdict", "line_no")


def _st3(spark, base):
    rows = event_stream(spark, base).select(F.col("user_id").alias("track_id"), F.col("ts").cast("timestamp").alias("ts"), "value")
    emitted = st.run_available(st.envelope(rows, ["track_id"], "ts", "value", "2 hours", "1 hour", "1 hour"))
    state = st.latest_by_key(emitted, ["track_id", "start"])
    return state.select("track_id", F.round(fx.hours("start"), 0).cast("long").alias("hour"), r6("level").alias("level"), "n")


ST3 = """WITH e AS (SELECT user_id AS track_id, value, unnest([floor((epoch_us(ts) - 1704067200000000) / 3.6e9)::BIGINT,
      floor((epoch_us(ts) - 1704067200000000) / 3.6e9)::BIGINT - 1]) AS hour FROM events)
    SELECT track_id, hour, round(10.0::DOUBLE * log10(greatest(avg(value * value), 1e-12)), 6) + 0.0 AS level, count(*) AS n FROM e GROUP BY 1, 2"""


def _st3_closed(spark, base):
    """Windows that the watermark closed, each emitted once; rows behind it are left out."""
    rows = event_stream(spark, base, True, heartbeat(spark, base)).select(F.col("user_id").alias("track_id"), F.col("ts").cast("timestamp").alias("ts"), "value")
    emitted = st.run_available(st.envelope(rows, ["track_id"], "ts", "value", "2 hours", "1 hour", DELAY), "append")
    return emitted.select("track_id", F.round(fx.hours("start"), 0).cast("long").alias("hour"), r6("level").alias("level"), "n")


def log_lines(rows):
    """Events as lines of a run log, one line form per residue of the id."""
    k, v = F.col("event_id") % 8, F.floor("value").cast("int")
    line = (
        F.when(k == 0, F.format_string("----- [%d/9] d/x.wav -----", v % 9 + 1))
        .when(k == 1, F.format_string("  …%d/600 块", v))
        .when(k == 2, F.lit("[ASR] 加载模型 x"))
        .when(k == 3, F.lit("[VAD] 采用 y"))
        .when(k == 4, F.lit("[ASR] 完成"))
        .when(k == 5, F.format_string("…%d/600 批完成", v))
        .when(k == 6, F.lit("[翻译] 完成"))
        .otherwise(F.lit("other"))
    )
    return rows.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("line_no"), line.alias("line"))


def durations(spark, base):
    users = fx.table(spark, base, "events").select(F.col("user_id").alias("run_id")).distinct().filter("run_id % 2 = 0")
    files = F.explode(F.sequence(F.lit(1), F.lit(9))).alias("file_no")
    return users.select("run_id", files).withColumn("duration", F.col("file_no") * 10.0)


def begun(state, durations_):
    """Progress of the runs that have told a stage."""
    return st.progress_view(state.filter(F.col("stage").isNotNull()), durations_)


def _st4(spark, base):
    emitted = st.run_available(st.progress_state(log_lines(event_stream(spark, base))))
    view = begun(st.latest_by_key(emitted, ["run_id"]), durations(spark, base))
    return show(view, "run_id", "file_index", "stage", "fraction", "file_fraction", "task_fraction")


def _st4_batch(spark, base):
    view = begun(st.progress_state(log_lines(fx.table(spark, base, "events"))), durations(spark, base))
    return show(view, "run_id", "file_index", "stage", "fraction", "file_fraction", "task_fraction")


ST4 = """WITH h AS (SELECT user_id AS run_id, arg_max(floor(value)::BIGINT % 9 + 1, event_id)::INTEGER AS file_index FROM events WHERE event_id % 8 = 0 GROUP BY 1),
    s AS (SELECT user_id AS run_id, arg_max(event_id % 8, event_id) AS k, arg_max(floor(value) / 6e2, event_id) AS p FROM events WHERE event_id % 8 <> 7 GROUP BY 1),
    f AS (SELECT s.run_id, file_index, CASE WHEN k IN (0, 2, 3) THEN 'prepare' WHEN k = 1 THEN 'recognise' WHEN k IN (4, 5) THEN 'translate' ELSE 'finish' END AS stage,
      CASE k WHEN 1 THEN p WHEN 5 THEN p WHEN 3 THEN 1e-2 WHEN 6 THEN 1e0 ELSE 0e0 END AS fraction FROM s LEFT JOIN h USING (run_id)),
    g AS (SELECT *, CASE stage WHEN 'prepare' THEN fraction * 2e-2 WHEN 'recognise' THEN 2e-2 + 56e-2 * fraction WHEN 'translate' THEN 58e-2 + 36e-2 * fraction
      ELSE 94e-2 + 6e-2 * fraction END AS ff FROM f)
    SELECT run_id, file_index, stage, round(fraction, 6) AS fraction, round(ff, 6) AS file_fraction,
      round(CASE WHEN run_id % 2 = 0 THEN least(1, (file_index * (file_index - 1) * 5 + file_index * 10 * ff) / 450) ELSE (file_index - 1 + ff) / 9 END, 6) AS task_fraction FROM g"""


def elapsed(rows):
    """Hours from a run's first line to its last."""
    return rows.groupBy(F.col("user_id").alias("run_id")).agg((fx.hours(F.max("ts")) - fx.hours(F.min("ts"))).alias("elapsed"))


def _st4_left(spark, base):
    """Time left of each run, from what it took so far and how far it is; none below 3 %."""
    emitted = st.run_available(st.progress_state(log_lines(event_stream(spark, base))))
    view = begun(st.latest_by_key(emitted, ["run_id"]), durations(spark, base))
    rows = view.join(elapsed(fx.table(spark, base, "events")), "run_id")
    return show(rows, "run_id", "elapsed", "task_fraction", left=st.eta(F.col("elapsed"), F.col("task_fraction")))


ST4_LEFT = f"""WITH v AS ({ST4.replace("round(CASE WHEN", "(CASE WHEN").replace("/ 9 END, 6)", "/ 9 END)")}),
    e AS (SELECT user_id AS run_id, (epoch_us(max(ts)) - 1704067200000000) / 3.6e9 - (epoch_us(min(ts)) - 1704067200000000) / 3.6e9 AS took FROM events GROUP BY 1)
    SELECT run_id, round(took, 6) + 0.0 AS elapsed, round(task_fraction, 6) AS task_fraction,
      CASE WHEN task_fraction > 3e-2 THEN round(took / task_fraction * (1 - task_fraction), 6) + 0.0 END AS "left" FROM v JOIN e USING (run_id)"""


def positions(rows, *more):
    """Events as playback reports: mostly moving on, sometimes jumping back."""
    step = (F.col("event_id") % 3000) / 4.0
    return rows.select(F.col("user_id").alias("track_id"), F.col("event_id").alias("seq"), step.alias("t"), *more)


def chosen(spark, base):
    return events(spark, base).select("track_id", F.col("rank").alias("event_no"), "t")


def _st5(spark, base):
    passes = st.playback_passes(positions(fx.table(spark, base, "events")), ["track_id"])
    return st.alerts(passes, chosen(spark, base), "track_id")


def _st5_stream(spark, base):
    """Reports out of order, some a day late and some too late; passes and flags live in the stream's state."""
    rows = event_stream(spark, base, True, heartbeat(spark, base))
    at = positions(rows, F.col("ts").cast("timestamp").alias("at"))
    found = stateful.alert_stream(at, cut(chosen(spark, base)), "track_id", delay=DELAY)
    return st.run_available(found, "append", conf=stateful.STORE).drop("_batch")


def _st5_sql(source):
    return sql(
        "v_cand",
        """SELECT track_id, pass_no, event_no, kind, min(seq) AS seq FROM (SELECT ps.track_id, pass_no, seq, x.rank AS event_no,
          CASE WHEN ps.t >= x.t AND ps.t - x.t < 4 THEN 'hit' WHEN ps.t - x.t >= -3 AND ps.t < x.t THEN 'approaching' END AS kind
          FROM ps JOIN ax x USING (track_id)) WHERE kind IS NOT NULL GROUP BY 1, 2, 3, 4""",
        **E1,
        po=f"SELECT user_id AS track_id, event_id AS seq, (event_id % 3000) / 4e0 AS t FROM {source}",
        ps="""SELECT track_id, seq, t, (sum(CASE WHEN t < p - 4e-1 THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY seq))::BIGINT AS pass_no
          FROM (SELECT *, lag(t) OVER (PARTITION BY track_id ORDER BY seq) AS p FROM po)""",
    )


def _st6(spark, base):
    lines = fx.conversation_segments(spark, base).select("track_id", "start", "seg_no")
    at = positions(fx.table(spark, base, "events"))
    return st.current_line(at, lines, ["track_id"]).select("track_id", "seq", "line_no")


def _st6_stream(spark, base):
    """Every micro-batch reads only the slots of the stored lines that its positions fall into."""
    path = scratch_path(spark, "shown-lines")
    st.store_shown_lines(fx.conversation_segments(spark, base).select("track_id", "start", "seg_no"), ["track_id"], path)
    emitted = st.run_available(positions(event_stream(spark, base)), "append", lambda batch: st.shown_line(batch, path, ["track_id"]))
    return emitted.select("track_id", "seq", "line_no")


ST6 = sql(
    "v_conv",
    """SELECT po.track_id, seq, (SELECT max(s.seg_no) FROM v_conv s WHERE s.track_id = po.track_id AND s."start" <= po.t + 15e-2) AS line_no FROM po""",
    po="SELECT user_id AS track_id, event_id AS seq, (event_id % 3000) / 4e0 AS t FROM events",
)


def _st7(spark, base):
    log = fx.table(spark, base, "events").select(F.col("user_id").alias("run_id"), "event_id")
    return st.log_tail(st.dense_log(log, ["run_id"], "event_id"), F.col("run_id") % 30, 50, 10).select("run_id", "line_no", "event_id")


ST7 = """SELECT run_id, line_no, event_id FROM (SELECT user_id AS run_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS line_no,
      count(*) OVER (PARTITION BY user_id) AS n FROM events)
    WHERE line_no >= greatest(run_id % 30, CASE WHEN n > 50 THEN ceil((n - 50) / 1e1) * 10 ELSE 0 END)"""


def _st7_stream(spark, base):
    """The same tails asked from the state of a stream: a last file holds one request for each run."""
    events_ = fx.table(spark, base, "events")
    asked = events_.select("user_id").distinct().join(events_.limit(0).drop("user_id"), F.lit(False), "left").select(*events_.columns)
    rows = event_stream(spark, base, closing=asked)
    since = F.when(F.col("event_id").isNull(), F.col("user_id") % 30)
    log = rows.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("place"), F.col("event_id").cast("string").alias("line"), since.cast("bigint").alias("since"))
    emitted = st.run_available(stateful.tail_stream(log, "run_id", 50, 10), "append", conf=stateful.STORE)
    return emitted.select("run_id", "line_no", F.col("line").cast("bigint").alias("event_id"))


def _st8(spark, base):
    rows = fx.table(spark, base, "events").filter("event_type = 'purchase' AND value >= 100")
    out = st.sessions(rows.select(F.col("user_id").alias("track_id"), F.col("ts").cast("timestamp").alias("ts")), ["track_id"], "ts", "30 hours")
    return out.select("track_id", r6(fx.hours("first_ts")).alias("first_t"), "members")


def _st8_stream(spark, base):
    """The same groups kept over the micro-batches; the last batch has them all."""
    rows = event_stream(spark, base).filter("event_type = 'purchase' AND value >= 100")
    found = st.sessions(rows.select(F.col("user_id").alias("track_id"), F.col("ts").cast("timestamp").alias("ts")), ["track_id"], "ts", "30 hours")
    emitted = st.run_available(found, "complete")
    last = emitted.agg(F.max("_batch").alias("_last"))
    out = emitted.join(last, F.col("_batch") == F.col("_last"))
    return out.select("track_id", r6(fx.hours("first_ts")).alias("first_t"), "members")


def _st8_closed(spark, base):
    """Groups that the watermark closed, each emitted once; rows behind it are left out."""
    rows = event_stream(spark, base, True, heartbeat(spark, base)).filter("event_type = 'purchase' AND value >= 100 OR user_id IS NULL")
    found = st.sessions(rows.select(F.col("user_id").alias("track_id"), F.col("ts").cast("timestamp").alias("ts")), ["track_id"], "ts", "30 hours", DELAY)
    return st.run_available(found, "append").select("track_id", r6(fx.hours("first_ts")).alias("first_t"), "members")


ST8 = sql(
    "v_truth",
    """SELECT track_id, round(min(t), 6) AS first_t, count(*) AS members FROM (SELECT *, sum(CASE WHEN t - p < 30 THEN 0 ELSE 1 END)
      OVER (PARTITION BY track_id ORDER BY t) AS grp FROM (SELECT *, lag(t) OVER (PARTITION BY track_id ORDER BY t) AS p FROM v_truth)) GROUP BY track_id, grp""",
)

ST8_CLOSED = ST8.replace("FROM v_truth", "FROM truths").replace("v_truth AS MATERIALIZED", "truths AS MATERIALIZED").replace("FROM events", f"FROM {IN_TIME}")

CASES = {
    "st1_live_marks_stream": Case(_st1, sql("v_marks", "SELECT * FROM live", live=LIVE)),
    "st2_latest_verdict_stream": Case(_st2, sql("v_feedback", "SELECT audio, time, verdict, line_no FROM l", l=LAST)),
    "st3_envelope_stream": Case(_st3, ST3),
    "st3_envelope_closed": Case(_st3_closed, ST3.replace("FROM events", f"FROM {IN_TIME}")),
    "st4_progress_stream": Case(_st4, ST4),
    "st4_progress_batch": Case(_st4_batch, ST4),
    "st4_time_left": Case(_st4_left, ST4_LEFT),
    "st5_alerts": Case(_st5, _st5_sql("events")),
    "st5_alert_stream": Case(_st5_stream, _st5_sql(IN_TIME)),
    "st6_current_line": Case(_st6, ST6),
    "st6_current_line_stream": Case(_st6_stream, ST6),
    "st7_log_tail": Case(_st7, ST7),
    "st7_log_tail_stream": Case(_st7_stream, ST7),
    "st8_sessions": Case(_st8, ST8),
    "st8_sessions_stream": Case(_st8_stream, ST8),
    "st8_sessions_closed": Case(_st8_closed, ST8_CLOSED),
}
