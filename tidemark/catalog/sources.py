"""Readers and writers: what is written is derived from the tables, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import fixtures as fx
from tidemark.catalog.base import Case, show, sql
from tidemark.catalog.events import E1, events
from tidemark.catalog.text import strip_sql
from tidemark.session import scratch_path
from tidemark.sources import readers as rd
from tidemark.sources import sinks as sk
from tidemark.streaming.streams import file_stream

KEYS = fx.TRACK


def turns(spark, base):
    """Conversation turns as one-line segments."""
    rows = fx.conversation_segments(spark, base)
    return rows.withColumn("text", F.regexp_replace("text", r"\s+", " "))


ONE_LINE = "SELECT * REPLACE (regexp_replace(text, '\\s+', ' ', 'g') AS text) FROM v_conv"


def written_lines(spark, base, mode="source", header=None):
    path = scratch_path(spark, "lrc")
    sk.write_text(sk.timed_lines(turns(spark, base), KEYS, mode, header), path, "track_id", ["seg_no", "part"])
    return path


def _s1(dialect):
    def run(spark, base):
        lines = rd.read_timed_lines(spark, written_lines(spark, base), dialect)
        track = F.regexp_extract("file", r"track_id=(\d+)/", 1).cast("long")
        return show(lines.select(track.alias("track_id"), "t", "text"), "track_id", "t", "text")

    return run


def _s1_keep(spark, base):
    """Every third text blank: this dialect keeps the line."""
    rows = turns(spark, base).withColumn("text", F.when(F.col("seg_no") % 3 == 0, " ").otherwise(F.col("text")))
    path = scratch_path(spark, "lrc")
    sk.write_text(sk.timed_lines(rows, KEYS, "source"), path, "track_id", ["seg_no", "part"])
    lines = rd.read_timed_lines(spark, path, "keep")
    track = F.regexp_extract("file", r"track_id=(\d+)/", 1).cast("long")
    return show(lines.select(track.alias("track_id"), "t", "text"), "track_id", "t", "text")


S1_KEEP = sql(
    "v_conv",
    f"""SELECT track_id, round("start", 6) AS t, CASE WHEN seg_no % 3 = 0 THEN '' ELSE {strip_sql('text')} END AS text FROM o""",
    o=ONE_LINE,
)
S1 = sql("v_conv", f"""SELECT track_id, round("start", 6) AS t, {strip_sql('text')} AS text FROM o WHERE {strip_sql('text')} <> ''""", o=ONE_LINE)


def _s1_numbered(spark, base):
    lines = rd.read_lines(spark, written_lines(spark, base, "both", F.concat(F.lit("T"), F.col("track_id").cast("string"))), numbered=True, parts=True)
    track = F.regexp_extract("file", r"track_id=(\d+)/", 1).cast("long").alias("track_id")
    return lines.select(track, F.col("line_no").cast("long").alias("line_no"), F.regexp_replace("line", r"^\[\d+:[\d.]+\]", "").alias("body"))


S1_NUMBERED = sql(
    "v_conv",
    f"""SELECT track_id, 2 * n - 1 AS line_no, {strip_sql('text')} AS body FROM p UNION ALL SELECT track_id, 2 * n, {strip_sql('text')} FROM p
      UNION ALL SELECT DISTINCT track_id, 0::BIGINT, '[ti:T' || track_id || ']' FROM p""",
    o=ONE_LINE,
    p="SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY seg_no) AS n FROM o",
)


def _s2(spark, base):
    path = scratch_path(spark, "segments")
    sk.write_segments_json(fx.segments(spark, base), path, "m", F.md5(F.col("work_id").cast("string")))
    out = rd.read_segments_json(spark, path)
    return show(out, *KEYS, "fingerprint", "seg_no", "start", "end", "text", "no_speech_prob")


S2 = sql(
    "v_seg",
    """SELECT work_id, track_id, md5(work_id::VARCHAR) AS fingerprint, seg_no, round("start", 6) AS "start", round("end", 6) AS "end", text,
    no_speech_prob FROM v_seg""",
)


def _s3(spark, base):
    path = scratch_path(spark, "log")
    e = fx.table(spark, base, "events")
    good = F.to_json(F.struct(F.col("user_id").alias("audio"), F.col("value").alias("time"), F.col("event_type").alias("action")))
    line = F.when(F.col("event_id") % 50 == 0, "{bad").when(F.col("event_id") % 50 == 1, "").otherwise(good)
    e.select(line.alias("value")).write.text(path)
    return show(rd.read_log(spark, path, "audio bigint, time double, action string"), "audio", "time", "action")


def _s4(spark, base):
    files = rd.list_media(spark, [f"{base}/no such folder", written_lines(spark, base)], [".txt", ".TXT"])
    track = F.regexp_extract("path", r"track_id=(\d+)/", 1).cast("long")
    return files.filter("length > 0").select(track.alias("track_id")).distinct()


def _s5(recursive):
    def run(spark, base):
        clean = fx.paths(spark, base).select(F.regexp_replace("path", r"^http:/|\?.*$", "").alias("path"))
        return rd.count_media_by_dir(clean, recursive=recursive)

    return run


_P5 = r"SELECT regexp_extract(regexp_replace(path, '^http:/|\?.*$', '', 'g'), '^(.*)/[^/]*$', 1) AS dir FROM v_paths"


def rule_lines(spark, base):
    """Part rows as lines of a rule file, one form per residue."""
    n, b, k = F.col("p_name"), F.col("p_brand"), F.col("p_partkey") % 6
    line = (
        F.when(k == 0, F.concat(F.lit(" "), n, F.lit(" => "), b, F.lit("  # note")))
        .when(k == 1, F.concat(n, F.lit("->"), b))
        .when(k == 2, F.concat(n, F.lit("→"), b, F.lit("->x")))
        .when(k == 3, F.concat(F.lit("# "), n, F.lit("=>"), b))
        .when(k == 4, F.concat(F.lit("=>"), b))
        .otherwise(n)
    )
    return fx.table(spark, base, "part").select(F.col("p_partkey").alias("ord"), line.alias("line"))


S6 = """SELECT p_partkey AS ord, CASE WHEN p_partkey % 6 = 2 THEN p_name || '→' || p_brand ELSE p_name END AS a,
    CASE WHEN p_partkey % 6 = 2 THEN 'x' ELSE p_brand END AS b FROM part WHERE p_partkey % 6 < 3"""


def _s7(spark, base):
    rows = fx.lines(spark, base).withColumn("line", F.when(F.col("seg_no") % 3 == 0, F.concat(F.lit("#"), "text")).otherwise(F.col("text")))
    return rd.parse_cues(rows, KEYS, "seg_no").select(*KEYS, "nth", "regex")


S7 = sql(
    "v_lines",
    """SELECT work_id, track_id, nth, t AS regex FROM (SELECT *, count(*) OVER (PARTITION BY track_id) AS n FROM (
      SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY seg_no) AS nth FROM l) WHERE nth <= 4) WHERE n = 4""",
    l=f"""SELECT work_id, track_id, seg_no, {strip_sql('text')} AS t FROM v_lines WHERE seg_no % 3 <> 0 AND {strip_sql('text')} <> ''
      AND {strip_sql('text')} NOT LIKE '#%'""",
)


def truth_lines(spark, base):
    """Truths written as block text per work: a preface point, then each track's header and points."""
    g = fx.truth(spark, base)
    point = F.format_string("・%02d:%02d", F.floor(F.col("t") / 60), F.floor(F.col("t") % 60))
    points = g.select("work_id", (F.col("track_id") * 10**9 + F.col("truth_no") + 1).alias("line_no"), point.alias("line"))
    counts = fx.labelled(spark, base).join(g.groupBy("track_id").agg(F.count("*").alias("n")), "track_id", "left")
    heads = counts.select(
        "work_id", (F.col("track_id") * 10**9).alias("line_no"),
        F.format_string("【トラック%d】%d回", "track_id", F.coalesce("n", F.lit(0))).alias("line"),
    )
    preface = fx.labelled(spark, base).select("work_id").distinct().select("work_id", F.lit(-1).cast("long").alias("line_no"), F.lit("・00:01").alias("line"))
    return points.join(fx.labelled(spark, base).select((F.col("track_id")).alias("_t")), F.floor(F.col("line_no") / 10**9) == F.col("_t"), "left_semi").unionByName(heads).unionByName(preface)


def _truth_rows(tracks, points):
    a = tracks.select("work_id", F.col("track").cast("long").alias("track"), F.lit(None).cast("long").alias("t"))
    return a.unionByName(points.select("work_id", F.col("track").cast("long").alias("track"), F.col("t").cast("long").alias("t")))


def _s8(spark, base):
    return _truth_rows(*rd.parse_truth_blocks(truth_lines(spark, base), ["work_id"], "line_no"))


S8 = sql(
    "v_truth v_labelled",
    """SELECT work_id, track_id AS track, NULL::BIGINT AS t FROM v_labelled UNION ALL
    SELECT g.work_id, g.track_id, floor(g.t)::BIGINT FROM v_truth g SEMI JOIN v_labelled USING (track_id)""",
)


def inline_lines(spark, base):
    e = fx.table(spark, base, "events")
    stamp = lambda c: F.format_string("%02d:%02d", F.floor(c / 60), F.floor(c) % 60)
    line = F.concat(
        F.lit('"track'), F.format_string("%02d", F.col("user_id")), F.lit("_x ("), stamp(F.col("value")), F.lit(") ["), stamp(F.col("value") + 1),
        F.lit("] [ "), stamp(F.col("value") * 2), F.lit(' ]"'),
    )
    return e.select((F.col("user_id") % 10).alias("work_id"), F.col("event_id").alias("line_no"), F.when(F.col("event_id") % 3 == 0, F.lit("noise [00:10]")).otherwise(line).alias("line"))


INLINE = """SELECT work_id, track, unnest([floor(value + 1)::BIGINT, floor(value * 2)::BIGINT]) AS t FROM (
    SELECT user_id % 10 AS work_id, user_id AS track, arg_max(value, event_id) AS value FROM events WHERE event_id % 3 <> 0 GROUP BY 1, 2)"""
INLINE_ALL = f"""{INLINE} UNION ALL SELECT DISTINCT user_id % 10, user_id, NULL::BIGINT FROM events WHERE event_id % 3 <> 0"""


def _s9(spark, base):
    return _truth_rows(*rd.parse_truth_inline(inline_lines(spark, base), ["work_id"], "line_no"))


def _s10(spark, base):
    blocks = truth_lines(spark, base).filter(F.col("work_id") < 5)
    inline = inline_lines(spark, base).filter(F.col("work_id") >= 5)
    return _truth_rows(*rd.parse_truth(blocks.unionByName(inline), ["work_id"], "line_no"))


def _s11(spark, base):
    c = fx.table(spark, base, "customer")
    one = lambda i: (F.col("c_custkey") % (7 + i) / 10.0).cast("string")
    body = F.concat(
        F.lit('{"rf":{"auc":'), one(0), F.lit(',"prec":0.5,"rec":0.25,"per_work":{"w'), F.col("c_nationkey").cast("string"), F.lit('":['),
        one(1), F.lit(","), one(2), F.lit(","), one(3), F.lit(']}},"lr":{"auc":'), one(4), F.lit(',"per_work":{"w1":['), one(5), F.lit("]}}}"),
    )
    return show(rd.parse_fold_results(c.select("c_custkey", body.alias("body")), F.col("body")).drop("body"),
                "c_custkey", "method", "all_auc", "work", "auc", "prec", "rec")


S11 = """SELECT c_custkey, 'rf' AS method, (c_custkey % 7) / 1e1 AS all_auc, 'w' || c_nationkey AS work, (c_custkey % 8) / 1e1 AS auc,
    (c_custkey % 9) / 1e1 AS prec, (c_custkey % 10) / 1e1 AS rec FROM customer UNION ALL
    SELECT c_custkey, 'lr', (c_custkey % 11) / 1e1, 'w1', (c_custkey % 12) / 1e1, NULL, NULL FROM customer"""


def shouted(spark, base):
    return turns(spark, base).withColumn("translation", F.when(F.col("seg_no") % 2 == 0, F.concat(F.lit("T"), "text")).otherwise(F.lit(" ")))


def _k1(mode):
    def run(spark, base):
        header = F.concat(F.lit("a\nb"), F.col("track_id").cast("string")) if mode == "both" else None
        return sk.timed_lines(shouted(spark, base), KEYS, mode, header).select(*KEYS, "seg_no", "part", "line")

    return run


_TS = """printf('[%02d:%02d.%02d]', round("start" * 100)::BIGINT // 6000, round("start" * 100)::BIGINT // 100 % 60, round("start" * 100)::BIGINT % 100)"""
_SHOUT = f"""SELECT *, {_TS} AS ts, {strip_sql('text')} AS s, CASE WHEN seg_no % 2 = 0 THEN {strip_sql("('T' || text)")} ELSE {strip_sql('text')} END AS z FROM o"""
K1 = {
    "both": """SELECT work_id, track_id, seg_no, 0 AS part, ts || s AS line FROM z UNION ALL SELECT work_id, track_id, seg_no, 1, ts || z FROM z
      UNION ALL SELECT DISTINCT work_id, track_id, -1::BIGINT, 0, '[ti:a]' FROM z UNION ALL SELECT DISTINCT work_id, track_id, -1::BIGINT, 1, '[by:b' || track_id || ']' FROM z""",
    "translated": "SELECT work_id, track_id, seg_no, 0 AS part, ts || z AS line FROM z",
    "inline": "SELECT work_id, track_id, seg_no, 0 AS part, ts || s || ' ｜ ' || z AS line FROM z",
}


def _k2(spark, base):
    return sk.srt_blocks(shouted(spark, base), KEYS).select(*KEYS, "nth", "block")


_MS = "round({c} * 1000)::BIGINT"


def _srt(c):
    ms = _MS.format(c=c)
    return f"printf('%02d:%02d:%02d,%03d', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000)"


K2 = sql(
    "v_conv",
    f"""SELECT work_id, track_id, nth, nth || chr(10) || {_srt('"start"')} || ' --> ' || {_srt('"end"')} || chr(10) ||
      CASE WHEN seg_no % 2 = 0 THEN text || chr(10) || 'T' || text ELSE text END || chr(10) AS block
    FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY seg_no) AS nth FROM o)""",
    o=ONE_LINE,
)


def _k3(spark, base):
    docs = sk.segment_documents(fx.segments(spark, base), "m", F.lit("f"), part_rows=20)
    placed = docs.select(*KEYS, "part", F.posexplode("segments").alias("nth", "s"))
    return placed.select(*KEYS, "part", F.col("nth").cast("long").alias("nth"), "s.seg_no", F.round("s.start", 6).alias("start"), "s.text")


def _k4(spark, base):
    path = scratch_path(spark, "events")
    sk.write_events_json(events(spark, base), path)
    rows = spark.read.schema("work_id bigint, track_id bigint, rank int, cand_no bigint, t double, score double, merged int").json(path)
    return show(rows, *KEYS, "rank", "cand_no", "t", "score", "merged")


K5 = sql("v_marks", "SELECT audio, round(time, 6) AS time, action, line_no FROM v_marks WHERE line_no % 4 <> 0")


def _k5(spark, base):
    path = scratch_path(spark, "marks")
    marks = fx.marks(spark, base)
    broken = marks.withColumn("action", F.when(F.col("line_no") % 4 == 0, "???").otherwise(F.col("action")))
    for rows in (broken.filter("line_no % 2 = 0"), broken.filter("line_no % 2 = 1")):
        sk.append_log(rows, path, ["audio", "time"], {"action": ["add", "del"]})
    back = rd.read_log(spark, path, "audio bigint, time double, action string, line_no bigint")
    return show(back, "audio", "time", "action", "line_no")


def _k5_stream(spark, base):
    """The log as a stream of two files; the stream runs twice, so every batch is repeated."""
    source, path = scratch_path(spark, "marks-in"), scratch_path(spark, "marks")
    marks = fx.marks(spark, base)
    broken = marks.withColumn("action", F.when(F.col("line_no") % 4 == 0, "???").otherwise(F.col("action")))
    for k in range(2):
        broken.filter(F.col("line_no") % 2 == k).coalesce(1).write.mode("append").parquet(source)
    for _ in range(2):
        rows = file_stream(spark, source, "*.parquet", broken.schema)
        sk.append_log_stream(rows, path, scratch_path(spark, "marks-state"), ["audio", "time"], {"action": ["add", "del"]}).awaitTermination()
    back = rd.read_log(spark, path, "audio bigint, time double, action string, line_no bigint")
    return show(back, "audio", "time", "action", "line_no")


def _k6(spark, base):
    rows = fx.names(spark, base).select("item_no", F.concat(F.lit("out/"), F.col("item_no").cast("string"), F.lit(".mp3")).alias("dst"))
    return sk.output_plan(rows, rows.filter("item_no % 3 = 0")).select("item_no", "action")


def _k7(spark, base):
    p = fx.names(spark, base).withColumn("stem", F.concat("name", F.col("item_no").cast("string")))
    row = lambda ext, keep: p.filter(keep).select(
        F.concat(F.lit("in/"), "stem", F.lit(ext)).alias("src"), F.concat(F.lit("d/"), "stem", F.lit(ext)).alias("path")
    )
    subs = row(".lrc", "true").unionByName(row(".ja.lrc", "item_no % 2 = 0"))
    names = p.filter("item_no % 5 = 0").select("stem", F.concat(F.lit("new"), F.col("item_no").cast("string")).alias("new_name"))
    return sk.package_manifest(subs, row(".mp3", "item_no % 3 = 0"), row(".jpg", "item_no % 7 = 0"), names)


K7 = sql(
    "v_names",
    """SELECT 'in/' || st || ext AS src, 'd/' || CASE WHEN item_no % 5 = 0 AND kind <> 'extra' THEN 'new' || item_no ELSE st END || ext AS path, kind
    FROM (SELECT *, name || item_no AS st FROM v_names) JOIN (VALUES ('.lrc', 'subtitle', 1), ('.ja.lrc', 'subtitle', 2), ('.mp3', 'audio', 3), ('.jpg', 'extra', 7))
      v(ext, kind, step) ON item_no % step = 0""",
)

CASES = {
    "s1_read_timed_lines": Case(_s1("compare"), S1),
    "s1_read_timed_lines_player": Case(
        _s1("player"),
        sql("v_conv", f"""SELECT track_id, round("start", 6) AS t, {strip_sql('text')} AS text FROM o WHERE {strip_sql('text')} <> ''
        AND "start" < 6000""", o=ONE_LINE),
    ),
    "s1_read_timed_lines_keep": Case(_s1_keep, S1_KEEP),
    "s1_numbered_lines": Case(_s1_numbered, S1_NUMBERED),
    "s2_read_segments_json": Case(_s2, S2),
    "s3_read_log": Case(
        _s3,
        """SELECT user_id AS audio, round(value, 6) AS time, event_type AS action FROM events WHERE event_id % 50 > 1""",
    ),
    "s4_list_media": Case(_s4, "SELECT DISTINCT conv_id AS track_id FROM conversations"),
    "s5_count_media_by_dir": Case(_s5(False), sql("v_paths", "SELECT dir, count(*) AS files FROM d GROUP BY 1", d=_P5)),
    "s5_count_media_recursive": Case(
        _s5(True),
        sql(
            "v_paths",
            """SELECT array_to_string(p[1:n], '/') AS dir, count(*) AS files FROM (SELECT p, unnest(range(1, len(p) + 1)) AS n FROM (SELECT string_split(dir, '/') AS p FROM d))
            GROUP BY 1""",
            d=_P5,
        ),
    ),
    "s6_read_rules": Case(lambda s, b: rd.parse_rules(rule_lines(s, b), "ord"), S6),
    "s7_read_cues": Case(_s7, S7),
    "s8_parse_truth_blocks": Case(_s8, S8),
    "s9_parse_truth_inline": Case(_s9, INLINE_ALL),
    "s10_route_truth_format": Case(
        _s10,
        sql("v_truth v_labelled", "SELECT * FROM b WHERE work_id < 5 UNION ALL SELECT * FROM i WHERE work_id >= 5",
            b="""SELECT work_id, track_id AS track, NULL::BIGINT AS t FROM v_labelled UNION ALL
    SELECT g.work_id, g.track_id, floor(g.t)::BIGINT FROM v_truth g SEMI JOIN v_labelled USING (track_id)""", i=INLINE_ALL),
    ),
    "s11_read_fold_results": Case(_s11, S11),
    "k1_timed_lines_both": Case(_k1("both"), sql("v_conv", K1["both"], o=ONE_LINE, z=_SHOUT)),
    "k1_timed_lines_inline": Case(_k1("inline"), sql("v_conv", K1["inline"], o=ONE_LINE, z=_SHOUT)),
    "k1_timed_lines_translated": Case(_k1("translated"), sql("v_conv", K1["translated"], o=ONE_LINE, z=_SHOUT)),
    "k2_write_srt": Case(_k2, K2),
    "k3_write_segments_json": Case(
        _k3,
        sql("v_seg", """SELECT work_id, track_id, (seg_no // 20)::INTEGER AS part, row_number() OVER (PARTITION BY track_id, seg_no // 20 ORDER BY seg_no) - 1 AS nth,
          seg_no, round("start", 6) AS "start", text FROM v_seg"""),
    ),
    "k4_write_events_json": Case(
        _k4, sql("v_cand", "SELECT work_id, track_id, rank, cand_no, round(t, 6) AS t, round(score, 6) AS score, merged FROM ax", **E1)
    ),
    "k5_append_log": Case(_k5, K5),
    "k5_append_log_stream": Case(_k5_stream, K5),
    "k6_skip_existing": Case(_k6, "SELECT p_partkey AS item_no, CASE WHEN p_partkey % 3 = 0 THEN 'skip' ELSE 'write' END AS action FROM part"),
    "k7_package_manifest": Case(_k7, K7),
}
