"""Ordered shaping of text segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import fixtures as fx
from tidemark.catalog.base import Case, nudged, show, sql
from tidemark.catalog.text import F1_SQL, NOISE, RULES, strip_sql, tracks
from tidemark.functions import text as tx
from tidemark.operators import segments as sg

KEYS = fx.TRACK
ENDS = sg.SENTENCE_ENDS + "."
MAX = 60
GAP = 0.8


def seg(spark, base):
    return fx.segments(spark, base)


def runs_sql(source, limit=3):
    return f"""SELECT * EXCLUDE (t, p, isl, nth) FROM (SELECT *, row_number() OVER (PARTITION BY track_id, isl ORDER BY seg_no) AS nth
      FROM (SELECT *, sum(CASE WHEN t = p AND t <> '' THEN 0 ELSE 1 END) OVER (PARTITION BY track_id ORDER BY seg_no) AS isl
        FROM (SELECT *, lag(t) OVER (PARTITION BY track_id ORDER BY seg_no) AS p FROM (SELECT *, {strip_sql('text')} AS t FROM {source}))))
      WHERE nth <= {limit}"""


def merge_ctes(source, gap=GAP, max_chars=MAX):
    """Left-to-right merge as a recursive walk over row numbers."""
    numbered = f"""SELECT * EXCLUDE (text), {strip_sql('text')} AS text, row_number() OVER (PARTITION BY track_id ORDER BY seg_no) AS rn
        FROM {source}"""
    walk = f"""SELECT track_id, rn, 1::BIGINT AS grp, length(text) AS size, "end" AS stop FROM mnum WHERE rn = 1
        UNION ALL SELECT n.track_id, n.rn,
          CASE WHEN n."start" - w.stop <= {gap}::DOUBLE AND w.size + length(n.text) <= {2 * max_chars} THEN w.grp ELSE n.rn END,
          CASE WHEN n."start" - w.stop <= {gap}::DOUBLE AND w.size + length(n.text) <= {2 * max_chars} THEN w.size + length(n.text)
            ELSE length(n.text) END, n."end" FROM mwalk w JOIN mnum n ON n.track_id = w.track_id AND n.rn = w.rn + 1"""
    merged = """SELECT work_id, track_id, min(seg_no) AS seg_no, min("start") AS "start", max("end") AS "end",
        string_agg(text, '' ORDER BY rn) AS text, arg_min(translation, rn) AS translation, arg_min(no_speech_prob, rn) AS no_speech_prob,
        arg_min(avg_logprob, rn) AS avg_logprob, arg_min(text_raw, rn) AS text_raw
        FROM mnum JOIN mwalk USING (track_id, rn) GROUP BY work_id, track_id, grp"""
    return {"mnum": numbered, "mwalk": walk, "merged": merged}


def _pieces(text, max_chars, level):
    """SQL list expression of the pieces of ``text`` from separator tier ``level`` on."""
    marks = ["([。！？!?…‥.])", "([、，,])", "(\\s)"]
    if level == 3:
        return (
            f"list_transform(range(0, length({text}), {max_chars}), lambda i{level}: substr({text}, i{level}::INTEGER + 1, {max_chars}))"
        )
    p, acc = f"p{level}", f"a{level}"
    parts = (
        f"list_filter(string_split(regexp_replace({text}, '{marks[level]}', '\\1' || chr(1), 'g'), chr(1)), "
        f"lambda {p}: trim({p}, ' ' || chr(9) || chr(13)) <> '')"
    )
    item = f"{p}.open"
    trimmed = strip_sql(item)
    deeper = _pieces(trimmed, max_chars, level + 1)
    closed = f"(CASE WHEN {acc}.open = '' THEN {acc}.done ELSE list_append({acc}.done, {acc}.open) END)"
    body = (
        f"CASE WHEN length({acc}.open) + length({item}) <= {max_chars} THEN {{'done': {acc}.done, 'open': {acc}.open || {item}}} "
        f"WHEN length({item}) > {max_chars} THEN {{'done': list_concat({closed}, "
        f"CASE WHEN length({trimmed}) <= {max_chars} THEN [{trimmed}] ELSE {deeper} END), 'open': ''}} "
        f"ELSE {{'done': {closed}, 'open': {item}}} END"
    )
    packed = (
        f"list_reduce(list_prepend({{'done': []::VARCHAR[], 'open': ''}}, list_transform({parts}, "
        f"lambda q{level}: {{'done': []::VARCHAR[], 'open': q{level}}})), lambda {acc}, {p}: {body})"
    )
    flat = f"list_transform([{packed}], lambda z{level}: CASE WHEN z{level}.open = '' THEN z{level}.done ELSE list_append(z{level}.done, z{level}.open) END)[1]"
    return (
        f"CASE WHEN len({parts}) <= 1 THEN {_pieces(text, max_chars, level + 1)} "
        f"ELSE list_filter({flat}, lambda y{level}: trim(y{level}, ' ' || chr(9) || chr(13)) <> '') END"
    )


def pieces_sql(source, max_chars=MAX):
    return f"""SELECT *, CASE WHEN whole = '' THEN []::VARCHAR[] WHEN length(whole) <= {max_chars} THEN [whole]
      ELSE {_pieces('whole', max_chars, 0)} END AS parts FROM (SELECT *, {strip_sql('text')} AS whole FROM {source})"""


def resplit_ctes(source, max_chars=MAX):
    one = """SELECT *, list_aggregate(list_transform(parts, lambda c: length(c)), 'sum')::BIGINT AS total FROM pcs"""
    flat = """SELECT *, unnest(parts) AS c, unnest(range(len(parts))) AS piece FROM tot WHERE len(parts) > 1"""
    stop = """CASE WHEN {raw} - {cur} < 0.05 THEN least(f."end", {cur} + 5e-2) ELSE {raw} END"""
    raw0 = """(CASE WHEN f.piece = len(f.parts) - 1 THEN f."end" ELSE least(f."end", f."start" + (f."end" - f."start") * length(f.c) / f.total) END)"""
    raw1 = """(CASE WHEN f.piece = len(f.parts) - 1 THEN f."end" ELSE least(f."end", w.stop + (f."end" - f."start") * length(f.c) / f.total) END)"""
    walk = f"""SELECT f.track_id, f.seg_no, f.piece, f."start" AS cur, {stop.format(raw=raw0, cur='f."start"')} AS stop
        FROM flt f WHERE f.piece = 0 UNION ALL SELECT f.track_id, f.seg_no, f.piece, w.stop,
        {stop.format(raw=raw1, cur='w.stop')} FROM rwalk w JOIN flt f ON f.track_id = w.track_id AND f.seg_no = w.seg_no AND f.piece = w.piece + 1"""
    resplit = f"""SELECT f.work_id, f.track_id, f.seg_no, w.cur AS "start", w.stop AS "end", {strip_sql('f.c')} AS text, '' AS translation,
        f.no_speech_prob, f.avg_logprob, '' AS text_raw, f.piece FROM flt f JOIN rwalk w USING (track_id, seg_no, piece)
        UNION ALL SELECT work_id, track_id, seg_no, "start", "end", text, translation, no_speech_prob, avg_logprob, text_raw, 0
        FROM tot WHERE len(parts) <= 1"""
    return {"pcs": pieces_sql(source, max_chars), "tot": one, "flt": flat, "rwalk": walk, "rsp": resplit}


def _g1(spark, base):
    return sg.limit_runs(seg(spark, base), KEYS, 1).select(*KEYS, "seg_no", "text")


def _g2(spark, base):
    merged = sg.merge_close_segments(seg(spark, base), KEYS, GAP, MAX)
    return show(merged, *KEYS, "seg_no", "start", "end", "text", "no_speech_prob")


G2_COLUMNS = """SELECT work_id, track_id, seg_no, round("start", 6) AS "start", round("end", 6) AS "end", text,
    round(no_speech_prob, 6) AS no_speech_prob FROM merged"""


def _g2_blank_runs(spark, base):
    """Most segments blank, in long runs that close no group."""
    rows = seg(spark, base).withColumn("text", F.when(F.col("seg_no") % 25 < 2, F.col("text")).otherwise(F.lit(" ")))
    merged = sg.merge_close_segments(rows, KEYS, 100.0, MAX)
    return show(merged, *KEYS, "seg_no", "start", "end", "text", "no_speech_prob")


BLANK_RUNS = "SELECT * REPLACE (CASE WHEN seg_no % 25 < 2 THEN text ELSE ' ' END AS text) FROM v_seg"


def _g3(spark, base):
    return sg.explode_pieces(seg(spark, base), MAX, ENDS).select(*KEYS, "seg_no", "piece", "part")


def _g4(spark, base):
    rows = sg.resplit_segments(seg(spark, base), KEYS, MAX, sentence_ends=ENDS)
    return rows.select(*KEYS, "seg_no", "piece", nudged("start"), nudged("end"), "text", "no_speech_prob", "translation")


def parts(spark, base):
    """Every four segments stand for one recognised chunk with chunk-relative times."""
    chunk = F.floor(F.col("seg_no") / 4)
    rows = seg(spark, base).withColumn("chunk", chunk)
    limits = rows.groupBy(*KEYS, "chunk").agg(F.min("start").alias("chunk_start"), F.max("end").alias("chunk_end"))
    scale = F.when(F.col("chunk") % 3 == 0, 1.0).otherwise(0.5)
    return rows.join(limits, [*KEYS, "chunk"]).select(
        *KEYS, "chunk", "seg_no", "chunk_start", "chunk_end", "text",
        ((F.col("start") - F.col("chunk_start")) * scale).alias("start"),
        ((F.col("end") - F.col("chunk_start")) * scale).alias("end"),
    )


def _g5(spark, base):
    return show(sg.allot_time_by_chars(parts(spark, base), KEYS, "chunk", "seg_no"), *KEYS, "chunk", "seg_no", "start", "end", "text")


G5 = sql(
    "v_seg",
    """SELECT work_id, track_id, chunk, seg_no, t AS text,
      round(CASE WHEN n = 1 THEN lo WHEN own THEN lo + s ELSE lo + (hi - lo) * (done - length(t)) / total END, 6) + 0.0 AS "start",
      round(CASE WHEN n = 1 THEN hi WHEN own THEN least(hi, lo + e) ELSE least(hi, lo + (hi - lo) * done / total) END, 6) + 0.0 AS "end"
    FROM (SELECT *, bool_and(e >= s) OVER w AND arg_max(e, seg_no) OVER w > 0.6 * (hi - lo) AS own, count(*) OVER w AS n,
      sum(length(t)) OVER w AS total, sum(length(t)) OVER (PARTITION BY track_id, chunk ORDER BY seg_no) AS done
      FROM pt WINDOW w AS (PARTITION BY track_id, chunk))""",
    ch=f"""SELECT *, {strip_sql('text')} AS t, seg_no // 4 AS chunk, min("start") OVER (PARTITION BY track_id, seg_no // 4) AS lo,
      max("end") OVER (PARTITION BY track_id, seg_no // 4) AS hi FROM v_seg""",
    pt="""SELECT *, ("start" - lo) * CASE WHEN chunk % 3 = 0 THEN 1e0 ELSE 5e-1 END AS s,
      ("end" - lo) * CASE WHEN chunk % 3 = 0 THEN 1e0 ELSE 5e-1 END AS e FROM ch WHERE t <> ''""",
)


def _g6(spark, base):
    rows = sg.clean_pipeline(seg(spark, base), KEYS, NOISE, RULES, 1, GAP, MAX, ENDS)
    return rows.select(*KEYS, "seg_no", "piece", nudged("start"), nudged("end"), "text", "text_raw")


_MERGE = merge_ctes("runs")
G6 = sql(
    "v_seg",
    """SELECT work_id, track_id, seg_no, piece, round("start" + 1e-9, 6) AS "start", round("end" + 1e-9, 6) AS "end", n AS text,
      CASE WHEN n <> text THEN text ELSE text_raw END AS text_raw
    FROM (SELECT *, replace(replace(replace(text, 'the ', 'THE-'), 'THE-', 'a '), 'ou', 'oo') AS n FROM rsp)""",
    f1=F1_SQL,
    runs=runs_sql("f1", 1),
    **_MERGE,
    **resplit_ctes("merged"),
)


def batches(spark, base):
    return sg.make_batches(seg(spark, base), KEYS, 8, 600)


def _g7(spark, base):
    return batches(spark, base).select(*KEYS, "seg_no", "batch_no")


BATCH = {
    "bnum": "SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY seg_no) - 1 AS rn FROM v_seg",
    "bwalk": """SELECT track_id, rn, 0::BIGINT AS batch_no, 1 AS cnt, length(text) AS size FROM bnum WHERE rn = 0
      UNION ALL SELECT n.track_id, n.rn, CASE WHEN w.cnt >= 8 OR w.size + length(n.text) > 600 THEN n.rn ELSE w.batch_no END,
        CASE WHEN w.cnt >= 8 OR w.size + length(n.text) > 600 THEN 1 ELSE w.cnt + 1 END,
        CASE WHEN w.cnt >= 8 OR w.size + length(n.text) > 600 THEN length(n.text) ELSE w.size + length(n.text) END
      FROM bwalk w JOIN bnum n ON n.track_id = w.track_id AND n.rn = w.rn + 1""",
}


def _g8(spark, base):
    """A translator that loses a line whenever it gets more than five, so every longer batch is halved."""

    def shout(lines):
        if len(lines) > 5:
            return lines[:-1]
        return ["【" + x + "】" for x in lines]

    rows = sg.batched_apply(batches(spark, base), KEYS, shout)
    return rows.select(*KEYS, "seg_no", "translation")


def _g9(spark, base):
    rows = seg(spark, base)
    cache = rows.filter(F.col("seg_no") % 2 == 0).select(
        *KEYS, "seg_no", "text", F.concat(F.lit("old "), F.col("text")).alias("translation"),
        F.when(F.col("track_id") % 3 == 0, "A").when(F.col("track_id") % 3 == 1, "B").alias("fingerprint"),
    )
    out = sg.incremental_apply(
        rows, cache, KEYS, F.lit("A"), lambda todo: todo.withColumn("translation", F.concat(F.lit("new "), F.col("text")))
    )
    return out.select(*KEYS, "seg_no", "translation", "source")


def _g9_duplicates(spark, base):
    """Several cached rows of a segment: one with the fingerprint, one with another or none, one blank."""
    rows = seg(spark, base)
    cached = rows.filter(F.col("seg_no") % 2 == 0)
    mark = lambda m, t: cached.select(*KEYS, "seg_no", "text", F.concat(F.lit(t), F.col("text")).alias("translation"), F.lit(m).cast("string").alias("fingerprint"))
    blank = mark("A", "").withColumn("translation", F.lit(" "))
    cache = mark("B", "other ").unionByName(mark("A", "old ").filter("track_id % 3 = 0")).unionByName(mark(None, "plain ").filter("track_id % 3 < 2")).unionByName(blank)
    out = sg.incremental_apply(
        rows, cache, KEYS, F.lit("A"), lambda todo: todo.withColumn("translation", F.concat(F.lit("new "), F.col("text")))
    )
    return out.select(*KEYS, "seg_no", "translation", "source")


G9_DUPLICATES = sql(
    "v_seg",
    f"""SELECT work_id, track_id, seg_no, CASE source WHEN 'blank' THEN '' WHEN 'computed' THEN 'new ' || text WHEN 'reused' THEN 'old ' || text
      ELSE 'plain ' || text END AS translation, source FROM (SELECT *, CASE WHEN {strip_sql('text')} = '' THEN 'blank'
        WHEN seg_no % 2 = 0 AND track_id % 3 = 0 THEN 'reused' WHEN seg_no % 2 = 0 AND track_id % 3 = 1 THEN 'reused without fingerprint'
        ELSE 'computed' END AS source FROM v_seg)""",
)


G9 = sql(
    "v_seg",
    f"""SELECT work_id, track_id, seg_no, CASE source WHEN 'blank' THEN '' WHEN 'computed' THEN 'new ' || text ELSE 'old ' || text END
      AS translation, source FROM (SELECT *, CASE WHEN {strip_sql('text')} = '' THEN 'blank'
        WHEN seg_no % 2 = 0 AND track_id % 3 = 0 THEN 'reused' WHEN seg_no % 2 = 0 AND track_id % 3 = 2 THEN 'reused without fingerprint'
        ELSE 'computed' END AS source FROM v_seg)""",
)


def _g10(spark, base):
    translated = F.when(F.col("seg_no") % 2 == 0, F.concat(F.lit("T "), F.col("text"))).otherwise(F.lit("  "))
    return seg(spark, base).select(*KEYS, "seg_no", tx.fallback_text(translated, F.col("text")).alias("shown"))


def _g11(spark, base):
    longer = tracks(spark, base).withColumn("duration", F.col("duration") * (1 + F.col("track_id") % 4))
    return show(sg.timestamp_health(seg(spark, base), KEYS, longer), *KEYS, "duration", "last_end", "suspect")


CASES = {
    "g1_limit_runs": Case(_g1, sql("v_seg", "SELECT work_id, track_id, seg_no, text FROM runs", runs=runs_sql("v_seg", 1))),
    "g2_merge_close_segments": Case(_g2, sql("v_seg", G2_COLUMNS, **merge_ctes("v_seg"))),
    "g2_merge_blank_runs": Case(_g2_blank_runs, sql("v_seg", G2_COLUMNS, br=BLANK_RUNS, **merge_ctes("br", 100.0))),
    "g3_split_text": Case(
        _g3,
        sql(
            "v_seg",
            "SELECT work_id, track_id, seg_no, unnest(range(len(parts))) AS piece, unnest(parts) AS part FROM pcs",
            pcs=pieces_sql("v_seg"),
        ),
    ),
    "g4_resplit_segments": Case(
        _g4,
        sql(
            "v_seg",
            """SELECT work_id, track_id, seg_no, piece, round("start" + 1e-9, 6) AS "start", round("end" + 1e-9, 6) AS "end", text,
            no_speech_prob, translation FROM rsp""",
            **resplit_ctes("v_seg"),
        ),
    ),
    "g5_allot_time_by_chars": Case(_g5, G5),
    "g6_clean_pipeline": Case(_g6, G6),
    "g7_make_batches": Case(
        _g7, sql("v_seg", "SELECT work_id, track_id, seg_no, batch_no FROM bnum JOIN bwalk USING (track_id, rn)", **BATCH)
    ),
    "g8_batched_apply": Case(
        _g8,
        sql("v_seg", "SELECT work_id, track_id, seg_no, '【' || text || '】' AS translation FROM v_seg"),
    ),
    "g9_incremental_apply": Case(_g9, G9),
    "g9_incremental_apply_duplicates": Case(_g9_duplicates, G9_DUPLICATES),
    "g10_fallback_text": Case(
        _g10,
        sql(
            "v_seg",
            f"""SELECT work_id, track_id, seg_no, CASE WHEN seg_no % 2 = 0 THEN {strip_sql("('T ' || text)")}
            ELSE {strip_sql('text')} END AS shown FROM v_seg""",
        ),
    ),
    "g11_timestamp_health": Case(
        _g11,
        sql(
            "v_seg",
            """SELECT work_id, track_id, round(d * (1 + track_id % 4), 6) AS duration, round(d, 6) AS last_end,
            d * (1 + track_id % 4) > 5 AND d < 0.5 * d * (1 + track_id % 4) AS suspect
            FROM (SELECT work_id, track_id, max("end") AS d FROM v_seg GROUP BY 1, 2)""",
        ),
    ),
}
