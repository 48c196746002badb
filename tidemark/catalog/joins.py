"""Nearest, band, semi and anti joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import fixtures as fx
from tidemark.catalog.base import Case, show, sql
from tidemark.catalog.text import CUE_SQL, CUES, DIST, TAGS_SQL, strip_sql
from tidemark.functions import names as nm
from tidemark.functions.text import normalize_text
from tidemark.operators import joins as jn

KEYS = fx.TRACK


def cand(spark, base):
    return fx.candidates(spark, base)


def _j1(spark, base):
    out = jn.nearest_text(cand(spark, base), fx.conversation_segments(spark, base), KEYS)
    return out.select(*KEYS, "cand_no", "text")


def _j1_large(spark, base):
    """Every segment twice at one time, with numbers beyond 2^53 that differ by one: the smaller number wins."""
    one = fx.conversation_segments(spark, base)
    big = lambda k, mark: one.withColumn("seg_no", F.col("seg_no") * 2 + F.lit(2**53 + k)).withColumn("text", F.concat(F.lit(mark), "text"))
    out = jn.nearest_text(cand(spark, base), big(1, "second ").unionByName(big(0, "first ")), KEYS)
    return out.select(*KEYS, "cand_no", "text")


J1_LARGE = sql(
    "v_cand v_conv",
    """SELECT c.work_id, c.track_id, c.cand_no, coalesce(n.text, '') AS text FROM v_cand c LEFT JOIN n USING (cand_no)""",
    n="""SELECT cand_no, 'first ' || arg_min(s.text, (abs(s."start" - c.t), s."start", s.seg_no)) AS text FROM v_cand c JOIN v_conv s USING (track_id)
      WHERE abs(s."start" - c.t) <= 6 GROUP BY 1""",
)


J1 = sql(
    "v_cand v_conv",
    """SELECT c.work_id, c.track_id, c.cand_no, coalesce(n.text, '') AS text FROM v_cand c LEFT JOIN n USING (cand_no)""",
    n=f"""SELECT cand_no, arg_min(s.text, (abs(s."start" - c.t), s."start", s.seg_no)) AS text FROM v_cand c JOIN v_conv s USING (track_id)
      WHERE {strip_sql('s.text')} <> '' AND abs(s."start" - c.t) <= 6 GROUP BY 1""",
)


def _j2(spark, base):
    out = jn.best_cue(cand(spark, base), fx.conversation_segments(spark, base), KEYS, CUES)
    return out.select(*KEYS, "cand_no", "cue", "cue_tags")


J2 = sql(
    "v_cand v_conv",
    """SELECT c.work_id, c.track_id, c.cand_no, coalesce(n.cue, 0)::BIGINT AS cue, coalesce(n.tags, '') AS cue_tags
    FROM v_cand c LEFT JOIN n USING (cand_no)""",
    sc=f"SELECT track_id, seg_no, \"start\", {CUE_SQL.format(t='text')} AS w, {TAGS_SQL.format(t='text')} AS tags FROM v_conv",
    n="""SELECT cand_no, max(w) AS cue, arg_min(tags, (-w, seg_no)) AS tags FROM v_cand c JOIN sc s USING (track_id)
      WHERE w > 0 AND abs(s."start" - c.t) <= 6 GROUP BY 1""",
)


def _day(col):
    return F.datediff(col, F.lit("1990-01-01").cast("date")).cast("double")


def dated(spark, base):
    """Orders as reference rows and shipments as own rows on a shared numeric key."""
    ref = fx.table(spark, base, "orders").select(
        (F.col("o_custkey") % 50).alias("track_id"), F.col("o_orderkey").alias("ref_no"), _day("o_orderdate").alias("t"),
        F.col("o_orderpriority").alias("ref_text"),
    )
    own = (
        fx.table(spark, base, "lineitem")
        .select((F.col("l_suppkey") % 50).alias("track_id"), (_day("l_shipdate") * 1.0).alias("t"), "l_orderkey", "l_linenumber",
                F.col("l_returnflag"), F.col("l_linestatus"))
    )
    own_no = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return ref, own.select("track_id", "t", own_no.alias("own_no"), F.concat("l_returnflag", "l_linestatus").alias("own_text"))


DATED = {
    "rf": """SELECT o_custkey % 50 AS track_id, o_orderkey AS ref_no, date_diff('day', DATE '1990-01-01', o_orderdate::DATE)::DOUBLE AS t,
      o_orderpriority AS ref_text FROM orders""",
    "ow": """SELECT l_suppkey % 50 AS track_id, date_diff('day', DATE '1990-01-01', l_shipdate::DATE)::DOUBLE AS t,
      l_orderkey * 8 + l_linenumber AS own_no, l_returnflag || l_linestatus AS own_text FROM lineitem""",
    "nr": """SELECT ref_no, arg_min(o.own_no, (abs(o.t - r.t), o.t, o.own_no)) AS own_no, arg_min(o.own_text, (abs(o.t - r.t), o.t, o.own_no)) AS own_text,
      arg_min(o.t - r.t, (abs(o.t - r.t), o.t, o.own_no)) AS shift FROM rf r JOIN ow o USING (track_id) GROUP BY 1""",
}


def matched(spark, base):
    ref, own = dated(spark, base)
    return jn.nearest_match(ref, own, ["track_id"], "t", "t", 3.0, "own_no", {"own_no": "own_no", "own_text": "own_text"})


def _j3(spark, base):
    return show(matched(spark, base), "track_id", "ref_no", "own_no", "shift", "matched")


def _j4(spark, base):
    ref, own = dated(spark, base)
    return jn.reverse_coverage(ref, own, ["track_id"], "t", "t", 1.0)


def _j5(spark, base):
    return matched(spark, base).filter("matched").select(
        "ref_no", "own_no", "ref_text", "own_text", F.length(normalize_text(F.col("ref_text"))).cast("long").alias("ref_len")
    )


def _j6(spark, base):
    return jn.label_candidates(cand(spark, base), fx.truth(spark, base), KEYS).select(*KEYS, "cand_no", "hit")


def _j7(spark, base):
    return show(jn.label_candidates(cand(spark, base), fx.truth(spark, base), KEYS), *KEYS, "cand_no", "dist")


MATCH = {
    "ev": "SELECT c.* FROM v_cand c SEMI JOIN v_labelled USING (track_id)",
    "gt": "SELECT g.* FROM v_truth g SEMI JOIN v_labelled USING (track_id)",
}


def matches(spark, base):
    return jn.match_events(cand(spark, base), fx.truth(spark, base), fx.labelled(spark, base), KEYS)


def _j8(spark, base):
    hits, covered = matches(spark, base)
    a = hits.select(*KEYS, F.lit("event").alias("side"), F.col("cand_no").alias("item_no"), F.col("hit").alias("flag"))
    b = covered.select(*KEYS, F.lit("truth").alias("side"), F.col("truth_no").alias("item_no"), F.col("covered").alias("flag"))
    return a.unionByName(b)


J8 = sql(
    "v_cand v_truth v_labelled",
    """SELECT work_id, track_id, 'event' AS side, cand_no AS item_no,
      EXISTS (SELECT 1 FROM gt g WHERE g.track_id = e.track_id AND abs(g.t - e.t) <= 20) AS flag FROM ev e
    UNION ALL SELECT work_id, track_id, 'truth', truth_no, EXISTS (SELECT 1 FROM ev e WHERE e.track_id = g.track_id AND abs(g.t - e.t) <= 20) FROM gt g""",
    **MATCH,
)


def _j9(spark, base):
    ours = jn.labelled_only(cand(spark, base), fx.labelled(spark, base), KEYS)
    return ours.groupBy(*KEYS).agg(F.count("*").alias("n"))


def own_labels(spark, base):
    """Candidates with value over 300 stand for labels a user set."""
    return cand(spark, base).filter("peak > 300").select(*KEYS, "t")


def finished(spark, base):
    return fx.done_log(spark, base).filter("done").select((F.col("audio") % 10).alias("work_id"), F.col("audio").alias("track_id")).distinct()


def overridden(spark, base):
    official = fx.truth(spark, base).select(*KEYS, "t")
    return jn.override_labels(official, own_labels(spark, base), finished(spark, base), KEYS)


OVERRIDE = {
    "fin": "SELECT DISTINCT audio % 10 AS work_id, audio AS track_id FROM v_done WHERE done",
    "mine": "SELECT work_id, track_id, t FROM v_cand WHERE peak > 300 AND track_id IN (SELECT track_id FROM fin)",
    "ov": """SELECT work_id, track_id, t, 'official' AS label_source FROM v_truth WHERE track_id NOT IN (SELECT track_id FROM mine)
      UNION ALL SELECT *, 'own' FROM mine""",
}


def _j10(spark, base):
    return show(overridden(spark, base), *KEYS, "t", "label_source")


def media_files(spark, base):
    """Part rows as files; some stems exist both as .wav and .mp3."""
    return fx.table(spark, base, "part").select(
        F.col("p_partkey").alias("item_no"),
        F.col("p_brand").alias("dir"),
        F.concat(F.col("p_name"), (F.col("p_size") % 5).cast("string")).alias("stem"),
        F.when(F.col("p_partkey") % 3 == 0, ".MP3").otherwise(".wav").alias("ext"),
    )


def _j11(spark, base):
    return jn.prefer_existing_twin(media_files(spark, base)).select("item_no", "state")


J11 = """WITH f AS (SELECT p_partkey AS item_no, p_brand AS dir, p_name || (p_size % 5) AS stem, p_partkey % 3 = 0 AS ready FROM part)
    SELECT item_no, CASE WHEN ready THEN 'ready' WHEN EXISTS (SELECT 1 FROM f g WHERE g.dir = f.dir AND g.stem = f.stem AND g.ready)
      THEN 'ready from twin' ELSE 'to convert' END AS state FROM f"""


def _j12(spark, base):
    marked = own_labels(spark, base)
    trained = fx.labelled(spark, base).filter(F.col("track_id") < 5)
    return jn.pending_works(finished(spark, base), marked, trained, KEYS, "work_id")


def _j13(spark, base):
    from tidemark.operators.labels import new_feedback_rows

    return new_feedback_rows(fx.feedback(spark, base), F.col("audio") % 10, ["peak", "pre30"])


J13 = sql(
    "v_feedback",
    """SELECT count(*) AS keys, count(*) FILTER (verdict IS NULL) AS undone, count(*) FILTER (verdict IS NOT NULL) AS usable,
      count(*) FILTER (verdict = 1) AS positives, round(sum(peak) FILTER (verdict IS NOT NULL), 2) AS peak_sum
    FROM (SELECT *, row_number() OVER (PARTITION BY audio, time ORDER BY line_no DESC) AS rn FROM v_feedback) WHERE rn = 1""",
)


def _j13_stats(spark, base):
    rows = _j13(spark, base)
    return rows.agg(
        F.count("*").alias("keys"),
        F.count_if(F.col("status") == "undone").alias("undone"),
        F.count_if(F.col("status") == "usable").alias("usable"),
        F.count_if(F.col("label") == 1).alias("positives"),
        F.round(F.sum(F.when(F.col("status") == "usable", F.col("peak"))), 2).alias("peak_sum"),
    )


_S13_STEM = "name || CASE WHEN item_no % 5 = 0 THEN '' ELSE '_' || item_no END"
_S13_EXACT = """CASE WHEN item_no % 2 = 0 THEN 'own' || item_no % 4 WHEN item_no % 7 < 3 THEN 'late' ELSE 'early' END"""
_S13_SUFFIX = "CASE item_no % 3 WHEN 0 THEN '.segments.json' WHEN 1 THEN '.lrc' ELSE '.ja.lrc' END"
_S13_LOOSE = "CASE WHEN item_no % 2 = 0 THEN 'early' WHEN item_no % 5 = 1 THEN 'own1' ELSE 'late' END"


def _s13(spark, base):
    names = fx.names(spark, base)
    tracks = names.selectExpr("item_no AS track_id", "'own' || item_no % 4 AS folder", f"{_S13_STEM} AS stem")
    exact = names.filter("item_no % 3 > 0").selectExpr(f"{_S13_EXACT} AS folder", f"{_S13_STEM} || {_S13_SUFFIX} AS name")
    loose = names.filter("item_no % 3 = 0").selectExpr(f"{_S13_LOOSE} AS folder", "upper(name) || 'b_' || item_no || '.segments.json' AS name")
    out = jn.locate_transcript(tracks, exact.unionByName(loose).distinct(), [".segments.json", ".lrc", ".ja.lrc"], ["early", "late"])
    return out.select("track_id", "path", "how")


S13 = sql(
    "v_names",
    f"""SELECT * FROM (SELECT t.track_id,
        coalesce((SELECT arg_min(f.folder || '/' || f.name, (CASE WHEN f.folder = t.folder THEN 0 WHEN f.folder = 'early' THEN 1 ELSE 2 END,
            CASE f.name WHEN t.stem || '.segments.json' THEN 0 WHEN t.stem || '.lrc' THEN 1 ELSE 2 END))
          FROM fl f WHERE f.folder IN (t.folder, 'early', 'late') AND f.name IN (t.stem || '.segments.json', t.stem || '.lrc', t.stem || '.ja.lrc')),
        (SELECT arg_min(f.folder || '/' || f.name, (f.folder, f.name)) FROM fl f WHERE f.folder IN ('early', 'late')
          AND ends_with(f.name, '.segments.json') AND starts_with(lower(f.name), lower(split_part(t.stem, '_', 1))))) AS path,
        CASE WHEN EXISTS (SELECT 1 FROM fl f WHERE f.folder IN (t.folder, 'early', 'late')
            AND f.name IN (t.stem || '.segments.json', t.stem || '.lrc', t.stem || '.ja.lrc')) THEN 'exact'
          WHEN EXISTS (SELECT 1 FROM fl f WHERE f.folder IN ('early', 'late') AND ends_with(f.name, '.segments.json')
            AND starts_with(lower(f.name), lower(split_part(t.stem, '_', 1)))) THEN 'prefix' ELSE 'missing' END AS how
      FROM tr t)""",
    tr=f"SELECT item_no AS track_id, 'own' || (item_no % 4) AS folder, name || CASE WHEN item_no % 5 = 0 THEN '' ELSE '_' || item_no END AS stem FROM v_names",
    fl="""SELECT DISTINCT CASE WHEN item_no % 2 = 0 THEN 'own' || (item_no % 4) WHEN item_no % 7 < 3 THEN 'late' ELSE 'early' END AS folder,
        name || CASE WHEN item_no % 5 = 0 THEN '' ELSE '_' || item_no END || CASE item_no % 3 WHEN 0 THEN '.segments.json' WHEN 1 THEN '.lrc' ELSE '.ja.lrc' END AS name
      FROM v_names WHERE item_no % 3 > 0
      UNION SELECT CASE WHEN item_no % 2 = 0 THEN 'early' WHEN item_no % 5 = 1 THEN 'own1' ELSE 'late' END,
        upper(name) || 'b_' || item_no || '.segments.json' FROM v_names WHERE item_no % 3 = 0""",
)


def _s14(spark, base):
    files = fx.table(spark, base, "lineitem").select(
        (F.col("l_suppkey") % 10).alias("work_id"), (F.col("l_partkey") % 400).alias("track_id"),
        F.concat(F.lit("f/"), F.repeat(F.lit("x/"), F.col("l_linenumber")), F.col("l_orderkey").cast("string")).alias("path"),
        F.when(F.col("l_partkey") % 4 == 1, F.col("l_quantity")).otherwise(F.lit(5.0)).cast("long").alias("size"),
    ).filter(F.col("work_id") < 7)
    wanted = fx.table(spark, base, "part").select(
        (F.col("p_partkey") % 10).alias("work_id"), (F.col("p_partkey") % 400).alias("track_id")
    ).distinct()
    return jn.match_files_by_track(wanted, files, KEYS).select(*KEYS, "copies", "status", "path")


S14 = """WITH f AS (SELECT l_suppkey % 10 AS work_id, l_partkey % 400 AS track_id, 'f/' || repeat('x/', l_linenumber) || l_orderkey AS path,
      CASE WHEN l_partkey % 4 = 1 THEN l_quantity ELSE 5 END::BIGINT AS size FROM lineitem WHERE l_suppkey % 10 < 7),
    w AS (SELECT DISTINCT p_partkey % 10 AS work_id, p_partkey % 400 AS track_id FROM part),
    g AS (SELECT work_id, track_id, count(*) AS copies, count(DISTINCT size) AS sizes, arg_min(path, (size, length(path), path)) AS p FROM f GROUP BY 1, 2)
    SELECT w.work_id, w.track_id, coalesce(copies, 0) AS copies, CASE WHEN copies IS NULL THEN 'missing' WHEN sizes = 1 THEN 'matched' ELSE 'ambiguous' END AS status,
      CASE WHEN sizes = 1 THEN p END AS path FROM w LEFT JOIN g USING (work_id, track_id)"""

CASES = {
    "j1_nearest_text": Case(_j1, J1),
    "j1_nearest_text_large_ids": Case(_j1_large, J1_LARGE),
    "j2_best_cue": Case(_j2, J2),
    "j3_nearest_match": Case(
        _j3,
        sql(
            "",
            """SELECT track_id, ref_no, own_no, round(shift, 6) + 0.0 AS shift, coalesce(abs(shift) <= 3, false) AS matched
            FROM rf LEFT JOIN nr USING (ref_no)""",
            **DATED,
        ),
    ),
    "j4_reverse_coverage": Case(
        _j4,
        sql(
            "",
            """SELECT count(*) AS own_rows, count(*) FILTER (EXISTS (SELECT 1 FROM rf WHERE rf.track_id = ow.track_id AND abs(rf.t - ow.t) <= 1))
            AS covered_rows FROM ow""",
            **DATED,
        ),
    ),
    "j5_paired_text": Case(
        _j5,
        sql(
            "",
            r"""SELECT ref_no, own_no, ref_text, own_text, length(regexp_replace(ref_text, '[\s\-]+', '', 'g')) AS ref_len
            FROM rf JOIN nr USING (ref_no) WHERE abs(shift) <= 3""",
            **DATED,
        ),
    ),
    "j6_label_candidates": Case(
        _j6, sql("v_cand v_truth", "SELECT work_id, track_id, cand_no, coalesce(dist <= 20, false) AS hit FROM d", d=DIST)
    ),
    "j7_distance_to_truth": Case(
        _j7, sql("v_cand v_truth", "SELECT work_id, track_id, cand_no, round(dist, 6) AS dist FROM d", d=DIST)
    ),
    "j8_match_events": Case(_j8, J8),
    "j9_labelled_only": Case(
        _j9, sql("v_cand v_truth v_labelled", "SELECT work_id, track_id, count(*) AS n FROM ev GROUP BY 1, 2", **MATCH)
    ),
    "j10_override_labels": Case(
        _j10,
        sql("v_cand v_truth v_done", "SELECT work_id, track_id, round(t, 6) AS t, label_source FROM ov", **OVERRIDE),
    ),
    "j11_prefer_existing_twin": Case(_j11, J11),
    "j12_pending_retrain": Case(
        _j12,
        sql(
            "v_cand v_done v_labelled",
            """SELECT DISTINCT work_id FROM fin WHERE track_id IN (SELECT track_id FROM v_cand WHERE peak > 300)
            AND work_id NOT IN (SELECT work_id FROM v_labelled WHERE track_id < 5)""",
            fin=OVERRIDE["fin"],
        ),
    ),
    "j13_new_feedback_rows": Case(_j13_stats, J13),
    "s13_locate_transcript": Case(_s13, S13),
    "s14_match_files_by_track_no": Case(_s14, S14),
}
