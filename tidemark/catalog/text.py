"""Projections, predicates and scalar rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import fixtures as fx
from tidemark.catalog.base import Case, show, sql
from tidemark.functions import names as nm
from tidemark.functions import scores as sc
from tidemark.functions import text as tx
from tidemark.operators import segments as sg
from tidemark.plans.nearest import nearest

KEYS = fx.TRACK
NOISE = [tx.NOISE_LATIN, tx.NOISE_PUNCTUATION]
RULES = [("the ", "THE-"), ("THE-", "a "), ("ou", "oo")]
CUES = [("exclaim", "!", 2), ("done", "ed\\b", 2), ("count", "[0-9]", 1), ("negative", "non|not", -3)]


def strip_sql(x):
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


NOISE_SQL = r"""(regexp_matches(t, '^[A-Za-z0-9\s\.\,\!\?''"-]+$') OR regexp_matches(t, '^[、。．，！？!?…‥・ー\s]+$'))"""
F1_SQL = f"""SELECT * EXCLUDE (t) FROM (SELECT *, {strip_sql('text')} AS t FROM v_seg)
    WHERE t <> '' AND NOT ({NOISE_SQL} AND (greatest("end" - "start", 0) < 2.5 OR no_speech_prob > 0.35))"""


def seg(spark, base):
    return fx.segments(spark, base)


def of_seg(**cols):
    return lambda spark, base: show(seg(spark, base), *KEYS, "seg_no", **cols)


def seg_sql(select):
    return sql("v_seg", f"SELECT work_id, track_id, seg_no, {select} FROM v_seg")


def _f1(spark, base):
    return show(sg.drop_noise_segments(seg(spark, base), NOISE), *KEYS, "seg_no", "start", "text")


def _f3(spark, base):
    return sg.apply_fixes(seg(spark, base), RULES).select(*KEYS, "seg_no", "text", "translation", "text_raw")


F3 = sql(
    "v_seg",
    """SELECT work_id, track_id, seg_no, n AS text, '' AS translation, CASE WHEN n <> text THEN text ELSE '' END AS text_raw
    FROM (SELECT *, replace(replace(replace(text, 'the ', 'THE-'), 'THE-', 'a '), 'ou', 'oo') AS n FROM v_seg)""",
)


def _f4(spark, base):
    labelled = F.concat(F.lit(' 译文： "'), F.col("text"), F.lit('” '))
    return of_seg(line=tx.clean_line(labelled))(spark, base)


F4 = seg_sql(
    f"""regexp_replace(regexp_replace({strip_sql("'" + '"' + "' || text || '”'")}, '^"+|"+$', '', 'g'), '^[“”]+|[“”]+$', '', 'g') AS line"""
)


def _turns(spark, base):
    words = F.regexp_replace("text", r'["\\\s]+', " ")
    return fx.table(spark, base, "conversations").select("conv_id", "turn", "role", words.alias("words"))


def _f5(spark, base):
    body = F.concat(
        F.lit('answer: [{"i":1,"zh":"'), F.col("words"), F.lit('"},{"text":"'), F.col("role"), F.lit('"},"x"] end')
    )
    n = F.when(F.col("turn") % 3 == 0, 2).otherwise(3)
    parsed = F.array_join(tx.parse_aligned_array(body, n), "|")
    return _turns(spark, base).select("conv_id", "turn", parsed.alias("items"))


F5 = f"""SELECT conv_id, turn, CASE WHEN turn % 3 <> 0 THEN {strip_sql("regexp_replace(text, '[" + '"' + chr(92) * 3 + "s]+', ' ', 'g')")}
    || '|' || role || '|x' END AS items FROM conversations"""


def _f6(spark, base):
    docs = fx.spread(fx.table(spark, base, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.md5(tx.normalize_text(F.col("text"))).alias("digest"))


def _f6_full(spark, base):
    docs = fx.spread(fx.table(spark, base, "documents").select("doc_id", "text"))
    mixed = F.concat("text", F.lit("ﬁ①Ⅷ㍿ｶﾞＡ…"))
    return docs.select("doc_id", F.md5(tx.normalize_nfkc(mixed)).alias("digest"))


F6 = r"""SELECT doc_id, md5(regexp_replace(text, '[\s、。，．！？!?…‥・「」『』（）()【】\[\]〜~ー―—\-]+', '', 'g')) AS digest FROM documents"""
F6_FULL = F6.replace("regexp_replace(text,", "regexp_replace(text || 'fi1VIII株式会社ガA...',")


def _wide_name(name="name"):
    return F.translate(name, "aeio", "ａｅｉｏ")


def _f7(spark, base):
    return fx.names(spark, base).select("item_no", tx.fold_width(_wide_name()).alias("folded"))


def _f8(spark, base):
    number = (F.col("item_no") % 20).cast("string")
    original = F.when(F.col("item_no") % 3 == 0, F.concat(F.lit("第"), number, F.lit("章 "), F.col("name"))).otherwise(
        F.concat(number, F.lit(" "), F.col("name"))
    )
    new = F.when(F.col("item_no") % 2 == 0, F.concat(F.lit("x "), number, F.lit("y "), F.col("name"))).otherwise(F.col("name"))
    return fx.names(spark, base).select("item_no", tx.keep_numeric_prefix(original, new).alias("kept"))


F8 = sql(
    "v_names",
    """SELECT item_no, CASE WHEN position(p IN substr(n, 1, length(p) + 4)) > 0 THEN n ELSE p || ' ' || n END AS kept FROM (
      SELECT item_no, CASE WHEN item_no % 3 = 0 THEN '第' || (item_no % 20) || '章' ELSE (item_no % 20)::VARCHAR END AS p,
        CASE WHEN item_no % 2 = 0 THEN 'x ' || (item_no % 20) || 'y ' || name ELSE name END AS n FROM v_names)""",
)


def _f9(spark, base):
    broken = F.concat(F.lit("「『"), F.col("name"), F.when(F.col("item_no") % 2 == 0, "』").otherwise("（"))
    return fx.names(spark, base).select("item_no", tx.balance_brackets(broken).alias("balanced"))


F9 = sql(
    "v_names",
    """SELECT item_no, '「『' || name || CASE WHEN item_no % 2 = 0 THEN '』」' ELSE '（』」）' END AS balanced FROM v_names""",
)

_RAW_NAME = [
    lambda n, i: F.concat(F.lit(' "1. '), n, F.lit('." ')),
    lambda n, i: F.concat(F.lit("０１『"), n, F.lit("　:x?")),
    lambda n, i: F.lit("con.txt"),
    lambda n, i: F.repeat(n, 20),
    lambda n, i: F.lit(" .. "),
]


def _f10(spark, base):
    which = F.col("item_no") % len(_RAW_NAME)
    raw = F.lit(None).cast("string")
    for i, make in enumerate(_RAW_NAME):
        raw = F.when(which == i, make(F.col("name"), i)).otherwise(raw)
    return fx.names(spark, base).select("item_no", nm.safe_name(raw).alias("safe"))


F10 = sql(
    "v_names",
    """SELECT item_no, CASE item_no % 5 WHEN 0 THEN name WHEN 1 THEN '01『' || name || ' x』' WHEN 2 THEN '_con.txt'
      WHEN 3 THEN left(repeat(name, 20), 120) ELSE 'unnamed' END AS safe FROM v_names""",
)


def _f11(spark, base):
    return sg.dedupe_names(fx.names(spark, base), "item_no", "name").select("item_no", "unique_name")


def _f11_cross(spark, base):
    """Every seventh name already carries a number, so generated names can collide with given ones."""
    tagged = F.when(F.col("item_no") % 7 == 0, F.concat(F.col("name"), F.lit(" (3)"))).otherwise(F.col("name"))
    rows = fx.names(spark, base).withColumn("name", tagged)
    out = sg.dedupe_names(rows, "item_no", "name")
    return out.agg(F.count("*").alias("n"), F.countDistinct("unique_name").alias("distinct_names"))


def _f12(spark, base):
    p = F.col("path")
    as_track = F.regexp_replace(p, r"page=", "track_")
    return fx.paths(spark, base).select(
        "item_no",
        nm.work_key(p, r"//([a-z]+)\.").alias("work"),
        nm.track_key(as_track).alias("track"),
        nm.track_number(as_track).alias("track_no"),
    )


F12 = sql(
    "v_paths",
    r"""SELECT item_no, regexp_extract(path, '//([a-z]+)\.', 1) AS work,
      CASE WHEN length(d) = 1 THEN '0' || d ELSE d END AS track, TRY_CAST(nullif(x, '') AS INTEGER) AS track_no
    FROM (SELECT *, CASE WHEN regexp_extract(q, '(?i)track[_\-\s]*(\d+)', 1) <> '' THEN regexp_extract(q, '(?i)track[_\-\s]*(\d+)', 1)
      ELSE regexp_extract(q, '(\d+)', 1) END AS d, regexp_extract(q, '(?i)(?:tr|track)[_\-\s]*(\d+)', 1) AS x
    FROM (SELECT *, replace(path, 'page=', 'track_') AS q FROM v_paths))""",
)

_CS = 'greatest(round("start" * 100), 0)::BIGINT'
_MS = 'round("start" * 1000)::BIGINT'


def _f16(spark, base):
    size = F.pow(F.col("o_totalprice"), 1 + F.col("o_orderkey") % 3)
    return fx.table(spark, base, "orders").select(F.col("o_orderkey").alias("item_no"), nm.human_size(F.floor(size)).alias("size"))


F16 = """SELECT o_orderkey AS item_no, CASE WHEN b < 1024 THEN printf('%.1f B', b) WHEN b < 1048576 THEN printf('%.1f KB', b / 1024)
    WHEN b < 1073741824 THEN printf('%.1f MB', b / 1048576) WHEN b < 1099511627776 THEN printf('%.1f GB', b / 1073741824)
    ELSE printf('%.1f TB', b / 1099511627776) END AS size
    FROM (SELECT o_orderkey, floor(pow(o_totalprice, 1 + o_orderkey % 3)) AS b FROM orders)"""


def _f18(spark, base):
    total, tags = tx.cue_score(F.col("text"), CUES)
    return fx.lines(spark, base).select(
        *KEYS, F.col("seg_no").cast("long").alias("seg_no"), total.cast("long").alias("cue"), F.array_join(tags, ",").alias("tags")
    )


CUE_SQL = """(CASE WHEN regexp_matches({t}, '!') THEN 2 ELSE 0 END + CASE WHEN regexp_matches({t}, 'ed\\b') THEN 2 ELSE 0 END
    + CASE WHEN regexp_matches({t}, '[0-9]') THEN 1 ELSE 0 END - CASE WHEN regexp_matches({t}, 'non|not') THEN 3 ELSE 0 END)"""
TAGS_SQL = """concat_ws(',', CASE WHEN regexp_matches({t}, '!') THEN 'exclaim' END, CASE WHEN regexp_matches({t}, 'ed\\b') THEN 'done' END,
    CASE WHEN regexp_matches({t}, '[0-9]') THEN 'count' END, CASE WHEN regexp_matches({t}, 'non|not') THEN 'negative' END)"""
F18 = sql(
    "v_lines",
    f"SELECT work_id, track_id, seg_no, {CUE_SQL.format(t='text')}::BIGINT AS cue, {TAGS_SQL.format(t='text')} AS tags FROM v_lines",
)


def of_cand(**cols):
    return lambda spark, base: show(fx.candidates(spark, base), *KEYS, "cand_no", **cols)


def cand_sql(select):
    return sql("v_cand", f"SELECT work_id, track_id, cand_no, {select} FROM v_cand")


def _f22(spark, base):
    odd = F.when(F.col("cand_no") % 4 == 0, F.lit(float("nan"))).when(F.col("cand_no") % 4 == 1, F.lit(float("-inf"))).when(
        F.col("cand_no") % 4 == 2, F.lit(None)
    )
    value = F.when(F.col("cand_no") % 4 == 3, F.col("score")).otherwise(odd.cast("double"))
    return of_cand(value=sc.finite_or_zero(value))(spark, base)


def conversions(spark, base):
    """Order rows read as results of file conversions."""
    k = F.col("o_orderkey")
    src = F.floor(F.col("o_totalprice") * 100).cast("long")
    return fx.table(spark, base, "orders").select(
        k.alias("item_no"),
        F.col("o_custkey").alias("track_id"),
        F.concat(F.lit("in/"), k.cast("string"), F.lit(".wav")).alias("src"),
        F.element_at(F.array(*map(F.lit, ["wav", "flac", "mp3"])), (k % 3 + 1).cast("int")).alias("codec"),
        (k % 13 != 0).alias("ok"),
        (k % 7 == 0).alias("skipped"),
        src.alias("src_bytes"),
        F.when(k % 11 == 0, F.lit(0)).otherwise(F.floor(src / (2 + k % 9))).cast("long").alias("dst_bytes"),
        (F.when(k % 2 == 0, 22050).otherwise(44100)).alias("in_rate"),
        (F.when(k % 5 == 0, 44100).when(k % 2 == 0, 22050).otherwise(44100)).alias("out_rate"),
        (F.when(k % 3 == 0, 320).otherwise(128)).alias("nominal"),
        ((k % 100) / F.lit(10.0)).alias("elapsed"),
    )


CONVERSIONS = """SELECT o_orderkey AS item_no, 'in/' || o_orderkey || '.wav' AS src, ['wav', 'flac', 'mp3'][(o_orderkey % 3 + 1)::INTEGER] AS codec,
    o_orderkey % 13 <> 0 AS ok, o_orderkey % 7 = 0 AS skipped, floor(o_totalprice * 100)::BIGINT AS src_bytes,
    CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE floor(o_totalprice * 100)::BIGINT // (2 + o_orderkey % 9) END AS dst_bytes,
    CASE WHEN o_orderkey % 2 = 0 THEN 22050 ELSE 44100 END AS in_rate,
    CASE WHEN o_orderkey % 5 = 0 THEN 44100 WHEN o_orderkey % 2 = 0 THEN 22050 ELSE 44100 END AS out_rate,
    CASE WHEN o_orderkey % 3 = 0 THEN 320 ELSE 128 END AS nominal, (o_orderkey % 100) / 1e1 AS elapsed FROM orders"""
FLAGS = """SELECT *, CASE WHEN dst_bytes > 0 THEN src_bytes / dst_bytes::DOUBLE ELSE 0 END AS ratio,
    CASE WHEN in_rate <> out_rate THEN 'resampled:' || in_rate || '->' || out_rate
      WHEN out_rate <= 24000 AND nominal > 160 THEN 'capped:' || nominal || '->160' ELSE '' END AS note FROM cv"""


def _f23(spark, base):
    rows = sc.conversion_flags(conversions(spark, base))
    return show(rows.withColumn("note", F.array_join("notes", ";")), "item_no", "ratio", "note", "resampled", "capped", "lossless")


F23 = sql(
    "",
    """SELECT item_no, round(ratio, 6) AS ratio, note, note LIKE 'resampled%' AS resampled, note LIKE 'capped%' AS capped,
    codec IN ('wav', 'flac') AS lossless FROM fl""",
    cv=CONVERSIONS,
    fl=FLAGS,
)


def _f24(spark, base):
    p = F.regexp_replace(F.col("path"), r"\?.*$", ".v1.wav")
    return fx.paths(spark, base).select("item_no", nm.mirror_path(p, "http://ththre.example.com", "/out", ".mp3").alias("target"))


F24 = sql(
    "v_paths",
    r"""SELECT item_no, '/out/' || regexp_replace(CASE WHEN starts_with(p, 'http://ththre.example.com/') THEN substr(p, 27)
      ELSE regexp_extract(p, '([^/]*)$', 1) END, '^(.*/)?([^/]+?)(\.[^./]*)?$', '\1\2') || '.mp3' AS target
    FROM (SELECT item_no, regexp_replace(path, '\?.*$', '.v1.wav') AS p FROM v_paths)""",
)


def _f25(spark, base):
    rows = fx.names(spark, base)
    files = rows.select(
        "item_no",
        F.concat(F.lit("d/"), F.col("name"), F.when(F.col("item_no") % 2 == 0, ".ja.lrc").otherwise(".lrc")).alias("path"),
    )
    table = rows.select(F.col("name").alias("stem")).distinct().filter(F.length("stem") % 2 == 0)
    return sg.rename_with_map(files, "path", table.withColumn("new_name", F.upper("stem"))).select("item_no", "renamed")


F25 = sql(
    "v_names",
    """SELECT item_no, 'd/' || CASE WHEN length(name) % 2 = 0 THEN upper(name) ELSE name END
    || CASE WHEN item_no % 2 = 0 THEN '.ja.lrc' ELSE '.lrc' END AS renamed FROM v_names""",
)


def _f26(spark, base):
    terms = F.when(F.col("seg_no") % 2 == 0, F.concat(F.lit("a->"), F.col("track_id").cast("string"))).otherwise("")
    plain = tx.build_prompt(F.col("text"), "P:", terms, "H", "G:")
    forced = tx.build_prompt(F.col("text"), "P:", terms, "H", force=True)
    return of_seg(prompt=F.md5(plain), forced=F.md5(forced))(spark, base)


F26 = seg_sql(
    """md5(CASE WHEN seg_no % 2 = 0 THEN 'H' || chr(10) || 'a->' || track_id || chr(10) || 'G:' || text ELSE 'P:' || text END) AS prompt,
    md5('H' || chr(10) || CASE WHEN seg_no % 2 = 0 THEN 'a->' || track_id ELSE '' END || chr(10) || 'P:' || text) AS forced"""
)


def _f27(spark, base):
    return sg.glossary_rules(fx.segments(spark, base), KEYS, "seg_no").select(*KEYS, "seg_no", "nth")


F27 = sql(
    "v_seg",
    f"""SELECT work_id, track_id, seg_no, nth FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY seg_no) AS nth
    FROM (SELECT *, {strip_sql('text')} AS t FROM v_seg) WHERE t <> '' AND t NOT LIKE '#%') WHERE nth <= 40""",
)


def tracks(spark, base):
    rows = fx.segments(spark, base)
    return rows.groupBy(*KEYS).agg(F.max("end").alias("duration"), F.count("*").alias("n"))


def _f28(spark, base):
    from tidemark.operators.signal import duration_status

    return show(duration_status(tracks(spark, base), "duration"), *KEYS, "duration", "status")


F28 = sql(
    "v_seg",
    """SELECT work_id, track_id, round(max("end"), 6) AS duration, CASE WHEN max("end") < 3 THEN 'too short'
    WHEN max("end") < 60 THEN 'under one minute' ELSE 'ok' END AS status FROM v_seg GROUP BY 1, 2""",
)


def with_distance(spark, base):
    return nearest(fx.candidates(spark, base), fx.truth(spark, base), KEYS, "t", "t", {"truth_no": "truth_no"}, tie="truth_no")


DIST = """SELECT c.*, d.dist FROM v_cand c LEFT JOIN (SELECT c.cand_no, min(abs(c.t - g.t)) AS dist FROM v_cand c
    JOIN v_truth g USING (track_id) GROUP BY 1) d USING (cand_no)"""


def _f29(spark, base):
    d = F.col("dist")
    return show(
        with_distance(spark, base),
        *KEYS,
        "cand_no",
        weight=sc.distance_weight(d, d <= 20, 5.0),
        target=sc.soft_target(d, 5.0),
    )


def dist_sql(select):
    return sql("v_cand v_truth", f"SELECT work_id, track_id, cand_no, {select} FROM d", d=DIST)


def _f30(spark, base):
    return show(with_distance(spark, base), *KEYS, "cand_no", label=sc.hard_label(F.col("dist"), 20.0).cast("long"))


def _f31(spark, base):
    return show(sc.blend_scores(fx.candidates(spark, base), "work_id", "score", "ref_score", 0.7), *KEYS, "cand_no", "blended")


F31 = sql(
    "v_cand",
    """SELECT work_id, track_id, cand_no, round(7e-1 * (score - min(score) OVER w) / greatest(1e-9, max(score) OVER w - min(score) OVER w)
    + (1 - 7e-1) * (ref_score - min(ref_score) OVER w) / greatest(1e-9, max(ref_score) OVER w - min(ref_score) OVER w), 6) AS blended
    FROM v_cand WINDOW w AS (PARTITION BY work_id)""",
)

CASES = {
    "f1_drop_noise_segments": Case(
        _f1, sql("v_seg", 'SELECT work_id, track_id, seg_no, round("start", 6) AS "start", text FROM kept', kept=F1_SQL)
    ),
    "f2_segment_duration": Case(
        lambda s, b: show(seg(s, b), *KEYS, "seg_no", dur=sg.duration()),
        seg_sql('round(greatest("end" - "start", 0), 6) AS dur'),
    ),
    "f3_apply_fixes": Case(_f3, F3),
    "f4_clean_line": Case(_f4, F4),
    "f5_parse_aligned_array": Case(_f5, F5),
    "f6_normalize_text": Case(_f6, F6),
    "f6_normalize_nfkc": Case(_f6_full, F6_FULL),
    "f7_fold_width": Case(_f7, sql("v_names", "SELECT item_no, name AS folded FROM v_names")),
    "f8_keep_numeric_prefix": Case(_f8, F8),
    "f9_balance_brackets": Case(_f9, F9),
    "f10_safe_name": Case(_f10, F10),
    "f11_dedupe_names": Case(
        _f11,
        sql(
            "v_names",
            """SELECT item_no, CASE WHEN n = 1 THEN name ELSE name || ' (' || n || ')' END AS unique_name
            FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY item_no) AS n FROM v_names)""",
        ),
    ),
    "f11_dedupe_names_cross": Case(_f11_cross, "SELECT count(*) AS n, count(*) AS distinct_names FROM part"),
    "f12_work_and_track_key": Case(_f12, F12),
    "f13_format_ts": Case(
        lambda s, b: show(seg(s, b), *KEYS, "seg_no", ts=nm.format_ts(F.col("start"))),
        seg_sql(f"printf('[%02d:%02d.%02d]', {_CS} // 6000, {_CS} // 100 % 60, {_CS} % 100) AS ts"),
    ),
    "f14_format_srt_ts": Case(
        lambda s, b: show(seg(s, b), *KEYS, "seg_no", ts=nm.format_srt_ts(F.col("start"))),
        seg_sql(f"printf('%02d:%02d:%02d,%03d', {_MS} // 3600000, {_MS} // 60000 % 60, {_MS} // 1000 % 60, {_MS} % 1000) AS ts"),
    ),
    "f15_format_mmss": Case(
        lambda s, b: show(seg(s, b), *KEYS, "seg_no", mmss=nm.format_mmss(F.col("start"))),
        seg_sql("""printf('%02d:%02d', floor("start")::BIGINT // 60, floor("start")::BIGINT % 60) AS mmss"""),
    ),
    "f16_human_size": Case(_f16, F16),
    "f17_format_sec": Case(
        lambda s, b: show(seg(s, b), *KEYS, "seg_no", took=nm.format_sec(F.col("start"))),
        seg_sql(
            """CASE WHEN round_even("start", 0) >= 60 THEN printf('%d分%02d秒', round_even("start", 0)::BIGINT // 60,
            round_even("start", 0)::BIGINT % 60) ELSE printf('%d秒', round_even("start", 0)::BIGINT) END AS took"""
        ),
    ),
    "f18_cue_score": Case(_f18, F18),
    "f19_confidence_band": Case(
        lambda s, b: show(fx.candidates(s, b), *KEYS, "cand_no", band=sc.band(F.col("score") * 5, sc.BANDS_SCORE)),
        cand_sql("CASE WHEN score * 5 >= 2.5 THEN 'high' WHEN score * 5 >= 1.5 THEN 'mid' ELSE 'low' END AS band"),
    ),
    "f20_confidence_band_prob": Case(
        lambda s, b: show(fx.candidates(s, b), *KEYS, "cand_no", band=sc.band(F.col("ref_score"), sc.BANDS_PROBABILITY)),
        cand_sql("CASE WHEN ref_score >= 6e-1 THEN 'high' WHEN ref_score >= 3e-1 THEN 'mid' ELSE 'low' END AS band"),
    ),
    "f21_formula_score": Case(
        lambda s, b: show(
            fx.candidates(s, b), *KEYS, "cand_no", formula=sc.formula_score(F.col("score"), F.col("ref_score"), F.col("peak"))
        ),
        cand_sql(
            """round((score + 0.25) / 7.702 - (ref_score - 1.173) / 0.889 + 0.5 * (peak - 0.28) / 0.694, 6) AS formula"""
        ),
    ),
    "f22_finite_or_zero": Case(_f22, cand_sql("CASE WHEN cand_no % 4 = 3 THEN round(score, 6) ELSE 0e0 END AS value")),
    "f23_conversion_flags": Case(_f23, F23),
    "f24_mirror_path": Case(_f24, F24),
    "f25_rename_with_map": Case(_f25, F25),
    "f26_build_prompt": Case(_f26, F26),
    "f27_glossary_rules": Case(_f27, F27),
    "f28_min_duration_gate": Case(_f28, F28),
    "f29_distance_weight": Case(
        _f29,
        dist_sql(
            """round(CASE WHEN dist <= 20 THEN exp(-pow(dist / 5e0, 2)) ELSE 1e0 END, 6) AS weight,
            round(coalesce(exp(-pow(dist / 5e0, 2)), 0e0), 6) AS target"""
        ),
    ),
    "f30_hard_label": Case(_f30, dist_sql("CASE WHEN dist <= 20 THEN 1 ELSE 0 END::BIGINT AS label")),
    "f31_blend_scores": Case(_f31, F31),
}
