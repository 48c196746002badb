"""How a query is registered, rounding helpers, and the SQL form of the fixture views."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Case(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def r6(c: str | Column) -> Column:
    """Six decimals without negative zero, as both engines compare."""
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, 6) + F.lit(0.0)


def nudged(c: str) -> Column:
    """Rounding for values that can sit exactly on a half."""
    return r6(F.col(c) + F.lit(1e-9)).alias(c)


def show(df: DataFrame, *cols: str, **computed: Column) -> DataFrame:
    """Select columns, rounding every double."""
    out = df.select(*cols, *[c.alias(n) for n, c in computed.items()])
    return out.select(
        *[r6(f.name).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in out.schema]
    )


VIEWS = {
    "v_base": """SELECT l_suppkey % 10 AS work_id, l_suppkey AS track_id, l_extendedprice AS price,
        row_number() OVER (PARTITION BY l_suppkey
          ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS idx FROM lineitem""",
    "v_frames": "SELECT work_id, track_id, idx, 1e1 * log10(price * price) AS level FROM v_base",
    "v_samples": "SELECT work_id, track_id, idx, price / 1e5 AS x FROM v_base",
    "v_cand": """SELECT user_id % 10 AS work_id, user_id AS track_id, event_id AS cand_no,
        (epoch_us(ts) - 1704067200000000) / 3.6e9 AS t, value / 5e2 AS score, value AS peak,
        (event_id * 7919 % 1000) / 1e3 AS ref_score FROM events WHERE event_type <> 'purchase'""",
    "v_truth": """SELECT user_id % 10 AS work_id, user_id AS track_id, event_id AS truth_no,
        (epoch_us(ts) - 1704067200000000) / 3.6e9 AS t FROM events WHERE event_type = 'purchase' AND value >= 100""",
    "v_labelled": "SELECT DISTINCT user_id % 10 AS work_id, user_id AS track_id FROM events WHERE user_id % 7 <> 3",
    "v_lines": """SELECT track_id % 10 AS work_id, track_id, seg_no, text FROM (
        SELECT doc_id AS track_id, unnest(range(len(string_split(text, chr(10))))) AS seg_no,
               unnest(string_split(text, chr(10))) AS text FROM documents)""",
    "v_turns": "SELECT conv_id % 10 AS work_id, conv_id AS track_id, turn AS seg_no, text FROM conversations",
    "v_seg": "{timed:v_lines}",
    "v_conv": "{timed:v_turns}",
    "v_marks": """SELECT user_id AS audio, round(value, 0) AS time,
        CASE WHEN event_type = 'click' THEN 'add' ELSE 'del' END AS action, event_id AS line_no
        FROM events WHERE event_type IN ('click', 'error')""",
    "v_done": """SELECT user_id AS audio, event_id % 2 = 0 AS done, event_id AS line_no
        FROM events WHERE event_type = 'signup'""",
    "v_feedback": """SELECT user_id AS audio, round(value / 10, 0) AS time,
        CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 IN (1, 2) THEN 0 ELSE 1 END AS verdict,
        value AS peak, event_id AS line_no FROM events""",
    "v_intervals": """SELECT o_custkey % 200 AS track_id, o_orderkey AS item_no,
        date_diff('day', DATE '1990-01-01', o_orderdate::DATE) AS "start",
        date_diff('day', DATE '1990-01-01', o_orderdate::DATE) + 1 + o_orderkey % 9 AS "end" FROM orders""",
    "v_names": "SELECT p_partkey AS item_no, p_name AS name FROM part",
    "v_paths": "SELECT page_id AS item_no, url AS path FROM pages",
}
_NEEDS = {"v_frames": ["v_base"], "v_samples": ["v_base"], "v_seg": ["v_lines"], "v_conv": ["v_turns"]}
_TIMED = """SELECT work_id, track_id, seg_no, begin_ticks / 1e2 AS "start", (begin_ticks + length(text) * 10) / 1e2 AS "end",
        text, '' AS translation, (seg_no % 10) / 1e1 AS no_speech_prob, -(seg_no % 7) / 1e1 AS avg_logprob, '' AS text_raw
        FROM (SELECT *, coalesce(sum(length(text) * 10 + CASE seg_no % 3 WHEN 0 THEN 20 WHEN 1 THEN 50 ELSE 150 END)
          OVER (PARTITION BY track_id ORDER BY seg_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT
          AS begin_ticks FROM {source})"""


def sql(views: str, body: str, **ctes: str) -> str:
    """``WITH`` the named fixture views, then further CTEs in the given order, then the body."""
    parts: dict[str, str] = {}

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        text = VIEWS[name]
        if text.startswith("{timed:"):
            text = _TIMED.format(source=text[7:-1])
        parts.setdefault(name, text)

    for name in views.split():
        add(name)
    parts.update(ctes)
    if not parts:
        return body
    import re

    def form(name: str, text: str) -> str:
        walks = re.search(rf"\b{name}\b", text)
        return f"{name} AS {'' if walks else 'MATERIALIZED '}({text})"

    return "WITH RECURSIVE " + ",\n".join(form(n, t) for n, t in parts.items()) + "\n" + body
