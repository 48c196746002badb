"""Snapshot collapse against its SQL twin and a plain rule."""

from tests.check import compare, duck
from tests.llm.conftest import BASE
from tidemark.llm.catalog import CASES
from tidemark.llm.chat import maximal_conversations, render_chat

SCHEMA = "conv_id long, turn long, role string, text string, whole string, digest string"


def frame(spark, chats):
    rows = [(c, t, r, x, "w", "d") for c, turns in chats.items() for t, r, x in turns]
    return spark.createDataFrame(rows, SCHEMA)


def test_query_equals_sql(spark):
    assert compare(duck(BASE), CASES["op3_chat"].run(spark, BASE), CASES["op3_chat"].sql) is None


def test_prefixes_copies_and_odd_rows(spark):
    a, b, c = (0, "user", "hi"), (1, "assistant", "hello"), (2, "user", "bye")
    chats = {1: [a], 2: [b, a], 3: [a, b, c], 4: [c, b, a], 5: [a, (1, "assistant", "no")], 6: [(0, None, None)], 7: [(None, "user", "x"), a], 8: [b], None: [a]}
    got = {r.conv_id: (r.n_turns, r.n_logged) for r in render_chat(frame(spark, chats)).collect()}
    assert got == {3: (3, 2), 5: (2, 1), 6: (1, 1), 7: (2, 1), 8: (1, 1)}


def test_rows_logged_twice_count_once(spark):
    a, b = (0, "user", "hi"), (1, "assistant", "hello")
    assert [tuple(r) for r in maximal_conversations(frame(spark, {1: [a, a, b], 2: [a, b]})).collect()] == [(1, 2)]


def test_rendering(spark):
    row = render_chat(frame(spark, {1: [(0, "user", "a <|im_end|> b"), (1, "assistant", "x" * 100_000)]})).collect()[0]
    assert row.rendered == f"<|im_start|>user\na < |im_end|> b<|im_end|>\n<|im_start|>assistant\n{'x' * 100_000}<|im_end|>\n"


def test_long_chain_and_empty_table(spark):
    turns = [(i, "user", str(i)) for i in range(300)]
    got = maximal_conversations(frame(spark, {i: turns[: i + 1] for i in range(0, 300, 25)} | {999: turns})).collect()
    assert [tuple(r) for r in got] == [(999, 1)]
    assert render_chat(frame(spark, {})).collect() == []
