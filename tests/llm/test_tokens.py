"""Token counts against the library on whole texts."""

import public_tokenizers
import sentencepiece

from tests.llm.conftest import BASE
from tidemark.llm.catalog import CASES
from tidemark.llm.tokens import SEGMENT_CHARS, count_tokens, segments

PATH = public_tokenizers.path("piece_bpe_32k.model")


def plain(rows, limit=4096):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    out = {}
    for i, t in rows:
        n = len(model.encode(t or ""))
        out[i] = (len((t or "").encode()), n, n > limit)
    return out


def test_query_equals_library(spark, sample):
    assert {r[0]: tuple(r[1:]) for r in CASES["op4_token_counts"].run(spark, BASE).collect()} == plain(sample.items())


def test_odd_and_long_texts(documents):
    words = " ".join(f"wörd{i % 97} x{i}" for i in range(30_000))
    rows = {1: None, 2: "", 3: " ", 4: "  a  b ", 5: "<s>x</s> <unk> ▁a ▁ b", 6: words, 7: words.replace(" ", "  "), 8: "z" * 70_000, 9: "日本 語\n\n\ttab", 10: words.replace(" ", "\n")}
    assert {r[0]: tuple(r[1:]) for r in count_tokens(documents(rows), PATH).collect()} == plain(rows.items())


def test_repeated_rows_and_empty_table(documents):
    assert [tuple(r) for r in count_tokens(documents([(1, "a b"), (1, "a b"), (None, "c")]), PATH, limit=1).collect()] == [(1, 3, 2, True), (1, 3, 2, True), (None, 1, 1, False)]
    assert count_tokens(documents({}), PATH).collect() == []


def test_segments_lose_only_single_spaces():
    text = "ab cd  ef " * 10_000
    parts = segments(text)
    assert len(parts) > 2 and " ".join(parts) == text and max(map(len, parts)) < SEGMENT_CHARS + 20
