"""Removal of repeated spans against a plain table of windows."""

import hashlib
import random
import re

import pytest

from tests.check import compare, duck
from tests.llm.conftest import BASE
from tidemark.llm.catalog import CASES
from tidemark.llm.substrings import SuffixAutomaton, earlier_windows, remove_repeats


def plain(rows, window=20):
    words = {i: re.findall(r"[^\x20\x09-\x0d]+", t or "") for i, t in rows}
    first = {}
    for i in sorted(words):
        for s in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][s : s + window]), (i, s))
    out = {}
    for i, own in words.items():
        gone = set()
        for s in range(len(own) - window + 1):
            if first[tuple(own[s : s + window])] < (i, s):
                gone.update(range(s, s + window))
        kept = " ".join(w for k, w in enumerate(own) if k not in gone)
        out[i] = (len(own), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def found(df, **options):
    return {r[0]: tuple(r[1:]) for r in remove_repeats(df, digest=True, **options).collect()}


def mixed_texts():
    rng = random.Random(3)
    text = lambda n, v: [f"w{rng.randrange(v)}" for _ in range(n)]
    bases = [text(rng.randrange(120), 6) for _ in range(8)]
    rows = {}
    for i in range(120):
        t = list(bases[i % 8])
        if i % 3 == 0:
            t = t[rng.randrange(30) :] + text(30, 5)
        if i % 5 == 0:
            t = t + t
        if i % 7 == 0:
            t = ["a"] * rng.randrange(80) + t
        if i % 11 == 0:
            t = (["x", "y", "z"] * 30)[: rng.randrange(90)]
        rows[i] = ("\n\t" if i % 2 else " ").join(t)
    return rows | {900: None, 901: "", 902: " \n ", 903: "é " * 45, 904: "é " * 30, 905: "long " * 3000}


@pytest.mark.parametrize("shard", [1024, 3])
def test_equals_plain_rule(documents, shard):
    rows = mixed_texts()
    assert found(documents(rows), shard=shard) == plain(rows.items())


def test_query_equals_plain_rule(spark, sample):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in CASES["op1_substrings"].run(spark, BASE).collect()}
    assert got == plain(sample.items())


def test_query_equals_sql(spark):
    assert compare(duck(BASE), CASES["op1_substrings"].run(spark, BASE), CASES["op1_substrings"].sql) is None


def test_texts_come_back_shortened(documents):
    passage = " ".join(f"p{i}" for i in range(25))
    df = documents({1: f"first\n\n{passage} end", 2: f"other  start {passage}\tlast  words", 3: None, 4: "short  text "})
    out = remove_repeats(df)
    assert out.columns == df.columns and all(r.rest == "x" for r in out.collect())
    assert {r.doc_id: r.text for r in out.collect()} == {1: f"first\n\n{passage} end", 2: "other  start last  words", 3: None, 4: "short  text "}


def test_null_and_repeated_keys(documents):
    text = " ".join(f"q{i}" for i in range(30))
    got = remove_repeats(documents([(None, text), (5, text), (5, text), (6, text)]), digest=True).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 0), (5, 0), (5, 0), (6, 30)]


def test_empty_table(documents):
    assert found(documents({})) == {}


def test_automaton_knows_every_run():
    rng = random.Random(1)
    for _ in range(40):
        words = [rng.choice("abc") for _ in range(25)]
        automaton = SuffixAutomaton()
        for w in words:
            automaton.extend(w)
        runs = {tuple(words[i:j]) for i in range(25) for j in range(i + 1, 26)}
        probe = [rng.choice("abc") for _ in range(25)]
        state = length = 0
        for k, w in enumerate(probe):
            state, length = automaton.follow(state, length, w)
            best = max((n for n in range(k + 2) if n == 0 or tuple(probe[k + 1 - n : k + 1]) in runs), default=0)
            assert length == best


def test_windows_of_pieces():
    rng = random.Random(2)
    for _ in range(30):
        pieces = [[rng.choice("ab") for _ in range(rng.randrange(4, 12))] for _ in range(6)]
        seen, want = set(), []
        for p in pieces:
            own = []
            for i in range(len(p) - 3):
                own.append(tuple(p[i : i + 4]) in seen)
                seen.add(tuple(p[i : i + 4]))
            want.append(own)
        assert earlier_windows(pieces, 4) == want
