"""Periodic runs against all periods of all stretches."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tests.llm.conftest import BASE
from tidemark.llm.catalog import CASES
from tidemark.llm.periods import WaveletMatrix, find_runs, planted, run_digest


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


def plain_runs(x, least_length=6, least_exponent=4):
    """Every maximal stretch of a period, unless a smaller period covers it too."""
    out, n = set(), len(x)
    for q in range(1, n // least_exponent + 1):
        i = 0
        while i < n - q:
            if x[i] != x[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and x[j] == x[j + q]:
                j += 1
            start, length = i, j - i + q
            if length >= max(least_length, least_exponent * q) and all(
                any(x[k] != x[k + r] for k in range(start, start + length - r)) for r in range(1, q)
            ):
                out.add((start, length, q))
            i = j
    return sorted(out)


def plain_planted(key, text):
    x = words_of(text)
    if key is None or not x or (h := zlib.crc32(str(key).encode())) % 10:
        return x
    g, n = h // 10, len(x)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [x[i] if i < a else x[a + (i - a) % p] for i in range(n)]


def plain_row(x):
    runs = plain_runs(x)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(w for k, w in enumerate(x) if k not in gone)
    return len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(lines), sha(kept)


COLUMNS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_successors_equal_a_scan():
    rng = np.random.default_rng(1)
    for n in (1, 2, 63, 64, 65, 700):
        values = rng.permutation(3 * n)[:n].astype(np.int64)
        tree = WaveletMatrix(values, 3 * n)
        low = rng.integers(0, n, 300)
        high = np.minimum(n, low + rng.integers(0, n + 1, 300))
        bound = rng.integers(0, 3 * n + 3, 300)
        want = [min((v for v in values[a:b] if v >= c), default=-1) for a, b, c in zip(low, high, bound)]
        assert tree.successor(low, high, bound).tolist() == want


def random_texts(rng, n):
    texts = {}
    for k in range(n):
        x = []
        while rng.random() < 0.8 or not x:
            period = [rng.choice("abc") * rng.randrange(1, 3) for _ in range(rng.randrange(1, 14))]
            turns = rng.randrange(1, 8)
            x += (period * turns)[: len(period) * turns - rng.randrange(len(period))]
        texts[k] = rng.choice([" ", "\n ", "\t"]).join(x)
    return texts


@pytest.mark.parametrize("seed", range(4))
def test_random_texts_equal_all_periods(documents, seed):
    texts = random_texts(random.Random(seed), 150)
    got = {r.doc_id: ([tuple(x) for x in r.runs], r.collapsed, r.n_words) for r in find_runs(documents(texts)).collect()}
    for k, text in texts.items():
        x = words_of(text)
        runs = plain_runs(x)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert got[k] == (runs, " ".join(w for i, w in enumerate(x) if i not in gone), len(x))


def test_long_and_regular_texts(documents):
    fibonacci = ["a", "ab"]
    while len(fibonacci[-1]) < 400:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    morse = "a"
    while len(morse) < 500:
        morse += morse.translate(str.maketrans("ab", "ba"))
    texts = {0: " ".join(fibonacci[-1]), 1: " ".join(morse), 2: " ".join(["x"] * 300), 3: " ".join(list("abcdefg" * 40) + list("abcdefh" * 40)), 4: " ".join("aab" * 5 + "b" * 9)}
    got = {r.doc_id: [tuple(x) for x in r.runs] for r in find_runs(documents(texts)).collect()}
    assert got == {k: plain_runs(t.split()) for k, t in texts.items()}
    # far too long for all periods: one period of 5000 words, 9 times, among words that never repeat
    own = [f"p{k}" for k in range(5000)]
    long = [f"b{k}" for k in range(777)] + own * 9 + own[:17] + [f"e{k}" for k in range(60000)] + ["z"] * 200_000
    row = find_runs(documents({0: " ".join(long)})).first()
    assert [tuple(x) for x in row.runs] == [(777, 45017, 5000), (777 + 45017 + 60000, 200_000, 1)]
    assert row.collapsed == " ".join(long[: 777 + 5000] + long[777 + 45017 : 777 + 45017 + 60000] + ["z"])


def test_query_equals_plain_rule(spark, sample):
    short = {k: t for k, t in sample.items() if len(words_of(t)) < 700}
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in CASES["op11_runs"].run(spark, BASE).collect()}
    assert set(got) == set(sample)
    assert any(got[k][0] for k in short)
    for k, text in short.items():
        assert got[k] == plain_row(plain_planted(k, text)), k


def test_planted_texts(spark, sample, documents):
    rows = [*sample.items(), (None, "a a a a a a a"), (-7, ""), (2**62, " x  y "), (5, None)]
    got = planted(documents(rows)).collect()
    want = [plain_planted(k, t) for k, t in rows]
    assert sorted(((r.doc_id is None, r.doc_id or 0, words_of(r.text)) for r in got)) == sorted((k is None, k or 0, w) for (k, _), w in zip(rows, want))


def test_odd_rows(documents):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a a a a a"), (5, "a a a a a a"), (5, "a a a a a a"), (None, "b b b b b b"), (6, "ü ü ü ü ü ü ü ü")]
    found = find_runs(documents(rows))
    assert found.columns == ["doc_id", "n_words", "runs", "collapsed"]
    got = sorted(((r.doc_id or 0), [tuple(x) for x in r.runs], r.collapsed) for r in found.collect())
    assert got == [
        (0, [(0, 6, 1)], "b"), (1, [], ""), (2, [], ""), (3, [], ""), (4, [], "a a a a a"), (5, [(0, 6, 1)], "a"), (5, [(0, 6, 1)], "a"),
        (6, [(1, 6, 1)], "ü ü ü"),
    ]
    digest = {r.doc_id: r for r in run_digest(found).collect()}
    assert digest[1].start is None and digest[1].exponent_milli is None and digest[1].runs_sha256 == hashlib.sha256(b"").hexdigest()
    assert digest[5].exponent_milli == 6000
    assert find_runs(documents({})).collect() == []
    with pytest.raises(ValueError):
        find_runs(documents({}), least_exponent=3)


def test_ties_take_the_first_run(documents):
    row = run_digest(find_runs(documents({0: "a b a b a b a b x c d c d c d c d y z z z z z z"}))).first()
    assert (row.n_runs, row.start, row.length, row.period, row.exponent_milli) == (3, 18, 6, 1, 6000)
    row = run_digest(find_runs(documents({0: "a b a b a b a b x c d c d c d c d"}))).first()
    assert (row.n_runs, row.start, row.length, row.period, row.exponent_milli) == (2, 0, 8, 2, 4000)
