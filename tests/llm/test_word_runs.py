"""Runs of words against all periods at all places."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from boxtide.llm.word_runs import op12_word_runs, planted, runs_of, word_runs, z_function

COLUMNS = "doc_id long, text string"


def brute(words, least=6, times=4):
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            k = i
            while k + q < len(words) and words[k] == words[k + q]:
                k += 1
            if k > i and k - i + q >= max(least, times * q):
                found.setdefault((i, k - i + q), q)
            i = k + 1
    return sorted((s, n, q) for (s, n), q in found.items())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=60))
def test_z_function(s):
    x = np.array(s)
    got = z_function(x)
    for i in range(1, len(s)):
        k = 0
        while i + k < len(s) and s[k] == s[i + k]:
            k += 1
        assert got[i] == k


@pytest.mark.parametrize("letters", [1, 2, 3, 6])
def test_runs_against_all_periods(letters):
    rng = random.Random(letters)
    for _ in range(60):
        texts = []
        for _ in range(rng.randint(1, 5)):
            words = []
            while len(words) < 150 and rng.random() < 0.9:
                unit = [rng.randrange(letters) for _ in range(rng.randint(1, 9))]
                words += unit * rng.randint(1, 9) + unit[: rng.randint(0, len(unit))]
            texts.append(words)
        first = np.r_[0, np.cumsum([len(t) for t in texts])]
        for least, times in ((6, 4), (3, 3)):
            got = runs_of(np.array([w for t in texts for w in t], np.int64), first, least, times)
            for d, words in enumerate(texts):
                assert got.get(d, []) == brute(words, least, times)


def test_two_periods_are_too_few():
    with pytest.raises(ValueError):
        runs_of(np.zeros(9, np.int64), np.array([0, 9]), 6, 2)


def test_odd_rows(spark):
    long = "la " * 400_000 + "end " + "do re mi " * 50_000
    rows = [(1, None), (2, ""), (3, " \t\n\v\f\r "), (4, "a b a b a b a b"), (4, "a b a b a b a b"), (None, "x x x x x x y"), (5, long), (6, "ab ab " * 6), (7, "a a a a a")]
    docs = spark.createDataFrame(rows, COLUMNS).selectExpr("*", "1 as runs", "'z' as collapsed", "2 as n_words")
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], bytes(r.collapsed).decode()) for r in word_runs(docs).collect()), key=str)
    ab = (4, 8, [(0, 8, 2)], "a b")
    want = [(1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), ab, ab, (None, 7, [(0, 6, 1)], "x y"), (6, 6, [(0, 6, 1)], "ab ab"), (7, 5, [], "a a a a a")]
    want.append((5, 550_001, [(0, 400_000, 1), (400_001, 150_000, 3)], "la end do re mi"))
    assert got == sorted(want, key=str)
    assert word_runs(spark.createDataFrame([], COLUMNS)).count() == 0


def test_op12_against_all_periods(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in op12_word_runs(spark, sf).collect()}
    changed = 0
    for d, text in [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]:
        words = (text or "").encode().split()
        at = planted(d, len(words))
        if at is not None:
            words, changed = [words[k] for k in at.tolist()], changed + 1
        runs = brute(words)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        r = got.pop(d)
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest()
    assert not got and changed > 10
