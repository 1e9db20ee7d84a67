"""Suffix orders against sorting, and removal of repeated strings against all strings of all texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from boxtide.llm import suffix_dedup
from boxtide.session import checkpoint
from boxtide.llm.suffix_dedup import Sampler, dedup_substrings, op11_suffix_dedup, repeated_offsets, suffix_order

COLUMNS = "doc_id long, text string"


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 5).flatmap(lambda k: st.lists(st.integers(1, k), max_size=60)), st.integers(1, 4))
def test_suffix_order(symbols, times):
    s = symbols * times + [0]
    assert suffix_order(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_repeated_offsets_against_counting():
    rng = random.Random(3)
    for _ in range(100):
        width, reach, left, right = 12, 8, [], []
        for _ in range(rng.randint(1, 9)):
            x = bytes(rng.choice(b"ab\0") for _ in range(rng.randint(4, 24)))
            p = rng.randint(0, min(reach, len(x) - 4))
            left.append(x[:p])
            right.append(x[p : p + width])
        n = np.array([rng.choice([1, 1, 1, 2]) for _ in left])
        got = repeated_offsets(left, right, n, width, reach)
        for d in range(reach + 1):
            strings = [x[len(x) - d :] + y[: width - d] if len(x) >= d and len(y) >= width - d else None for x, y in zip(left, right)]
            many = Counter()
            for s, k in zip(strings, n):
                many[s] += k
            assert [s is not None and many[s] > 1 for s in strings] == got[d].tolist()


def test_equal_strings_share_a_seed():
    rng = np.random.default_rng(4)
    x = rng.integers(97, 100, 3000).astype(np.uint8).tobytes()
    sampler = Sampler(200, 32)
    one, _ = sampler(x)
    assert np.diff(one).max() <= 169 and len(one) < 80
    two, _ = sampler(b"other words before " + x[500:900] + b" and after")
    for s in range(500, 701):
        assert {p - s for p in one if s <= p <= s + 168} & {p - 19 - (s - 500) for p in two if s - 481 <= p <= s - 481 + 168}
    assert len(sampler(b"a" * 5000)[0]) == 4969


def brute(rows, width):
    texts = [(d, (t or "").encode()) for d, t in rows]
    many = Counter(t[i : i + width] for _, t in texts for i in range(len(t) - width + 1))
    for d, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - width + 1):
            if many[t[i : i + width]] > 1:
                gone[i : i + width] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone[:-1]])
        yield d, len(t), kept, int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum())


def rows_of(df):
    return sorted(((r.doc_id, r.n_bytes, bytes(r.kept), r.n_removed, r.n_spans) for r in df.collect()), key=str)


def planted():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, licence = text(60), text(45)
    rows = [(k, text(rng.randint(1, 120))) for k in range(60)]
    rows += [(100 + k, text(20) + passage[k : len(passage) - k] + text(20)) for k in range(40)]
    rows += [(200 + k, text(5) + " " + licence + " " + text(30)) for k in range(60)]
    body = text(150)
    rows += [(300, body), (300, body), (301, body), (302, body[:400] + "x" + body[400:]), (None, body[100:500]), (None, None)]
    rows += [(303, "ab" * 500), (304, "a" * 199), (305, "a" * 199), (306, "a" * 201), (307, ""), (308, None), (309, passage + passage)]
    return rows


@pytest.mark.parametrize("most", [suffix_dedup.MOST, 6])
def test_removal_against_all_strings(spark, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "MOST", most)
    rows = planted()
    docs = checkpoint(spark.createDataFrame(rows, COLUMNS).selectExpr("*", "1 as h", "2 as _row", "3 as key", "text as kept").repartition(5))
    assert rows_of(dedup_substrings(docs)) == sorted(brute(rows, 200), key=str)


def test_no_rows_and_long_texts(spark, monkeypatch):
    assert dedup_substrings(spark.createDataFrame([], COLUMNS)).count() == 0
    assert rows_of(dedup_substrings(spark.createDataFrame([(1, None), (2, "")], COLUMNS))) == [(1, 0, b"", 0, 0), (2, 0, b"", 0, 0)]
    monkeypatch.setattr(suffix_dedup, "PIECE", 1000)
    rng = random.Random(6)
    long = "".join(rng.choice("abcdefgh ") for _ in range(30_000))
    rows = [(1, long), (2, long[7_000:9_500] + "!" + long[100:350])]
    assert rows_of(dedup_substrings(spark.createDataFrame(rows, COLUMNS))) == sorted(brute(rows, 200), key=str)


def test_op11_keeps_what_the_operator_keeps(spark, sf):
    got = {r.doc_id: r for r in op11_suffix_dedup(spark, sf).collect()}
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert len(got) == len(docs)
    for d, n, kept, removed, spans in brute(docs, 200):
        assert (got[d].n_bytes, got[d].n_removed, got[d].n_spans, got[d].kept_sha256) == (n, removed, spans, hashlib.sha256(kept).hexdigest())
