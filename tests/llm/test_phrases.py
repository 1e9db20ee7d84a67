"""Phrases against counting every stretch of words."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from boxtide.llm import phrases
from boxtide.llm.phrases import Pairs, cells_of, extended, frequent_phrases, mine_phrases, words_of

COLUMNS = "doc_id long, text string, lang string"


def pieces(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [[w for w in re.split("[\x20\x09]", p) if w] for p in re.split("[.,;:!?\x0a-\x0d]", text)]


def counted(rows, least, longest):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for p in pieces(text):
            n[lang] += len(p)
            for k in range(1, longest + 1):
                for i in range(len(p) - k + 1):
                    f[lang, tuple(p[i : i + k])] += 1
    return {x: c for x, c in f.items() if c >= least}, n


def brute(rows, least, longest, top):
    f, n = counted(rows, least, longest)
    out = []
    for (lang, p), a in f.items():
        if len(p) < 2:
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        inside = any(lang == m and len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for (m, q), b in f.items())
        if not inside:
            out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    ranks = Counter()
    for r in out:
        ranks[r[0]] += 1
        if ranks[r[0]] <= top:
            yield (r[0], ranks[r[0]], *r[1:])


def rows_of(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def made():
    rng = random.Random(8)
    words = ["The", "the", "cat", "sat", "on", "mat", "élan", "Été", "x", "new", "york", "city"]
    rows = []
    for d in range(300):
        text = ""
        for _ in range(rng.randint(0, 40)):
            text += rng.choice([*words, "New York City", "the cat sat on the mat", "a a a"]) + rng.choice([" ", " ", "\t", "  ", ", ", ".\n", "; "])
        rows.append((d, text, rng.choice(["en", "en", "fr", None])))
    return rows + [(None, None, "en"), (1, "", None), (1, "...!", "de"), (7, "big red dog " * 30, "one"), (7, "big red dog " * 30, "one")]


def test_words_of():
    words, ids = words_of([b"A b\tA, c", b"", b"c"])
    assert [words[i] if i >= 0 else None for i in ids] == [b"a", b"b", b"a", None, b"c", None, None, b"c"]


def test_extended():
    ids, word = np.array([0, 1, 0, 1, -1, 0], np.int32), np.array([70, 80])
    a, b, size, positions = extended(ids, word, np.array([70, 80, 70, 80, 70]), np.array([0, 1, 2, 3, 5]), 1)
    assert (a.tolist(), b.tolist(), size.tolist(), positions.tolist()) == ([70, 80], [80, 70], [2, 1], [0, 2, 1])


def test_pairs():
    pairs = Pairs(np.array([5, 5, 1 << 40]), np.array([7, 8, 7]), np.array([10, 11, 12]))
    assert pairs.find(np.array([5, 5, 1 << 40, 1 << 40, 6, 5]), np.array([8, 7, 7, 8, 7, 9])).tolist() == [11, 10, 12, -1, -1, -1]
    assert Pairs(*[np.empty(0, np.int64)] * 3).find(np.array([1]), np.array([1])).tolist() == [-1]


@pytest.mark.parametrize("at_most", [1 << 20, 3])
def test_frequencies_and_blocks(spark, at_most):
    """Frequent phrases sent to all tasks, and joined with blocks."""
    rows = made()
    found, totals = frequent_phrases(spark.createDataFrame(rows, COLUMNS).repartition(7), least=9, longest=5, at_most=at_most)
    want, n = counted(rows, 9, 5)
    assert {(r.lang, tuple(r.phrase.split(" "))): r.f for r in found.collect()} == want
    assert {r.lang: r.n for r in totals.collect()} == {k: v for k, v in n.items() if v}


def test_only_what_can_be_frequent_has_lists(spark, monkeypatch):
    """Of a text in which each pair of frequent words but one is rare, lists hold that one; and cells that are shared lose nothing."""
    a, b = np.arange(5000) << 33, np.arange(5000)
    cells = cells_of(a, b, 12)
    assert cells.max() < 1 << 12 and len(np.unique(cells)) > 2500 and (cells_of(a, b, 12) == cells).all()
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows = [(d, " ".join(rng.sample(words, 300)) + ". new york", "en") for d in range(60)]
    held, written = [], phrases._written

    def seen(df, what, kind):
        out = written(df, what, kind)
        if what == "phrase-lists":
            held.append([tuple(r) for r in out.selectExpr("inline(arrays_zip(a, b, size))").groupBy("a", "b").sum("size").collect()])
        return out

    monkeypatch.setattr(phrases, "_written", seen)
    found, _ = frequent_phrases(spark.createDataFrame(rows, COLUMNS), least=50)
    assert {(r.phrase, r.f) for r in found.where("k > 1").collect()} == {("new york", 60)}
    assert len(held) >= 1 and (sum(x[2] for x in held[0])) < 4000  # of some 18,000 pairs of frequent words
    monkeypatch.setattr(phrases, "CELLS", 8)
    rows = made()
    found, _ = frequent_phrases(spark.createDataFrame(rows, COLUMNS).repartition(3), least=9)
    assert {(r.lang, tuple(r.phrase.split(" "))): r.f for r in found.collect()} == counted(rows, 9, 5)[0]


def test_phrases_against_counting(spark):
    rows = made()
    docs = spark.createDataFrame(rows, COLUMNS).selectExpr("*", "1 as block", "2 as phrase", "3 as n")
    for least, longest, top in ((9, 5, 2000), (30, 3, 4)):
        got = rows_of(mine_phrases(docs, least, longest, top))
        assert got and got == sorted(brute(rows, least, longest, top))


def test_no_rows(spark):
    assert mine_phrases(spark.createDataFrame([], COLUMNS)).count() == 0
    assert mine_phrases(spark.createDataFrame([(1, None, None), (2, "one two", "en")], COLUMNS)).count() == 0


def test_long_text_and_large_products(spark):
    text = "alpha beta gamma " * 200_000
    got = rows_of(mine_phrases(spark.createDataFrame([(1, text, "en")], COLUMNS)))
    assert got == sorted(brute([(1, text, "en")], 100, 5, 2000)) and phrases.BLOCK < 1 << 24
