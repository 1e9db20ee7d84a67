"""Language ID, LM scores and decontamination on held-out rows, planted cases and odd rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np

from boxtide.llm import language_id, lm_scoring
from boxtide.llm.decontamination import Index, contaminations, edited, repeats_for, drop_contaminated, edit_span, op4_decontamination, words
from boxtide.llm.language_id import WIDTH, identify, ngrams, op7_language_id, train
from boxtide.llm.lm_scoring import CONTEXT, OWN, SHARED, LogBilinear, Vocabulary, least_count, op3_lm_scoring, score, shared_class, word_counts

DOCS = "doc_id long, text string, lang string"


def test_op7_held_out(spark, sf):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op7_language_id(spark, sf).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_odd_rows(spark):
    en, de = "the of and was with that this", "der die und nicht schau auch für"
    rows = [(k, f"{en if k % 2 else de} {k}", "en" if k % 2 else "de") for k in range(200)]
    rows += [(900, None, "en"), (901, "123 !!", "en"), (902, "", None), (903, en * 3000, None), (None, de, "de"), (904, en, None), (904, en, None)]
    got = identify(spark.createDataFrame(rows, DOCS)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert [by[k].lang_pred for k in (900, 901, 902, 903, 904, None)] == ["und", "und", "und", "en", "en", "de"]
    assert by[900].score == 0.0 and not by[None].held_out
    empty = spark.createDataFrame([], DOCS)
    assert identify(empty).count() == 0 and train(empty).languages == []
    clash = spark.createDataFrame([(1, en, "en", "x")], DOCS + ", lang_pred string")
    assert identify(clash).count() == 1


def test_op3_base_and_gain(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {d.doc_id: [*d.text.translate(lower).encode().split(), b"\n"] for d in docs}
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k in tokens}
    counts = Counter(t for k, ts in tokens.items() if not held[k] for t in ts)
    n, v = sum(counts.values()), len(counts)
    rows = op3_lm_scoring(spark, sf).collect()
    for r in rows:
        ts = tokens[r.doc_id]
        base = sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ts), sum(counts[t] > 0 for t in ts), n, held[r.doc_id])
        assert abs(r.base_score - base) < 1e-6 * max(1, -base)
    mine = [r for r in rows if r.held_out]
    assert sum(r.score for r in mine) > 0.99 * sum(r.base_score for r in mine)


def test_lm_rare_words_join_like_frequent_ones(spark):
    rng = random.Random(1)
    vocab = [f"w{k}" for k in range(900)]
    rows = [(k, " ".join(rng.choice(vocab[: 3 + k]) for _ in range(40))) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    learned = docs.where("doc_id % 3 > 0")
    a, b = ({r.doc_id: r for r in score(docs, learned, top=t).collect()} for t in (1 << 18, 400))
    assert all(abs(a[k].base_score - b[k].base_score) < 1e-6 and a[k].n_known == b[k].n_known for k in a)


def test_lm_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    prior = np.full(OWN + SHARED, 1 / (OWN + SHARED))
    model = LogBilinear.new(prior)
    model.flat += rng.normal(0, 0.2, model.flat.shape).astype(np.float32)
    ctx = np.repeat(rng.integers(0, OWN + SHARED, (3, CONTEXT)), OWN + SHARED, axis=0)
    p = 10 ** model.log10_probabilities(ctx, np.tile(np.arange(OWN + SHARED), 3))
    assert np.allclose(p.reshape(3, -1).sum(1), 1, atol=1e-4)


def test_scores_are_those_of_a_softmax_over_all_words(spark, monkeypatch):
    rng, draw = random.Random(2), np.random.default_rng(2)
    rows = [(k, " ".join(f"v{int(rng.random() ** 3 * 900)}" for _ in range(30))) for k in range(60)]
    docs = spark.createDataFrame(rows + [(99, "unseen words here v1")], "doc_id long, text string")
    learned = docs.where("doc_id < 50")
    model = LogBilinear.new(np.full(OWN + SHARED, 1 / (OWN + SHARED)))
    model.flat += draw.normal(0, 0.3, model.flat.shape).astype(np.float32)
    monkeypatch.setattr(lm_scoring, "train_model", lambda *a, **k: model)
    vocabulary = Vocabulary.of(word_counts(learned).cache())
    n_of = Counter(w for k, t in rows if k < 50 for w in [*t.encode().split(), b"\n"])
    class_of = lambda w: int(vocabulary.classes[vocabulary.top[w]]) if w in vocabulary.top else shared_class(w)
    within = {}
    for w in [*n_of, b"?"]:
        same = [x for x in n_of if class_of(x) == class_of(w)]
        within[w] = 1.0 if class_of(w) < OWN else (n_of[w] + 0.5) / (sum(n_of[x] for x in same) + 0.5 * (len(same) + 1))
    got = {r.doc_id: r.score for r in score(docs, learned).collect()}
    for k, text in [rows[3], rows[55], (99, "unseen words here v1")]:
        before, total = [b"\n"] * CONTEXT, 0.0
        for w in [*text.encode().split(), b"\n"]:
            s = [float(sum((model.r[class_of(x)] * model.c[i]) @ model.q[c] for i, x in enumerate(before)) + model.b[c]) for c in range(OWN + SHARED)]
            share = within[w] if w in n_of else 0.5 / (sum(n_of[x] for x in n_of if class_of(x) == class_of(w)) + 0.5 * (sum(class_of(x) == class_of(w) for x in n_of) + 1))
            total += math.log10(math.exp(s[class_of(w)]) / sum(map(math.exp, s)) * share)
            before = [w, *before[:-1]]
        assert abs(got[k] - total) < 1e-3 * abs(total)


def test_the_least_count_is_found_by_aggregates(spark):
    rng = random.Random(3)
    counts = [rng.choice([1, 1, 1, 2, 3, rng.randrange(1, 500), rng.randrange(1, 10**7)]) for _ in range(3000)] + [10**6] * 200
    table = spark.createDataFrame([(f"w{k}".encode(), n) for k, n in enumerate(counts)], "word binary, n long").cache()
    for most in (1, 10, 150, 700, 1500, 3199, 3200, 5000):
        least = least_count(table, most)
        assert sum(n >= least for n in counts) <= most and (least == 1 or sum(n >= least - 1 for n in counts) > most)


def test_lm_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "a"), (4, "x " * 50000)]
    docs = spark.createDataFrame([(*r, 5, b"w", 6) for r in rows], "doc_id long, text string, n int, word binary, rid int")
    got = score(docs, docs).collect()
    assert sorted(r.n_tokens for r in got) == [1, 1, 2, 3, 3, 50001]
    assert score(docs, docs.where("false")).where("n_known > 0").count() == 0
    assert score(docs.where("false"), docs).count() == 0


def test_edit_span():
    assert edit_span([1, 2, 3], [9, 1, 2, 3, 9]) == (0, 1, 4)
    assert edit_span([1, 2, 3, 4], [1, 3, 4])[0] == 1
    assert edit_span([1, 2], [])[0] == 2


def test_op4_finds_all_exact_passages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    got = {(r.doc_id, r.item_id): r for r in op4_decontamination(spark, sf).collect()}
    joined = {d.doc_id: " " + " ".join(words(d.text)) + " " for d in docs}
    exact = {(d, i.item_id) for d, t in joined.items() for i in items if " " + " ".join(words(i.text)) + " " in t}
    assert exact and {k for k, r in got.items() if r.edits == 0} == exact
    for (d, i), r in got.items():
        item = words(next(x.text for x in items if x.item_id == i))
        run = joined[d].split()[r.first_word : r.first_word + r.n_words]
        assert edit_span(item, run)[0] == r.edits <= 0.2 * len(item)


def test_decontamination_recall_and_odd_rows(spark):
    rng = random.Random(7)
    vocab = [f"v{k}" for k in range(400)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(20 + k))) for k in range(30)]
    docs, hit = [], set()
    for k in range(300):
        w = items[k % 30][1].split()
        for _ in range(rng.randint(0, len(w) // 5)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        docs.append((k, " ".join(rng.choice(vocab) for _ in range(30)) + " " + " ".join(w) + " " + " ".join(rng.choice(vocab) for _ in range(30))))
        hit.add(k)
    docs += [(k, " ".join(rng.choice(vocab) for _ in range(80))) for k in range(300, 400)]
    docs += [(1000, None), (1001, ""), (1002, "... --"), (1003, items[0][1].upper().replace(" ", "; ")), (None, items[0][1]), (1004, "z " * 90000 + items[1][1])]
    items += [(90, None), (91, ""), (92, "!!")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for chars in (4_000_000, 500):  # one block of items, and several
        found = {r.doc_id for r in contaminations(d, b, block_chars=chars).collect()}
        assert len(found & hit) >= 0.97 * len(hit) and not found & set(range(300, 400))
        assert {1003, None, 1004} <= found and not found & {1000, 1001, 1002}
    clash = d.selectExpr("*", "1 as item", "2 as key", "3 as edits")
    assert {r.doc_id for r in contaminations(clash, b).collect()} == found
    left = {r.doc_id for r in drop_contaminated(d, b).collect()}
    assert {1000, 1001, 1002} <= left and not left & found
    assert contaminations(d, b.where("false")).count() == 0 and contaminations(d.where("false"), b).count() == 0


def test_long_items_are_found_at_every_length():
    rng = random.Random(11)
    for size in (25, 45, 60, 100, 200):
        vocab = [f"v{k}" for k in range(3 * size)]
        items = [[rng.choice(vocab) for _ in range(size)] for _ in range(20)]
        texts = []
        for item in items:
            w = list(item)
            for _ in range(size // 5):  # substitutions, insertions, deletions
                p = rng.randrange(len(w))
                w[p : p + 1] = rng.choice([[rng.choice(vocab)], [w[p], rng.choice(vocab)], []])
            around = [[rng.choice(vocab) for _ in range(30)] for _ in range(2)]
            texts.append(" ".join([*around[0], *w, *around[1]]))
        index = Index.build([(k, " ".join(x)) for k, x in enumerate(items)], 0.8)
        got = {(n, k): (edits, a, m) for n, k, edits, a, m in index.search(texts)}
        assert sum((k, k) in got for k in range(20)) >= (18 if repeats_for(size, size // 5) else 20)
        for n, text in enumerate(texts):
            own = [index.vocabulary.get(w, 0) for w in words(text)]
            for k in range(20):
                edits = edit_span(index.items[k], own)[0]
                assert (n, k) not in got or edits <= got[n, k][0] <= size // 5
                assert repeats_for(size, size // 5) or ((n, k) in got) == (edits <= size // 5)


def test_repeats_reach_the_recall():
    repeats = [repeats_for(size, size // 5) for size in (1, 5, 20, 30, 45)]
    assert all(repeats) and repeats[0] <= repeats[1] <= repeats[4] and repeats_for(300, 60) is None and repeats_for(300, 0) == 1
    assert repeats_for(45, 9, 0.9) < repeats_for(45, 9)
    assert len(edited(np.arange(40), 8, np.random.default_rng(0))) in range(32, 49)


def test_op4_recall_by_exhaustive_search():
    """Against every run of every text: items of a length that is walked, with all edits that are allowed."""
    rng, draw = random.Random(12), np.random.default_rng(12)
    met = wanted = 0
    for size in (10, 20, 35):
        items = [[f"w{rng.randrange(4 * size)}" for _ in range(size)] for _ in range(40)]
        texts = []
        for x in items:
            own = [w if w < 10**9 else 0 for w in edited(np.arange(1, size + 1), size // 5, draw)]
            texts.append(" ".join(["pad"] * 20 + [x[w - 1] if w else f"new{rng.randrange(99)}" for w in own] + ["pad"] * 20))
        index = Index.build([(k, " ".join(x)) for k, x in enumerate(items)], 0.8)
        got = {(n, k) for n, k, *_ in index.search(texts)}
        for n, text in enumerate(texts):
            run = [index.vocabulary.get(w, 0) for w in words(text)]
            near = {(n, k) for k in range(40) if edit_span(index.items[k], run)[0] <= size // 5}
            wanted, met = wanted + len(near), met + len(near & got)
            assert {x for x in got if x[0] == n} <= near
    assert wanted >= 120 and met >= 0.97 * wanted


def plain_ngrams(text):
    shown = "".join(c if c.isalpha() else " " for c in text.lower())
    shown = " " + " ".join(shown.split()) + (" " if shown.strip() else "")
    out = Counter()
    for n, (factor, add) in enumerate(((7, 0), (11, 1), (13, 2)), 1):
        for at in range(len(shown) - n + 1 if text else 0):
            x = 0
            for c in shown[at : at + n]:
                x = x * 1_000_003 + ord(c)
            out[((x * factor + add) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 49] += 1
    return out


def test_ngrams_and_predictions_by_plain_arithmetic(spark, monkeypatch):
    texts = ["", "a", "Ab  c1d", "  x", "9", "ein größeres Wort, " * 30, "zwei" * 11]
    for part in (1 << 16, 7, 2):
        monkeypatch.setattr(language_id, "PART", part)
        for t in texts:
            at, n = ngrams(t)
            assert dict(zip(at.tolist(), n.tolist(), strict=True)) == plain_ngrams(t), (part, t)
    monkeypatch.setattr(language_id, "PART", 1 << 16)
    rows = [(k, ("the cat and dog " if k % 2 else "der hund und katze ") + f"x{'abc'[k % 3]}", "en" if k % 2 else "de") for k in range(120)]
    docs = spark.createDataFrame(rows, DOCS)
    model = train(docs)
    for text in ("the dog", "und der", "katze dog"):
        f = {b: (1 + math.log(n)) * model.idf[b] for b, n in plain_ngrams(text).items()}
        norm = math.sqrt(sum(x * x for x in f.values()))
        z = [sum(x / norm * model.weights[b, c] for b, x in f.items()) + model.bias[c] for c in range(2)]
        e = [math.exp(x / model.temperature) for x in z]
        lang, p = model.predict(text)
        assert lang == model.languages[int(e[1] > e[0])] and abs(p - max(e) / sum(e)) < 1e-9
    assert model.weights.shape == (WIDTH, 2)


def test_hot_key_does_not_fill_the_sample(spark):
    rows = [(None if k % 3 else k, f"the dog number {k} und so", "en") for k in range(6000)]
    seen = []
    language_id_fit = language_id.fit_weights
    try:
        language_id.fit_weights = lambda samples, *a, **k: seen.append(len(samples)) or language_id_fit(samples[:50], *a, **k)
        train(spark.createDataFrame(rows, DOCS), sample=200)
    finally:
        language_id.fit_weights = language_id_fit
    assert 120 < seen[0] < 300


def test_index_of_short_items():
    index = Index.build([(1, "solo"), (2, "two words")], 0.8)
    assert [h[:3] for h in index.search(["a solo b", "two  WORDS", "two other words", ""])] == [(0, 0, 0), (1, 1, 0)]
