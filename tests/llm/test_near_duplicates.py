"""SimHash and line dedup against brute force, and on odd rows."""

import random
import re

import numpy as np
import xxhash
from oracle import differ

from boxtide.llm.components import connected_components
from boxtide.llm.line_dedup import OP5_SQL, dedup_lines, op5_line_dedup
from boxtide.llm.simhash import Apart, Joined, Search, fingerprint, in_order, op1_simhash, sets_of, shingle_hashes, simhash_groups, trie_links, verified, walk

DOCS = "doc_id long, text string"


def brute_fingerprint(text, n=4):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", text)
    shingles = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(n, linked):
    par = list(range(n))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        par[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_fingerprint_cases():
    for text in ["", " \t\n", "One", "a b c", "A b C d", "É é\u00a0x Y z w v\x0bq", "w " * 5000, "a  b\tc\nd e f"]:
        assert fingerprint(text.encode(), 4)[0] == brute_fingerprint(text)
    assert fingerprint(b"", 4, 2) == [0, 0]
    often, one = b"a b c d e f g" + b" x" * 900, b"x x x x"
    assert fingerprint(often, 4) == fingerprint(one, 4) != fingerprint(often, 4, repeats=False)
    assert fingerprint(b"x " * 900, 4, repeats=False) == fingerprint(one, 4)


def test_op1_whole_table(spark, sf):
    got = {r.doc_id: r for r in op1_simhash(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    fps = np.array([brute_fingerprint(d.text) for d in docs], np.uint64)
    linked = [(i, j) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps[:i]) <= 4)]
    root = roots(len(fps), linked)
    for k, d in enumerate(docs):
        assert got[d.doc_id].fingerprint == f"{int(fps[k]):016x}"
        assert got[d.doc_id].component_id == docs[root[k]].doc_id


def test_simhash_odd_rows(spark):
    rows = [(None, "a b c d e f"), (1, None), (2, ""), (3, "  "), (4, "a b c d e f"), (4, "a b c d e f"), (5, "x " * 60000)]
    got = simhash_groups(spark.createDataFrame(rows, DOCS), 4, how=Search.exact(4)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in got) == [(False, 1, 1), (False, 2, 1), (False, 3, 1), (False, 4, 4), (False, 4, 4), (False, 5, 5), (True, 0, 4)]
    assert simhash_groups(spark.createDataFrame([], DOCS)).count() == 0
    clash = spark.createDataFrame([(1, "a", 7)], "doc_id long, text string, fp long")
    assert [tuple(r) for r in simhash_groups(clash, 4, how=Search.exact(4)).select("doc_id", "component_id").collect()] == [(1, 1)]


def some_fingerprints():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = [base ^ sum((np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(k)) for k in range(1, 6)]
    fps = np.unique(np.concatenate([base, *near, np.arange(300, dtype=np.uint64)]))
    return fps, roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if int(fps[i] ^ fps[j]).bit_count() <= 4])


def one_walk(words, how, r, kind, held=1 << 16):
    prefix = in_order(words, how.orders[r])
    order = np.argsort(prefix)
    n = len(order)
    block = kind(words[:, order], order, order, np.ones(n, int), how.budget, how.budget)
    root = np.array([[0], [n], [0], [n], [0], [0]])
    met = walk(prefix[order], root, np.array([0]), np.array(how.allowed[r])[None], block.visit, block.dull, held)
    return met, list(zip(*(x.tolist() for x in block.result()), strict=True))


def test_walks_of_the_trie_find_all_links():
    fps, want = some_fingerprints()
    how = Search.exact(4)
    for held in (1 << 16, 50):
        links = [x for r in range(5) for x in one_walk(fps[None], how, r, Joined, held)[1]]
        assert roots(len(fps), links) == want


def test_pruning_decides_how_much_is_met():
    n = 60_000
    fps = np.unique(np.random.default_rng(4).integers(0, 2**63, n, dtype=np.uint64))
    met = sum(one_walk(fps[None], Search.exact(4), r, Joined)[0] for r in range(5))
    assert met < n * n / 2 / 1000  # nodes and leaves, of all pairs of leaves


def test_a_dense_group_is_not_expanded_into_its_pairs():
    rng = np.random.default_rng(6)
    n, bits = 4000, [1 << k for k in range(20)]
    fps = np.unique(np.array([sum(rng.choice(bits, 2, replace=False).tolist()) for _ in range(n)], np.uint64) | np.arange(n, dtype=np.uint64) << np.uint64(40))
    fps = np.unique(fps & np.uint64((1 << 42) - 1))
    met, links = one_walk(fps[None], Search.exact(12), 0, Joined, 2000)
    assert len(links) <= len(fps) and met < len(fps) ** 2 / 2


def test_places_dealt_anew(spark):
    fps, want = some_fingerprints()
    place = {int(x): k for k, x in enumerate(fps.view(np.int64))}
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "id long").selectExpr("id", "id as w0", "id as class", "1L as size").coalesce(2).cache()
    for block in (100_000, 100, 20):  # the small ones deal full nodes out
        links = [(place[r.a], place[r.b]) for r in trie_links(df, Search.exact(4), len(fps), block=block).collect()]
        assert roots(len(fps), links) == want
    every = [(i, j) for i in range(len(fps)) for j in range(i) if int(fps[i] ^ fps[j]).bit_count() <= 4]
    got = {(place[r.a], place[r.b]) for r in trie_links(df, Search.exact(4), len(fps), Apart, 50).collect()}
    assert {(max(x), min(x)) for x in got} == set(every)


def test_similar_texts_are_found(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows, near = [], []
    for k in range(150):
        w = [word() for _ in range(300)]
        v = list(w)
        for p in rng.sample(range(300), 3):
            v[p] = word()
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
    got = {r.doc_id: r.component_id for r in simhash_groups(spark.createDataFrame(rows, DOCS)).collect()}
    near = sum(got[2 * k + 1] == 2 * k for k in range(150))
    assert near >= 140 and all(got[2 * k] == 2 * k for k in range(150))


def test_walks_of_a_similarity_find_99_of_100():
    rng = np.random.default_rng(8)
    for texts in (1000, 300_000):
        how = Search.of_similarity(0.8, texts)
        for n in (20, 40, 100, 200, 600):  # shingles of both texts, four fifths of them in common
            both, one, apart = n * 4 // 5, n // 10, []
            for _ in range(6):
                own = rng.integers(0, 2, (500, n, 64 * how.lanes), dtype=np.int8)
                shared = own[:, :both].sum(1, dtype=np.int16)
                x, y = (2 * (shared + own[:, a : a + one].sum(1, dtype=np.int16)) > both + one for a in (both, both + one))
                apart.append(x != y)
            apart = np.concatenate(apart)
            met = np.zeros(len(apart), bool)
            for order, allowed in zip(how.orders, how.allowed, strict=True):
                met |= (np.cumsum(apart[:, order], axis=1) <= np.array(allowed)).all(1)
            assert (met & (apart.sum(1) <= how.budget)).mean() >= 0.99


def test_more_texts_take_longer_walks_and_more_of_them():
    small, large = Search.of_similarity(0.8, 10**4), Search.of_similarity(0.8, 10**8)
    assert len(small.allowed[0]) < len(large.allowed[0]) and len(small.orders) < len(large.orders)


def test_verification_is_exact(spark):
    rng = random.Random(9)
    texts, pairs = [], []
    for k in range(60):
        w = [str(rng.random()) for _ in range(rng.randrange(1, 60))]
        v = [x if rng.random() < 0.97 else "?" for x in w]
        texts += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
        pairs += [(2 * k, 2 * k + 1), (2 * k, (2 * k + 3) % 120)]
    texts += [(500, ""), (501, None)]
    pairs += [(500, 501)]
    sets = {k: set(shingle_hashes((t or "").encode(), 5).tolist()) for k, t in texts}
    want = {p for p in pairs if len(sets[p[0]] & sets[p[1]]) >= 0.8 * len(sets[p[0]] | sets[p[1]]) > 0}
    own = sets_of(spark.createDataFrame(texts, "id long, text string"), 5).cache()
    alone = own.selectExpr("id as t", "id")
    got = verified(spark.createDataFrame(pairs, "q long, t long"), alone, own, 0.8)
    assert {(r.a, r.b) for r in got.collect()} == want and 0 < len(want) < 60
    halves = own.selectExpr("id % 2 as t", "id")  # two classes, in parts of a few sets
    asked = own.selectExpr("id as q", "1 - id % 2 as t")
    got = {r.a for r in verified(asked, halves, own, 0.8, held=200).collect()}
    assert got == {i for i in sets if any(j % 2 != i % 2 and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) > 0 for j in sets)}


def test_groups_of_sets_are_the_components_of_similar_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    sets = [set(shingle_hashes((r.text or "").encode(), 5).tolist()) for r in rows]
    holders: dict = {}
    for k, own in enumerate(sets):
        for h in own:
            holders.setdefault(h, []).append(k)
    linked = [(k, j) for k, own in enumerate(sets) for j in {x for h in own for x in holders[h] if x < k} if len(own & sets[j]) >= 0.8 * len(own | sets[j])]
    linked += [(k, j) for k in range(len(sets)) for j in range(k) if not sets[k] and not sets[j]]
    root = roots(len(rows), linked)
    got = {r.doc_id: r.component_id for r in simhash_groups(docs, block=64).collect()}
    assert sum(got[r.doc_id] != rows[root[k]].doc_id for k, r in enumerate(rows)) <= 2


def test_links_below_the_similarity_join_nothing(spark):
    rng = random.Random(10)
    rows = []
    for k in range(40):
        w = [str(rng.random()) for _ in range(104)]
        v = list(w)
        for p in (10, 30, 50, 70)[: 4 if k % 2 else 2]:  # 5 of 100 shingles each: 80 of 120 left, or 90 of 110
            v[p] = str(rng.random())
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
    got = {r.doc_id: r.component_id for r in simhash_groups(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(got[2 * k] == 2 * k and got[2 * k + 1] == (2 * k + 1 if k % 2 else 2 * k) for k in range(40))


def test_a_shared_repeated_shingle_is_no_similarity(spark):
    rng = random.Random(6)
    junk = " be" * 60
    rows = [(k, " ".join(str(rng.random()) for _ in range(40)) + junk) for k in range(6)]
    got = simhash_groups(spark.createDataFrame(rows, DOCS)).collect()
    assert all(r.component_id == r.doc_id for r in got)


def test_components(spark):
    pairs = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (5, None), (200, 0)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100, 200: 0}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_op5_sql(spark, sf):
    assert differ(op5_line_dedup(spark, sf), OP5_SQL, sf) == ""


def test_line_dedup_odd_rows(spark):
    run = "l1\nl2\nl3"
    rows = [(2, "x\n" + run + "\ny"), (1, run + "\n" + run), (None, run), (3, None), (4, ""), (5, "\n\n\n\n"), (6, "\n\n\n"), (7, " l1 \nl2\t\nl3"), (8, "a\nb"), (8, "a\nb"), (9, "p\nq\nr"), (9, "p\nq\nr")]
    out = dedup_lines(spark.createDataFrame(rows, DOCS)).collect()
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_removed, r.text or "", r.text is None) for r in out)
    assert got == [
        (False, 1, 3, run, False),
        (False, 2, 3, "x\ny", False),
        (False, 3, 0, "", True),
        (False, 4, 0, "", False),
        (False, 5, 0, "\n\n\n\n", False),
        (False, 6, 0, "\n\n\n", False),
        (False, 7, 3, "", False),
        (False, 8, 0, "a\nb", False),
        (False, 8, 0, "a\nb", False),
        (False, 9, 0, "p\nq\nr", False),
        (False, 9, 3, "", False),
        (True, 0, 3, "", False),
    ]
    assert dedup_lines(spark.createDataFrame([], DOCS)).count() == 0
    long = spark.createDataFrame([(1, "\n".join(map(str, range(50000)))), (2, "\n".join(map(str, range(25000, 60000))))], DOCS)
    assert {r.doc_id: r.n_removed for r in dedup_lines(long).collect()} == {1: 0, 2: 25000}
    million = "\n".join(f"{k:x}" for k in range(1_000_000))
    million = spark.createDataFrame([(1, million), (2, million + "\nend"), (3, "")], DOCS)
    assert [(r.doc_id, r.n_removed, len(r.text)) for r in dedup_lines(million).orderBy("doc_id").collect()[1:]] == [(2, 1_000_000, 3), (3, 0, 0)]
    clash = spark.createDataFrame([(1, "a", 5, 6)], "doc_id long, text string, n_lines int, _row int")
    assert dedup_lines(clash).columns == ["doc_id", "text", "n_lines", "n_removed"]
