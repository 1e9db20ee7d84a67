"""Embeddings, URL filter and sharding against brute force, and on odd rows."""

import math
import zlib
from collections import Counter

import numpy as np

from boxtide.llm import embedding_dedup
from boxtide.llm.embedding_dedup import MultiIndex, cells_for_recall, embedding_groups, k_means, op9_embedding_dedup
from boxtide.llm.sharding import interleave, op8_sharding
from boxtide.llm.url_filter import OP10_SQL, RULES, filter_urls, op10_url_filter
from oracle import differ

VECTORS = "vec_id long, embedding array<float>"


def brute(vectors):
    x = np.array([v for _, v in vectors], float)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    return near


def test_embedding_links_and_recall(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(25, 16))
    rows = [rng.normal(size=16) for _ in range(500)]
    rows += [c + rng.normal(size=16) * 0.18 for c in centres for _ in range(12)]
    rows += [rows[0]] * 40 + [rows[1] * 3.0]
    vectors = [(int(k) * 3, [float(np.float32(y)) for y in v]) for k, v in enumerate(rows)]
    near = brute(vectors)
    for block in (4096, 16):
        got = {r.vec_id: r for r in embedding_groups(spark.createDataFrame(vectors, VECTORS), block=block).collect()}
        mine = np.array([got[i].n_links for i, _ in vectors])
        assert (mine <= near.sum(1)).all() and mine.sum() >= 0.95 * near.sum()
        assert len({got[i].component_id for i, _ in vectors[-41:-1]} | {got[0].component_id}) == 1 and got[vectors[-1][0]].component_id == 3
        assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_op9_table(spark, sf):
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()]
    got = {r.vec_id: r.n_links for r in op9_embedding_dedup(spark, sf).collect()}
    near = brute(vectors).sum(1)
    mine = np.array([got[i] for i, _ in vectors])
    assert (mine <= near).all() and mine.sum() >= 0.9 * near.sum()


def test_embedding_odd_rows(spark):
    one = [1.0, 0.0, 0.0, 0.0]
    rows = [(1, one), (2, [2.0, 0.0, 0.0, 0.0]), (3, None), (4, []), (5, [0.0] * 4), (6, [1.0, None, 0.0, 0.0]), (7, [math.nan, 1.0, 0.0, 0.0]), (8, [math.inf, 1.0, 0.0, 0.0]), (9, [1.0, 0.0]), (11, [3.0, 0.1]), (None, one), (1, one), (10, [0.0, 1.0, 0.0, 0.0])]
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in embedding_groups(spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 as id", "2 as copies", "3 as _key")).collect())
    alone = [(k, 0, k, True) for k in (3, 4, 5, 6, 7, 8, 10)]
    alone += [(9, 1, 9, True), (11, 1, 9, False)]  # of two dimensions
    assert got == sorted([(0, 3, 1, False), (1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), *alone])
    assert embedding_groups(spark.createDataFrame([], VECTORS)).count() == 0
    assert embedding_groups(spark.createDataFrame([(1, None)], VECTORS)).collect()[0].n_links == 0


def brute_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    tail = rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), tail[:end]


def brute_rule(host, path):
    fits = [r for r in RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    return max(fits, key=lambda r: len(r[1] + r[2]), default=None)


def test_op10_rules(spark, sf):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = op10_url_filter(spark, sf).collect()
    assert len(rows) == len(urls)
    for r in rows:
        host, path = brute_url(urls[r.page_id])
        rule = brute_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[1] + rule[2])
        assert rule is None or r.verdict == rule[0]


def test_url_aliases_and_odd_rows(spark):
    canonical = '<html><link rel="canonical" href="{}"></html>'
    refresh = "<META http-equiv='refresh' content='0; URL={}'>"
    rows = [
        (1, "https://a.com/x", canonical.format("https://bad.net/y")),
        (2, "https://A.com/x#part", None),
        (3, "https://b.com/", refresh.format("https://a.com/x")),
        (4, "https://c.com/", canonical.format("https://d.org/fr/1")),
        (5, "https://e.com/", "<link href=https://c.com/ rel=canonical><link rel=canonical href='https://bad.net/y2'>"),
        (6, "https://f.com/", canonical.format("/rel")),
        (7, None, None),
        (8, "no scheme/", ""),
        (9, "http://X.NET?q=1", None),
        (10, "x://sub.example.net/en/://z#f", None),
        (11, "https://notnet/", "x" * 200000),
        (11, "https://notnet/", None),
        (None, "https://b.com/", None),
        (12, "https://g.com/\nline?x", None),
    ]
    got = filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as verdict")).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows)
    assert [by[k].verdict for k in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, None)] == ["block", "block", "block", "allow", "allow", "allow", "allow", "allow", "allow", "allow", "allow", "block"]
    for k, url, _ in rows:
        assert (by[k].host, by[k].path) == brute_url(url)
    assert filter_urls(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def brute_shards(docs, shards):
    import hashlib

    rows = [(s, hashlib.md5(f"42|{i}".encode()).hexdigest(), i) for i, s in docs]
    by = Counter(s for s, *_ in rows)
    seen, out = Counter(), []
    for s, h, i in sorted(rows):
        out.append(((2 * seen[s] + 1) / (2 * by[s]), s, h, i))
        seen[s] += 1
    return {i: p * shards // len(out) for p, (*_, i) in enumerate(sorted(out))}


def test_op8_law(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    rows = op8_sharding(spark, sf).collect()
    text = {d.doc_id: d.text for d in docs}
    want = brute_shards([(d.doc_id, d.source) for d in docs], 40)
    for r in rows:
        raw = text[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard, r.shard) == (len(raw) + 16, zlib.crc32(raw), "rows", None, want[r.doc_id])
    counts = Counter(r.shard for r in rows)
    assert set(counts) == set(range(40)) and max(counts.values()) - min(counts.values()) <= 1
    for k in counts:
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(counts[k]))
    share = Counter(d.source for d in docs)
    mix = Counter((r.shard, r.source) for r in rows)
    assert all(abs(mix[k, s] - share[s] / 40) <= 1.5 for k in counts for s in share)


def test_sharding_odd_rows(spark):
    rows = [(1, "a", 5), (1, "a", 5), (None, "a", 5), (2, None, 5), (3, None, None)] + [(k, "hot", 1) for k in range(10, 30)]
    out = interleave(spark.createDataFrame(rows, "doc_id long, source string, size int").selectExpr("*", "9 as shard"), 4).collect()
    counts = Counter(r.shard for r in out)
    assert len(out) == 25 and sorted(counts.values()) == [6, 6, 6, 7]
    assert all(sorted(r.slot for r in out if r.shard == k) == list(range(counts[k])) for k in counts)
    assert interleave(spark.createDataFrame([], "doc_id long, source string"), 4).count() == 0
    few = interleave(spark.createDataFrame(rows[:2], "doc_id long, source string, size int"), 40).collect()
    assert len({r.shard for r in few}) == 2 and all(r.slot == 0 for r in few)


def test_embeddings_of_doubles_keep_their_precision(spark):
    near = [0.9 + 1e-12, (1 - (0.9 + 1e-12) ** 2) ** 0.5]
    far = [0.9 - 1e-12, (1 - (0.9 - 1e-12) ** 2) ** 0.5]
    rows = [(1, [1.0, 0.0]), (2, near), (3, [0.0, -1.0]), (4, [-far[1], -far[0]])]
    got = {r.vec_id: r.n_links for r in embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: 1, 2: 1, 3: 0, 4: 0}


def test_cells_grow_until_the_recall_is_reached(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    monkeypatch.setattr(embedding_dedup, "QUERIES", 400)
    index = MultiIndex(k_means(x[:, :12], 40), k_means(x[:, 12:], 40))  # cells of about one vector: many must be visited
    rows = [(k, 1, bytearray(v.astype("<f8").tobytes())) for k, v in enumerate(x)]
    units = spark.createDataFrame(rows, "id long, copies long, u binary")
    cells, true, worst = cells_for_recall(units, len(x), 24, index, 0.9, cells=4)
    assert cells > 4 and worst >= 0.95 and true >= 0.995
    every = cells_for_recall(units, len(x), 24, index, 0.9, worst=1.1, cells=256)
    assert every[0] == 1600 and every[2] == 1.0


def test_rules_of_equal_length_and_long_lists(spark):
    pages = spark.createDataFrame([(1, "http://a.x.com/ab/c", None), (2, "http://b.k77.com/p/", None), (3, "http://k77.com./", None), (4, None, None)], "page_id long, url string, html string")
    tie = [("block", "x.com", "/ab/"), ("allow", "a.x.com", "/a")]
    many = [("block", f"k{k}.com", f"/{'p' * (k % 3)}") for k in range(100_000)]
    for rules in (tie, tie[::-1]):
        assert filter_urls(pages, rules).where("page_id = 1").collect()[0].verdict == rules[0][0]
    got = {r.page_id: r for r in filter_urls(pages, tie + many).collect()}
    assert got[1].verdict == "block" and (got[2].verdict, got[2].rule) == ("allow", None) and got[4].verdict == "allow"
    table = spark.createDataFrame([("block", "com", "/", 0), ("allow", "b.k77.com", "/p", 1), ("block", "b.k77.com", "/p", 2)], "verdict string, host string, path string, place long")
    got = {r.page_id: (r.verdict, r.rule) for r in filter_urls(pages, table).collect()}
    assert got == {1: ("block", "com/"), 2: ("allow", "b.k77.com/p"), 3: ("allow", None), 4: ("allow", None)}


def test_relative_links_as_the_sql_has_them(spark, tmp_path):
    links = ["../other", "./x/../../y", "?p=2&amp;q=1", "next.html", "/a/./b/..", "//bad.net/z", "mailto:x@bad.net", "#top", "http://bad.net/a/../b?c=../d", "../../../..", "&#x2F;root", ""]
    html = "".join(f'<link rel="canonical" href="{x}">' for x in links)
    rows = [(1, "https://h.com/d/e/page.html?z=/1", html), (2, "https://h.com", '<link rel=canonical href="sub">'), (3, "https://h.com/d/other", None), (4, "https://h.com/y", None), (5, "https://h.com/d/e/next.html", None), (6, "https://h.com/d/e/page.html?p=2&q=1", None), (7, "https://h.com/sub", None), (8, "https://h.com/root", None), (9, "https://h.com/a/", None), (10, "https://h.com/d/y", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.verdict for r in filter_urls(pages).collect()}
    assert got == {1: "block", 2: "allow", 3: "block", 4: "allow", 5: "block", 6: "block", 7: "allow", 8: "block", 9: "block", 10: "block"}
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert {r[0]: r[4] for r in con.execute(OP10_SQL).fetchall()} == got
