"""The pipeline's stages on the test table and on planted documents."""

import importlib
import random
from collections import Counter

import __spark_entry__
import corpus_pipeline
from boxtide.session import checkpoint

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash", "decontamination", "packing"]


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and {"doc_id", "piece", "sequence_id", "offset", "length"} <= set(out.columns)


def test_filters_keep_clean_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = stage("language_id")(spark, docs, sf)
    assert kept.columns == docs.columns and kept.count() >= 0.99 * docs.count()
    clean = docs.where("n_chars > 300")
    left = stage("decontamination")(spark, clean, sf)
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = clean.collect()
    gone = {r.doc_id for r in rows} - {r.doc_id for r in left.collect()}
    assert len(gone) < 0.1 * len(rows)
    assert {r.doc_id for r in rows if any(i in r.text for i in items)} <= gone


def test_simhash_keeps_one_of_each_group(spark, sf):
    body = " ".join(f"word{k}" for k in range(400))
    rows = [(1, body, "en", "s", 1), (1, body, "en", "s", 1), (2, body + " tail", "en", "s", 1), (3, None, None, None, None), (4, "", "en", "s", 0), (5, "alone here with other words", "en", "s", 1)]
    out = stage("simhash")(spark, spark.createDataFrame(rows, COLUMNS), sf).collect()
    assert len([r for r in out if r.doc_id in (1, 2)]) == 1
    assert len([r for r in out if r.doc_id in (3, 4)]) == 1 and [r.doc_id for r in out if r.doc_id == 5] == [5]


def test_empty_table_passes_all_stages(spark, sf):
    empty = spark.createDataFrame([], COLUMNS)
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, empty, sf).count() == 0


def prose(rng, n, words=None):
    """Text of n words in lines of some twelve."""
    words = words or ["the", "river", "house", "with", "and", "green", "morning", "stone", "paper", "walked", "under", "bridge", "children", "quiet", "window", "street"]
    own = [rng.choice(words) + str(rng.randrange(40)) * (rng.random() < 0.3) for _ in range(n)]
    return "\n".join(" ".join(own[k : k + 12]) for k in range(0, n, 12))


def odd_rows():
    """Nulls in each column, ties, repeated rows, an empty text, one without letters and a very long one."""
    rng = random.Random(12)
    long = prose(rng, 60_000)
    texts = [prose(rng, 80) for _ in range(12)]
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)]
    rows += [(None, prose(rng, 70), "en", "s", 1), (3, prose(rng, 70), None, None, None), (50, None, "en", "s", None), (51, "", "en", "s", 0), (52, "12 345 !!", "en", "s", 9)]
    rows += [(60, long, "en", None, len(long)), rows[4], rows[4]]
    return rows, long


def ids_and_texts(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_stages_on_odd_rows(spark, sf):
    rows, long = odd_rows()
    docs = checkpoint(spark.createDataFrame(rows, COLUMNS).selectExpr("*", "1 as n_removed", "2 as score", "3 as _row", "4 as h"))
    every = Counter((r[0], r[1]) for r in rows)
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    # The fixture's languages teach the model: of the odd rows those without a letter go, each for itself.
    taught = checkpoint(docs.select(*names).union(spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 300").selectExpr("doc_id + 1000 as doc_id", "text", "lang", "source", "n_chars")))
    kept = stage("language_id")(spark, taught, sf)
    assert kept.columns == names
    mine = {k: n for k, n in ids_and_texts(kept).items() if k[0] is None or k[0] < 1000}
    assert all(n == every[k] for k, n in mine.items()) and not {(50, None), (51, ""), (52, "12 345 !!")} & set(mine)

    lines = ids_and_texts(stage("line_dedup")(spark, docs, sf))
    assert lines == every - Counter({(4, rows[4][1]): 2})  # two of three equal rows are later runs of lines alone

    groups = stage("simhash")(spark, docs, sf)
    assert groups.columns == names
    left = ids_and_texts(groups)
    assert left[4, rows[4][1]] == 1 and left[60, long] == 1 and left[None, rows[12][1]] == 1
    assert sum(n for (d, t), n in left.items() if not t) == 1  # texts without a word are one group
    assert sum(left.values()) == len(rows) - 2 - 1

    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first().text
    leaky = [(70, f"{long} {item} {long}", "en", "s", 1), (71, item, None, None, None), (71, item, None, None, None), (None, f"before {item}", "en", "s", 1)]
    clean = ids_and_texts(stage("decontamination")(spark, checkpoint(docs.select(*names).union(spark.createDataFrame(leaky, COLUMNS))), sf))
    assert clean == every

    packed = stage("packing")(spark, docs, sf)
    pieces = packed.collect()
    assert Counter(r.doc_id for r in pieces if r.piece == 0) == Counter(r[0] for r in rows)
    assert {r.length for r in pieces if r.doc_id in (50, 51)} == {1} and max(r.piece for r in pieces if r.doc_id == 60) >= 29
    places = {}
    for r in pieces:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        ends = [0]
        for at, n in sorted(own):
            assert at == ends[-1]
            ends.append(at + n)
        assert ends[-1] <= 2048


def test_whole_pipeline_on_planted_documents(spark, sf, tmp_path):
    """A few hundred documents with copies, near copies, repeated passages, leaks and junk: what plain Python says stays, stays."""
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("abdeghiklmnoprstuvz") for _ in range(rng.randint(3, 9))) for _ in range(900)]
    own = [(k, prose(rng, rng.randint(120, 260), vocabulary)) for k in range(220)]
    items = [prose(rng, rng.randint(18, 30), vocabulary).replace("\n", " ") for _ in range(6)]
    passage = prose(rng, 60, vocabulary)
    copies = [(300 + k, own[k][1]) for k in range(15)]
    near = [(400 + k, own[20 + k][1].replace(own[20 + k][1].split()[50], "changed", 1)) for k in range(15)]
    passages = [(500 + k, f"{prose(rng, 150, vocabulary)}\n{passage}\n{prose(rng, 150, vocabulary)}") for k in range(12)]
    leaks = [(600 + k, f"{prose(rng, 60, vocabulary)}\n{items[k % 6]}\n{prose(rng, 60, vocabulary)}") for k in range(12)]
    junk = [(700, "0101 1110 ..."), (701, None), (702, "")]
    rows = [(d, t, "en", "s", len(t or "")) for d, t in own + copies + near + passages + leaks + junk]
    folder = tmp_path / "sf"
    spark.createDataFrame(rows, COLUMNS).repartition(5, "doc_id").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, f in corpus_pipeline.STAGES[:4]:
        f(spark, docs, str(folder)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    assert set(kept["language_id"]) == {r[0] for r in rows} - {700, 701, 702}
    # Copies lose all their lines; a near copy keeps the lines about its change; of the passage one stays whole.
    assert set(kept["line_dedup"]) == set(kept["language_id"]) - {d for d, _ in copies}
    whole = passage.split("\n")
    assert sum("\n".join(whole[1:-1]) in kept["line_dedup"][d] for d, _ in passages) == 1
    assert all(kept["line_dedup"][d] == t for d, t in own + leaks)
    assert set(kept["simhash"]) == set(kept["line_dedup"])  # what near copies have left is too little to be near
    assert set(kept["decontamination"]) == set(kept["simhash"]) - {d for d, _ in leaks}
    again = stage("simhash")(spark, spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 500"), str(folder))
    near_of = {400 + k: 20 + k for k in range(15)}
    seen = Counter(near_of.get(r.doc_id, r.doc_id - 300 if 300 <= r.doc_id < 400 else r.doc_id) for r in again.collect())
    assert seen == Counter({d: 1 for d, _ in own})  # one of each pair of copies and near copies
    packed = corpus_pipeline.run(spark, str(folder)).collect()
    assert {r.doc_id for r in packed} == set(kept["decontamination"])


def test_entry_imports_again():
    assert importlib.reload(__spark_entry__).queries()
