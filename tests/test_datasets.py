"""Annotations, splits, dataset assembly, quality checks, results, inference, pixels, sources."""

import json
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pandas as pd
import pytest
import yaml
from pyspark.sql import functions as F

from boxtide.operators import annotations, dataset, inference, pixels, quality, results, splits
from boxtide.sources import documents

DOC = {
    "images": [{"id": k, "file_name": f"{k:012d}.jpg", "width": 640, "height": 480} for k in (1, 2, 3)] + [{"id": 4, "file_name": "x", "width": 0, "height": 0}],
    "annotations": [
        {"image_id": 1, "category_id": 3, "bbox": [10, 10, 64, 48], "iscrowd": 0},
        {"image_id": 1, "category_id": 2, "bbox": [-10, -10, 20, 20]},
        {"image_id": 1, "category_id": 2, "bbox": [1, 1, 5, 5], "iscrowd": 1},
        {"image_id": 2, "category_id": 2, "bbox": [1, 1, 0, 5]},
        {"image_id": 2, "category_id": 2, "bbox": [1, 1, 5]},
        {"image_id": 2, "category_id": 99, "bbox": [1, 1, 5, 5]},
        {"image_id": 2, "category_id": 8, "bbox": [700, 1, 5, 5]},
        {"image_id": 4, "category_id": 8, "bbox": [7, 1, 5, 5]},
    ],
    "categories": [{"id": k, "name": f"c{k}"} for k in (2, 3, 4, 6, 8, 99)],
}


@pytest.fixture(scope="module")
def doc(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("doc") / "a.json"
    path.write_text(json.dumps(DOC, indent=1))
    return documents.annotation_document(spark, str(path))


def test_annotation_filter(doc):
    images, anns, _ = doc
    assert {r.reason: r.n for r in annotations.reason_counts(anns).collect()} == {"kept": 4, "iscrowd": 1, "invalid_bbox": 2, "unselected_class": 1}
    assert [r[0] for r in documents.image_ids(images).collect()] == [1, 2, 3, 4]


def test_label_files_and_stats(doc):
    images, anns, _ = doc
    files = annotations.label_files(annotations.converted(anns, images)).collect()
    assert [(r.file_name, r.lines) for r in files] == [("000000000001.txt", ["0 0.007812 0.010417 0.015625 0.020833", "1 0.065625 0.070833 0.100000 0.100000"])]
    stats = annotations.conversion_stats(anns, images).first().asDict()
    assert stats == {"label_files_written": 1, "label_lines_written": 2, "labels_clipped": 1, "labels_dropped_zero_area": 1, "label_files_skipped_no_dims": 1, "label_files_skipped_no_anns_left": 1}
    with pytest.raises(ValueError, match=r"\[2, 3, 4\]"):
        annotations.require_all_classes(annotations.converted(anns, images), 5)


def test_clamped_conversion_keeps_empty_images(doc):
    images, anns, cats = doc
    sized = images.where("id < 4")
    rows = annotations.converted_clamped(anns, sized, cats, []).collect()
    assert {r.image_id for r in rows} == {1, 2, 3} and {r.class_id for r in rows if r.image_id == 1} == {0, 1}
    assert {r.image_id for r in annotations.converted_clamped(anns, sized, cats, [3, 77]).collect()} == {3}


def test_class_counts(spark, doc):
    _, anns, cats = doc
    counts = annotations.class_counts(anns, cats.select(F.col("id").alias("category_id")), 0.5)
    assert {r.category_id: (r.instances, r.images, r.expected) for r in counts.collect()} == {2: (1, 1, 0), 3: (1, 1, 0), 4: (0, 0, 0), 6: (0, 0, 0), 8: (2, 2, 1), 99: (1, 1, 0)}
    assert annotations.not_viable(counts, 1).count() == 5


def test_splits(spark):
    ids = spark.range(1, 1001).select("id")
    exact = splits.exact_split(list(range(1, 1001)), 0.1, 1, 42)
    assert exact == splits.exact_split(list(range(1000, 0, -1)), 0.1, 1, 42) and (len(exact.labelled_train), len(exact.labelled_inner_val), len(exact.unlabelled)) == (90, 10, 900)
    a, b = (splits.split(d, 0.1, 1, 42).orderBy("id").collect() for d in (ids, ids.repartition(13)))
    assert a == b and {p: sum(r.part == p for r in a) for p in ("labeled_train", "labeled_inner_val", "unlabeled")} == {"labeled_train": 90, "labeled_inner_val": 10, "unlabeled": 900}
    assert splits.labelled_count(25, 0.1) == 2 and splits.labelled_count(3, 0.01) == 1
    for labelled, fraction, text in ((9, 0.1, "10"), (20, 0.0, "val_fraction"), (20, 1.0, "val_fraction"), (10, 0.99, "left")):
        with pytest.raises(ValueError, match=text):
            splits.validation_count(labelled, fraction)
    splits.require_partition(ids.where("id < 5"), ids.where("id >= 5"), ids)
    with pytest.raises(ValueError, match="share 4"):
        splits.require_partition(ids.where("id < 5"), ids, ids)
    assert splits.labelled_data(splits.split(ids, 0.1, 0, 1), ids.limit(3)).count() == 1003


def paths(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "path string")


def test_dataset_assembly(spark, tmp_path):
    img = lambda *i: spark.createDataFrame([(x,) for x in i], "image_id string")
    labels = spark.createDataFrame([("a", "0 1 1 1 1"), ("v", "1 1 1 1 1")], "image_id string, line string")
    pseudo = spark.createDataFrame([("u", "2 1 1 1 1"), ("a", "3 1 1 1 1"), ("flat", None)], "image_id string, line string")
    rows = {(r.partition, r.image_id): r.lines for r in dataset.assemble(img("a"), img("v"), labels, pseudo).collect()}
    assert rows == {("train", "a"): ["0 1 1 1 1", "3 1 1 1 1"], ("train", "u"): ["2 1 1 1 1"], ("train", "flat"): [], ("val", "v"): ["1 1 1 1 1"]}
    written = dataset.write_label_files(dataset.assemble(img("a"), img("v"), labels, pseudo), str(tmp_path / "labels")).collect()
    assert len(written) == 3 and (tmp_path / "labels/train/a.txt").read_text() == "0 1 1 1 1\n3 1 1 1 1\n" and not (tmp_path / "labels/train/flat.txt").exists()
    back = documents.label_lines(spark, str(tmp_path / "labels"))
    assert {(r.stem, r.class_id) for r in documents.label_boxes(back).collect()} == {("a", 0), ("a", 3), ("u", 2), ("v", 1)}


def test_image_resolution(spark):
    found = dataset.resolved_images(spark.createDataFrame([("a",), ("b",)], "image_id string"), paths(spark, "/l/a.png", "/l/a.jpg"), paths(spark, "/u/a.jpg", "/u/b.jpeg", "/u/b.png")).collect()
    assert {r.image_id: r.path for r in found} == {"a": "/l/a.jpg", "b": "/u/b.jpeg"}
    with pytest.raises(FileNotFoundError, match="zz"):
        dataset.resolved_images(spark.createDataFrame([("zz",)], "image_id string"), paths(spark, "/l/a.png"), paths(spark, "/u/a.jpg"))


def test_dataset_checks(spark):
    s = lambda *x: spark.createDataFrame([(v,) for v in x], "stem string")
    good = dict(train=s("a"), inner_val=s("v"), labelled_files=s("a", "v"), unlabelled_files=s("u"), pseudo=s("u"), same_folder=False, unlabelled=s("u"))
    dataset.validate(**good)
    for change, text in (({"inner_val": s("a")}, "training: a"), ({"inner_val": s("u")}, "unlabelled: u"), ({"unlabelled_files": s("v")}, "folder: v"), ({"pseudo": s("v")}, "pseudo-label.*v"), ({"same_folder": True, "unlabelled": s("a")}, "unlabelled: a")):
        with pytest.raises(ValueError, match=text):
            dataset.validate(**(good | change))


def test_dataset_yaml():
    body = yaml.safe_load(dataset.dataset_yaml("/d", 3, has_val=False))
    assert body == {"path": "/d", "train": "images/train", "val": "images/train", "nc": 3, "names": ["0", "1", "2"]}
    with pytest.raises(ValueError):
        dataset.dataset_yaml("/d", 3, ["a"])


def status(report):
    return [(r.check, r.part, r.status, r.n_bad) for r in report.collect()]


def test_quality_checks(spark):
    ids = lambda *x: spark.createDataFrame([(v,) for v in x], "id long")
    assert status(quality.stats_document(spark, "{"))[0][2:] == ("FAIL", 1) and status(quality.stats_document(spark, None))[0][2] == "FAIL"
    assert status(quality.stats_document(spark, json.dumps(dict.fromkeys(quality.STATS_KEYS, 0))))[0][2] == "OK"
    listing = spark.createDataFrame([("a", True), ("b", False)], "path string, resolved boolean")
    assert [s[2:] for s in status(quality.links(listing, 3, "train"))] == [("FAIL", 1), ("FAIL", 1)]
    assert [s[2:] for s in status(quality.pairing(paths(spark, "/i/a.jpg", "/i/b.jpg"), paths(spark, "/l/b.txt", "/l/c.txt"), "train"))] == [("FAIL", 1), ("FAIL", 1)]
    assert [s[2] for s in status(quality.label_paths(paths(spark, "/d/images/a.jpg"), paths(spark, "/d/labels/a.txt"), "/d/labels", "val"))] == ["OK", "OK"]
    lines = spark.createDataFrame([("p", "0 .5 .5 .1 .1"), ("p", "7 .5 .5 .1 .1"), ("q", "0 .5 .5 .1"), ("q", "1 1.2 .5 .1 0"), ("q", "  "), ("r", "a\t.5  .5 nan .1")], "path string, line string")
    assert [s[3] for s in status(quality.label_lines(lines, [0, 1], "train"))] == [2, 3]
    assert [s[2] for s in status(quality.partitions(ids(1), ids(2), ids(3), ids(1, 2)))] == ["OK"] * 4
    assert [s[3] for s in status(quality.partitions(ids(1), ids(1), ids(1), ids(1, 2)))] == [1, 1, 1, 1]
    got = status(quality.presence(ids(1, 2), ids(3), paths(spark, "/i/000000000001.jpg"), paths(spark, "/l/000000000002.txt")))
    assert [s[3] for s in got] == [1, 1, 1]
    cover = quality.coverage(spark.createDataFrame([(0,), (2,)], "class_id int"), [0, 1, 2], "train", bad="WARN")
    assert cover.first().sample == ["1"] and quality.exit_code(cover) == 0 and quality.exit_code(cover, strict=True) == 1


def test_split_documents_round_trip(spark, tmp_path):
    ids = spark.range(300).select("id")
    rows = splits.split(ids, 0.1, 0, 42).withColumn("ratio", F.lit(0.1)).withColumn("fold", F.lit(0))
    headers = spark.createDataFrame([("coco_fold0_10pct.json", 0.1, 0, 42, "now"), ("none.json", 0.5, 1, 42, "now")], "name string, ratio double, fold int, seed long, created_at string")
    got = {r.name: r.value for r in splits.split_documents(rows, headers).collect()}
    header, back = documents.split_document(spark, got["coco_fold0_10pct.json"])
    assert (header["seed"], header["n_labeled_train"], header["n_labeled_inner_val"], header["n_unlabeled"], header["n_labeled"]) == (42, 27, 3, 270, 30)
    own = {(r.id, r.part) for r in rows.collect()}
    assert {tuple(r) for r in back.collect()} == own | {(i, "labeled") for i, part in own if part != "unlabeled"}
    assert json.loads(got["none.json"])["unlabeled_ids"] == []
    docs = splits.split_documents(rows, headers.drop("created_at"), spark.range(5).select("id"))
    assert splits.write_split_documents(docs, f"{tmp_path}/splits").count() == 2
    headers, ids = documents.split_files(spark, f"{tmp_path}/splits")
    assert {r.name: (r.fold, r.n_labeled, r.created_at is not None) for r in headers.collect()} == {"coco_fold0_10pct.json": (0, 30, True), "none.json": (1, 0, True)}
    read = {(r.id, r.part) for r in ids.where("name = 'coco_fold0_10pct.json'").collect()}
    assert read == {tuple(r) for r in back.collect()} | {(k, "val") for k in range(5)}
    (tmp_path / "splits/odd.json").write_text('{"ratio": 0.1}')
    with pytest.raises(ValueError, match="odd.json has no field 'fold'"):
        documents.split_files(spark, f"{tmp_path}/splits")


def test_results(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r/m1.json").write_text(json.dumps([{"map50": 0.5, "map50_95": 0.3, "round_id": 1, "per_class": {"car": 0.4}, "checkpoint": "c", "n_images": 9}, {"map50": 0.5, "map50_95": 0.4, "round_id": 2}]))
    (tmp_path / "r/m2.json").write_text(json.dumps({"map50": 0.7, "map50_95": 0.2, "round_id": 2}))
    (tmp_path / "r/broken.json").write_text("[{")
    with pytest.warns(UserWarning, match="broken"):
        rows = documents.eval_results(spark, str(tmp_path / "r")).persist()
    assert {(r.method, r.round_id) for r in rows.where("map50 is not null").collect()} == {("m1", 1), ("m1", 2), ("m2", 2)}
    rows = rows.where("map50 is not null")
    assert [tuple(r) for r in results.round_table(rows).collect()] == [(1, "0.5000", "N/A"), (2, "0.5000", "0.7000")]
    assert [(r.method, r.round_id) for r in results.best_rounds(rows).collect()] == [("m1", 1), ("m2", 2)]
    folds = rows.withColumn("fold", F.col("method"))
    assert tuple(results.fold_summary(folds).first()) == (pytest.approx(0.6), pytest.approx(0.1414213562), 2)
    assert tuple(results.fold_summary(folds.where("fold = 'm1'")).first())[:2] == (0.5, 0.0) and tuple(results.fold_summary(folds.limit(0)).first())[:2] == (0.0, 0.0)
    assert results.write_results_csv(rows, f"{tmp_path}/csv") and not results.write_results_csv(rows.limit(0), f"{tmp_path}/none")
    assert spark.read.csv(f"{tmp_path}/csv", header=True).columns == ["method", "round_id", "map50", "map50_95", "checkpoint", "n_images"]


def test_split_document(spark):
    doc = {"ratio": 0.1, "fold": 0, "seed": 1, "n_labeled": 1, "n_unlabeled": 1, "labeled_ids": [1], "unlabeled_ids": [2], "val_ids": [3], "created_at": "x"}
    header, ids = documents.split_document(spark, json.dumps(doc))
    assert header["fold"] == 0 and {(r.id, r.part) for r in ids.collect()} == {(1, "labeled"), (2, "unlabeled"), (3, "val")}
    with pytest.raises(ValueError, match="val_ids"):
        documents.split_document(spark, json.dumps({k: v for k, v in doc.items() if k != "val_ids"}))
    assert documents.is_filtered_split({"class_names": [], "image_dir_train": ""}) and not documents.is_filtered_split({})


def test_image_listing(spark, tmp_path):
    for n in ("a.jpg", "b.PNG", "c.txt"):
        (tmp_path / n).write_bytes(b"x")
    files = documents.image_files(spark, str(tmp_path))
    assert {r.stem for r in files.collect()} == {"a", "b"}
    with pytest.raises(FileNotFoundError, match="nowhere"):
        documents.require_paths(paths(spark, "nowhere"), files)


def test_detector_contract(spark):
    images = spark.createDataFrame([(f"i{k:02d}",) for k in range(20)], "image_id string")

    def detector(batch: pd.DataFrame) -> pd.DataFrame:
        assert len(batch) <= 8 and list(batch.image_id) == sorted(batch.image_id)
        rows = [(i, 0, 1.0, 2.0, 3.0, 4.0, 1, [0.1, 0.9], 0.9) for i in batch.image_id if i != "i05"]
        return pd.DataFrame(rows, columns=["image_id", "det_index", "x1", "y1", "x2", "y2", "pred_class", "class_scores", "confidence"])

    a, b = (inference.detect(d, detector, 3).orderBy("image_id").collect() for d in (images, images.orderBy(F.desc("image_id")).union(images)))
    assert a == b and len(a) == 19 and a[0].box_id == "i00_r3_0000" and a[0].box.x2 == 3.0
    pool = inference.nested_pool(images, inference.detect(images, detector, 3))
    assert pool.where("size(boxes) = 0").count() == 1 and inference.flat_pool(pool).count() == 19


def detector_parts():
    """A detector that finds a box in all images but one, and what decodes files; made here, so that tasks get them whole."""

    def boxes_of(batch):
        rows = [{"det_index": 0, "x1": 1, "y1": 2, "x2": 3, "y2": float(x.sum()), "pred_class": 1, "class_scores": [0.1, 0.9], "confidence": 0.9} for x in batch.pixels]
        return [pd.DataFrame([r]).iloc[: int(i != "i05")] for i, r in zip(batch.image_id, rows)]

    def decoded(content):
        return np.frombuffer(content, np.uint8).reshape(2, 2, 3) if len(content) == 12 else None

    return boxes_of, decoded


def image_folder(spark, tmp_path, n=20):
    for k in range(n):
        (tmp_path / f"i{k:02d}.jpg").write_bytes(bytes([k] * 12))
    return spark.createDataFrame([(f"i{k:02d}", f"{tmp_path}/i{k:02d}.jpg") for k in reversed(range(n))], "image_id string, path string")


def test_detection_from_files_moves_no_pixels(spark, tmp_path):
    paths, (boxes_of, decoded) = image_folder(spark, tmp_path), detector_parts()
    seen = spark.sparkContext.accumulator(0)

    def detector(batch):
        assert len(batch) <= 8 and list(batch.image_id) == sorted(batch.image_id) and int(batch.image_id.iloc[0][1:]) % 8 == 0
        seen.add(len(batch))
        return boxes_of(batch)

    for run in (200, 8):
        pool = inference.detect_files(paths.union(paths), decoded, detector, 3, run=run)
        rows = sorted(pool.collect(), key=lambda r: r.image_id)
        assert len(rows) == 19 and rows[0].box_id == "i00_r3_0000" and rows[7].box.y2 == 12 * 8
    assert seen.value == 40
    plan = pool._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "Exchange" not in plan.split("MapInPandas")[0] and "content" not in plan and "pixels" not in plan
    runs = {"8": 8, "32": 32}
    report = inference.compared_runs({k: inference.detect_files(paths, decoded, boxes_of, 3, n) for k, n in runs.items()}).collect()
    assert [(r.run, r.n_boxes, r.same) for r in report] == [("8", 19, True), ("32", 19, True)]
    other = inference.compared_runs({"a": pool, "b": pool.withColumn("confidence", F.col("confidence") + 1e-6), "c": pool.withColumn("confidence", F.col("confidence") + 1e-10), "d": pool.limit(0)})
    assert [r.same for r in other.orderBy("run").collect()] == [True, False, True, False]


def test_detectors_that_do_not_fit_are_refused(spark, tmp_path):
    paths, (boxes_of, decoded) = image_folder(spark, tmp_path, 5), detector_parts()
    empty = inference.detect_files(paths.limit(0), decoded, boxes_of, 1)
    assert empty.count() == 0
    with pytest.raises(Exception, match="4 results for 5 images"):
        inference.detect_files(paths, decoded, lambda b: boxes_of(b)[1:], 1).collect()
    with pytest.raises(Exception, match="elsewhere, which is not in its batch"):
        inference.detect_files(paths, decoded, lambda b: boxes_of(b)[0].assign(image_id="elsewhere"), 1).collect()
    with pytest.raises(Exception, match="4 results for 5 images"):
        inference.detect(paths, lambda b: [boxes_of(b.assign(pixels=[np.zeros(3)] * len(b)))[0]] * 4, 1).collect()
    (tmp_path / "i03.jpg").write_bytes(b"short")
    with pytest.raises(Exception, match="unreadable image .*i03.jpg"):
        inference.detect_files(paths, decoded, boxes_of, 1).collect()


def test_a_document_is_read_in_ranges(spark, tmp_path):
    """Nested objects, braces, quotes and escapes in strings, arrays that hold no object: all ranges give what a parser gives."""
    import random

    from boxtide.sources.ranges import array_objects

    rng = random.Random(3)
    odd = ["a", "}", "{", "[", "]", '"', "\\", '\\"', "},{", ' "x": [{', "é", "\n", "\\u0041"]
    text = lambda: "".join(rng.choice(odd) for _ in range(rng.randint(0, 9)))
    value = lambda depth=0: rng.choice([rng.randint(0, 99), text(), None, 1.5, [text(), {"k": text()}] if depth < 3 else [], {text(): value(depth + 1), "n": [value(depth + 1)]} if depth < 3 else {}])
    docs = {}
    for k in range(6):
        doc = {"info": {"a": {"b": {"c": text()}}, "l": [{"x": 1}]}, "none": [], "licences": text()}
        for key in ("images", "annotations", "categories"):
            doc[key] = [{"id": i, "v": value(), "segmentation": [[1, 2], [text()]]} for i in range(rng.randint(0, 60))]
            doc["mixed" + key] = [[1, {"in": "array"}], {"own": 1}, 5, [[{"deep": 2}]], {"last": text()}]
        docs[f"{k}.json"] = doc
        (tmp_path / f"{k}.json").write_text(json.dumps(doc, indent=k % 3 or None, ensure_ascii=bool(k % 2)), encoding="utf-8")
    want = {(f, key, i): x for f, d in docs.items() for key, v in d.items() if isinstance(v, list) for i, x in enumerate([x for x in v if isinstance(x, dict)])}
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    for most in (before, "700", "4k"):
        spark.conf.set(name, most)
        try:
            rows = array_objects(spark, str(tmp_path)).collect()
            ranges = spark.read.text(str(tmp_path), lineSep="}").rdd.getNumPartitions()
        finally:
            spark.conf.set(name, before)
        assert most == before or ranges > 10
        assert len(rows) == len(want) and {(r.file.rpartition("/")[2], r.key, r.position): json.loads(r.json) for r in rows} == want


def test_objects_that_follow_each_other_share_rows(spark, tmp_path):
    """Runs are far fewer than objects, in documents of one range and of many, and hold each once and in place."""
    from boxtide.sources import ranges

    doc = {"a": [{"i": i, "t": "}" * (i % 3)} for i in range(9000)], "b": [[{"no": 1}], {"i": 0}, {"i": 1}], "c": [{"i": i} for i in range(3)]}
    (tmp_path / "x.json").write_text(json.dumps(doc))
    (tmp_path / "y.json").write_text(json.dumps({"c": [{"i": 0}]}))
    want = sorted((f, k, x["i"]) for f, d in (("x", doc), ("y", {"c": [{"i": 0}]})) for k, v in d.items() for x in v if isinstance(x, dict))
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    for most, n in ((before, 9), ("40k", 20)):
        spark.conf.set(name, most)
        try:
            rows = ranges.array_runs(spark, str(tmp_path)).collect()
        finally:
            spark.conf.set(name, before)
        assert len(rows) <= n
        got = [(r.file[-6], r.key, r.position + k, json.loads(x)["i"]) for r in rows for k, x in enumerate(r.json)]
        assert all(i == at for _, _, at, i in got) and sorted(g[:3] for g in got) == want


def test_ranges_of_annotations(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(DOC, indent=1))
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and a.schema.simpleString() == b.schema.simpleString()
    assert all(same(a, b) for a, b in zip(documents.annotation_ranges(spark, str(tmp_path)), documents.annotation_document(spark, str(tmp_path))))
    (tmp_path / "a.json").write_text('{"images": [{"id": "no number"}]}')
    with pytest.raises(Exception, match="MALFORMED|malformed|FAILFAST|parse"):
        documents.annotation_ranges(spark, str(tmp_path))[0].collect()


def grid_by_force(group, boxes, of_group, anchors):
    d2 = ((boxes[:, None] - anchors[None]) ** 2).sum(2)
    d2[group[:, None] != of_group[None]] = np.inf
    near = d2.argmin(1)
    return np.where(np.isfinite(d2.min(1)), near, -1), d2.min(1)


@pytest.mark.parametrize("seed", range(8))
def test_nearest_in_grid_is_exact(seed):
    """Scattered, clustered and equal anchors, boxes far outside of them, groups without anchors or with one."""
    rng = np.random.default_rng(seed)
    n, m = 120, 260
    group, of_group = rng.integers(0, 6, n), np.minimum(rng.integers(0, 5, m), 4)
    of_group[of_group == 3] = 2
    of_group[0] = 3
    span = (640, 1, 3, 1e-3)[seed % 4]
    anchors = np.round(rng.random((m, 4)) * span, 0 if seed % 4 == 2 else 12)
    boxes = np.round((rng.random((n, 4)) * 3 - 1) * span, 0 if seed % 4 == 2 else 12)
    if seed > 3:
        anchors[: m // 2, :2] = anchors[0, :2]
        boxes[0] = 1e6
    want, far = grid_by_force(group, boxes, of_group, anchors)
    for at_once in (1, 50, 1 << 20):
        near, d2, _ = inference.nearest_in_grid(group, boxes, of_group, anchors, at_once)
        assert near.tolist() == want.tolist() and np.array_equal(d2, far)
    assert inference.nearest_in_grid(group[:0], boxes[:0], of_group, anchors)[2] == inference.nearest_in_grid(group, boxes, of_group[:0], anchors[:0])[2] == 0


def test_nearest_anchors_touch_few_pairs():
    """8,400 anchors and 300 boxes that a detector made of them: of 2.5 million pairs a fiftieth at most."""
    rng = np.random.default_rng(1)
    anchors = np.concatenate([np.stack(np.meshgrid(np.arange(s / 2, 640, s), np.arange(s / 2, 640, s)), -1).reshape(-1, 2) for s in (8, 16, 32)])
    assert len(anchors) == 8400
    half = rng.random((8400, 2)) * 60 + 4
    anchors = np.concatenate([anchors - half, anchors + half], 1)
    boxes = anchors[rng.choice(8400, 300)] + rng.normal(0, 0.5, (300, 4))
    zero = np.zeros(8400, int)
    near, d2, touched = inference.nearest_in_grid(zero[:300], boxes, zero, anchors)
    want, far = grid_by_force(zero[:300], boxes, zero, anchors)
    assert near.tolist() == want.tolist() and touched <= 300 * 8400 / 50


def test_nearest_anchors_on_odd_rows(spark):
    nan = float("nan")
    side = "struct<x1:double,y1:double,x2:double,y2:double>"
    kept = spark.createDataFrame(
        [("a", 0, (0.0, 0.0, 9.0, 9.0), 640, 640), ("a", 1, None, 640, 640), ("a", 2, (nan, 0.0, 1.0, 1.0), 640, 640), ("b", 0, (1.0, 1.0, 2.0, 2.0), 640, 640), ("c", 0, (1.0, 1.0, 2.0, 2.0), 640, 640), (None, 0, (1.0, 1.0, 2.0, 2.0), 640, 640)],
        f"image_id string, det_index int, box {side}, width int, height int",
    )
    anchors = spark.createDataFrame(
        [("a", 7, (0.0, 0.0, 9.0, 9.0), [1.0]), ("a", 5, (0.0, 0.0, 9.0, 9.0), [2.0]), ("a", 3, (500.0, 0.0, 9.0, 9.0), [3.0]), ("b", 1, None, [4.0]), (None, 1, (1.0, 1.0, 2.0, 2.0), [5.0])],
        f"image_id string, anchor_id int, anchor_box {side}, class_scores array<double>",
    ).withColumn("is_box", F.lit("another"))
    got = inference.nearest_anchors(kept, anchors)
    assert dict(got.dtypes)["det_index"] == dict(got.dtypes)["anchor_id"] == "int"
    assert sorted((r.image_id, r.det_index, r.anchor_id, r.distance, r.class_scores[0]) for r in got.collect() if r.distance is not None) == [("a", 0, 5, 0.0, 2.0)]
    assert sorted((r.image_id, r.det_index, r.anchor_id, r.class_scores[0]) for r in got.collect() if r.distance is None) == [("a", 1, 3, 3.0), ("a", 2, 3, 3.0), ("b", 0, 1, 4.0)]
    assert inference.nearest_anchors(kept.where("false"), anchors).count() == inference.nearest_anchors(kept, anchors.where("false")).count() == 0


def test_nearest_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8))
    x[7] = x[3]
    v = spark.createDataFrame([(k, [float(y) for y in r]) for k, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    for block in (4096, 7):
        got = {r.query: (r.nearest, r.distance) for r in inference.nearest_vectors(v.where("vec_id % 10 < 4"), v, queries_at_once=block).collect()}
        assert all(got[k] == (int(d[k].argmin()), pytest.approx(float(np.sqrt(d[k].min())))) for k in got) and len(got) == 120


def test_pixels(spark):
    img = np.random.default_rng(0).integers(0, 256, (48, 64, 3), dtype=np.uint8)
    moved = pixels.transform_pixels(img, "translate")
    assert (moved[8:, 8:] == img[:-8, :-8]).all() and (moved[:8] == 0).all()
    assert (pixels.transform_pixels(img, "brightness") == np.clip(img.astype(np.float32) * 1.1, 0, 255).astype(np.uint8)).all()
    flat = np.full((40, 40, 3), 90, np.uint8)
    assert (pixels.transform_pixels(flat, "scale")[2:-2, 2:-2] == 90).all()
    df = spark.createDataFrame([("a", 64, 48, img.tobytes()), ("b", 4, 4, None)], "image_id string, width int, height int, pixels binary")
    rows = {r.image_id: r.pixels for r in pixels.transform_images(df, "translate").collect()}
    assert rows["a"] == moved.tobytes() and rows["b"] is None
    with pytest.raises(ValueError, match="shear"):
        pixels.transform_images(df, "shear")


def test_numbers_and_bounds(spark, monkeypatch):
    from boxtide.operators.ordering import numbered_by

    rows = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5000).alias("k"))
    assert numbered_by(rows, "k").where("position <> k").count() == 0
    assert numbered_by(rows.where("false"), "k").count() == 0
    monkeypatch.setattr(splits, "MOST_EXACT", 20)
    with pytest.raises(ValueError, match="split"):
        splits.exact_split(list(range(21)), 0.5, 0, 42)


def test_images_are_decoded_where_read_and_unreadable_ones_are_named(spark, tmp_path):
    (tmp_path / "a.JPG").write_bytes(bytes(range(12)))
    (tmp_path / "b.txt").write_bytes(b"no image")
    decode = lambda content: np.frombuffer(content, np.uint8).reshape(2, 2, 3) if len(content) == 12 else None
    rows = documents.decoded_images(spark, str(tmp_path), decode, at_once=1).collect()
    assert [(r.image_id, r.width, r.height, bytes(r.pixels)) for r in rows] == [("a", 2, 2, bytes(range(12)))]
    (tmp_path / "c.png").write_bytes(b"short")
    with pytest.raises(Exception, match="unreadable image .*c.png"):
        documents.decoded_images(spark, str(tmp_path), decode).collect()


def test_dataset_is_checked_then_written(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.jpg").write_bytes(name.encode())
    files = spark.createDataFrame([("train", "a", ["0 0.5 0.5 0.1 0.1"]), ("val", "b", []), ("train", "gone", [])], "partition string, image_id string, lines array<string>")
    images = spark.createDataFrame([(n, f"file://{tmp_path}/{n}.jpg") for n in ("a", "b", "gone")], "image_id string, path string")
    stems = lambda *x: spark.createDataFrame([(i,) for i in x], "stem string")
    checked = {"train": stems("a"), "inner_val": stems("b"), "labelled_files": stems("a"), "unlabelled_files": stems("c"), "pseudo": stems("c"), "same_folder": False}
    where = tmp_path / "set"
    for _ in range(2):  # the second replaces the first
        assert dataset.write_dataset(files, images, str(where), 1, **checked) == f"{where}/dataset.yaml"
        (where / "old").write_text("")
    dataset.write_dataset(files, images, str(where), 1, **checked)
    found = sorted(str(p.relative_to(where)) for p in where.rglob("*") if p.is_file())
    assert found == ["dataset.yaml", "images/train/a.jpg", "images/val/b.jpg", "labels/train/a.txt"]
    with pytest.raises(ValueError):
        dataset.write_dataset(files, images, str(where), 1, **(checked | {"inner_val": stems("a")}))
    assert (where / "dataset.yaml").exists()


def test_a_dataset_that_fails_leaves_the_old_one(spark, tmp_path, monkeypatch):
    (tmp_path / "a.jpg").write_bytes(b"a")
    files = lambda line: spark.createDataFrame([("train", "a", [line])], "partition string, image_id string, lines array<string>")
    images = spark.createDataFrame([("a", f"{tmp_path}/a.jpg"), ("b", None)], "image_id string, path string")
    stems = lambda *x: spark.createDataFrame([(i,) for i in x], "stem string")
    checked = {"train": stems("a"), "inner_val": stems("b"), "labelled_files": stems("a"), "unlabelled_files": stems("c"), "pseudo": stems("c"), "same_folder": False}
    where = tmp_path / "set"
    write = lambda line, **more: dataset.write_dataset(files(line), images, str(where), 1, **checked, **more)
    read = lambda: sorted((str(p.relative_to(where)), p.read_text()) for p in where.rglob("*") if p.is_file() and p.suffix != ".crc")
    write("0 1")
    whole = read()
    assert ("labels/train/a.txt", "0 1\n") in whole and [p.name for p in tmp_path.iterdir() if p.is_dir()] == ["set"]

    def ended(*_):
        raise OSError("ended")

    for step in ("copy_files", "write_label_files", "write_text"):
        with monkeypatch.context() as m:
            m.setattr(dataset, step, ended)
            with pytest.raises(OSError, match="ended"):
                write("0 2")
        assert read() == whole and [p.name for p in tmp_path.iterdir() if p.is_dir()] == ["set"]
    moves = []

    def second_fails(spark_, source, target):
        moves.append(source)
        if len(moves) == 2:
            raise OSError("ended")
        return dataset_rename(spark_, source, target)

    dataset_rename = dataset.rename
    with monkeypatch.context() as m:
        m.setattr(dataset, "rename", second_fails)
        with pytest.raises(OSError, match="ended"):
            write("0 2")
    assert not where.exists() and (tmp_path / "set.old/dataset.yaml").exists()
    write("0 3")
    assert ("labels/train/a.txt", "0 3\n") in read() and not (tmp_path / "set.old").exists()
    gone = spark.createDataFrame([("train", "a", ["0 1"]), ("train", "b", [])], "partition string, image_id string, lines array<string>")
    with pytest.warns(UserWarning, match="1 images have no file, such as b"):
        dataset.write_dataset(gone, images, str(where), 1, **checked)
    with pytest.raises(FileNotFoundError, match="1 images have no file"):
        dataset.write_dataset(gone, images, str(where), 1, require_all=True, **checked)


def test_paths_mean_what_spark_means(spark, tmp_path):
    from boxtide.session import full_uri, shared_dir
    from boxtide.sources.files import default_root, located

    assert full_uri(spark, f"{tmp_path}/x/") == f"file://{tmp_path}/x" == full_uri(spark, f"file:{tmp_path}/x") and default_root(spark) == "file://"
    assert located(f"{tmp_path}/x", default_root(spark))[1] == f"{tmp_path}/x" == located(f"file:{tmp_path}/x", "")[1]
    named = SimpleNamespace(conf={"spark.checkpoint.dir": f"{tmp_path}/shared/"}, _jvm=spark._jvm, _jsc=spark._jsc)
    assert shared_dir(named) == f"file://{tmp_path}/shared"


def test_copies_keep_targets_and_pass_over_missing_sources(spark, tmp_path):
    (tmp_path / "a").write_text("new")
    (tmp_path / "kept").write_text("old")
    pairs = spark.createDataFrame([(f"{tmp_path}/a", f"{tmp_path}/x/a"), (f"{tmp_path}/a", f"{tmp_path}/kept"), (f"{tmp_path}/none", f"{tmp_path}/y")], "source string, target string")
    assert sorted(r.outcome for r in dataset.copy_files(pairs).collect()) == ["copied", "kept", "missing"]
    assert (tmp_path / "x/a").read_text() == "new" and (tmp_path / "kept").read_text() == "old" and not (tmp_path / "y").exists()


def test_evaluation_arguments_are_checked(spark):
    images = spark.createDataFrame([("a.jpg",), ("b.png",)], "path string")
    run = lambda c: {"map50": 0.5, "checkpoint": c}
    assert results.evaluate_checked(run, "c", images, lambda p: True, 2, ["x", "y"]) == {"map50": 0.5, "checkpoint": "c", "n_images": 1}
    with pytest.raises(ValueError):
        results.evaluate_checked(run, "c", images, lambda p: True, 2, ["x"])
    with pytest.raises(FileNotFoundError):
        results.evaluate_checked(run, "c", images, lambda p: False, 2)


def test_small_files_are_kept_in_archives(spark, tmp_path):
    from boxtide.plans import dataset_queries
    from boxtide.sources import archives

    rows = spark.createDataFrame([(f"{k}.{'JPG' if k % 2 else 'txt'}", f"{k}\r\n\n{k}") for k in range(25)], "name string, content string").repartition(2)
    made = archives.write_archives(rows, str(tmp_path / "all"), most_files=10).collect()
    assert sum(r.files for r in made) == 25 and max(r.files for r in made) == 10 and len(made) <= 4
    (tmp_path / "all" / "stray.zip").write_bytes(b"of a task that Spark did not accept")
    found = archives.archived_contents(spark, str(tmp_path / "all")).collect()
    assert {(r.path.rpartition("!/")[2], r.length, bytes(r.content)) for r in found} == {(r.name, len(r.content), r.content.encode()) for r in rows.collect()}
    assert {r.stem for r in documents.archived_images(spark, str(tmp_path / "all")).collect()} == {str(k) for k in range(1, 25, 2)}
    assert sorted(r.line for r in documents.archived_label_lines(spark, str(tmp_path / "all")).collect()) == sorted(2 * [str(k) for k in range(0, 25, 2)])
    reader = archives.Reader("", most_open=1)
    assert all(reader.read(r.path) == bytes(r.content) for r in found) and len(reader.held) == 1
    archives.write_archives(rows.limit(0), str(tmp_path / "none"))
    assert archives.archived_files(spark, str(tmp_path / "none")).collect() == []

    before = dataset_queries.folder
    try:
        dataset_queries.folder = lambda spark, what: str(tmp_path / what)
        for name in ("label_files_round_trip", "image_listing", "image_scan"):
            getattr(dataset_queries, name)(spark, "/root/testdata/sf0.001")
    finally:
        dataset_queries.folder = before
    assert sum(p.is_file() for p in tmp_path.rglob("*")) < 400  # images are 1,500


def test_missing_classes_deal_no_row_out_by_class(spark):
    lines = spark.range(100).select((F.col("id") % 3).alias("class_id"))
    found = quality.coverage(lines, [0, 1, 2, 3], "val")
    assert [(r.n_bad, r["sample"]) for r in found.collect()] == [(1, ["3"])]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("LeftAnti") < plan.index("Aggregate [class_id", plan.index("LeftAnti"))


def test_long_texts_are_written_from_pieces(spark, tmp_path):
    lines = {"empty": [], "long": ["é" * 20000, "x" * 40000], "even": ["y" * (dataset.PIECE - 1)], "short": ["a", "b"]}
    rows = spark.createDataFrame([("p", k, v) for k, v in lines.items()], "partition string, image_id string, lines array<string>").coalesce(1)
    assert dataset.write_label_files(rows, str(tmp_path), skip_empty=False).count() == 4
    assert {p.stem: p.read_text() for p in (tmp_path / "p").iterdir()} == {k: "".join(f"{x}\n" for x in v) for k, v in lines.items()}
    plan = dataset.write_label_files(rows, str(tmp_path))._jdf.queryExecution().analyzed().toString()
    assert "substring(text" in plan


def test_pixels_of_one_size_are_transformed_together():
    rng = np.random.default_rng(0)
    sizes = [(4, 5), (3, 2), (4, 5), (4, 5)]
    images = [rng.integers(0, 256, (h, w, 3), dtype=np.uint8) for h, w in sizes]
    rows = [("abcd"[k], w, h, images[k].tobytes()) for k, (h, w) in enumerate(sizes)] + [("e", None, None, None)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["image_id", "width", "height", "pixels"])
    for transform in ("scale", "translate", "brightness"):
        got = pixels._transformed(batch, transform)
        assert got["image_id"].to_pylist() == list("abcde")
        assert got["pixels"].to_pylist() == [pixels.transform_pixels(i, transform).tobytes() for i in images] + [None]


def test_compared_files_read_each_image_once(spark, tmp_path):
    """Three runs of a detector over images that are decoded once, in batches of the sizes asked for; a result may be a dict of columns."""
    import uuid

    import numpy as np

    from boxtide.operators import inference

    for where in ("images", "decoded", "asked"):
        (tmp_path / where).mkdir()
    for k in range(70):
        (tmp_path / "images" / f"i{k:03d}.raw").write_bytes(bytes([k]))
    paths = spark.createDataFrame([(f"i{k:03d}", f"file://{tmp_path}/images/i{k:03d}.raw") for k in range(70)], "image_id string, path string").repartition(5)
    decoded, asked = str(tmp_path / "decoded"), str(tmp_path / "asked")

    def decode(content):
        open(f"{decoded}/{uuid.uuid4().hex}", "w").close()
        return np.full((2, 3, 1), content[0], np.uint8)

    def detector(batch, told=False):
        open(f"{asked}/{len(batch)}-{batch.batch_id.iloc[0]}-{uuid.uuid4().hex}", "w").close()
        n, x = len(batch), np.array([p[0, 0, 0] for p in batch.pixels], float)
        assert batch.index.tolist() == batch.place.tolist() and set(batch.width) == {3} and set(batch.height) == {2}
        return {"image_id": batch.image_id.tolist(), "det_index": [0] * n, "x1": x, "y1": x, "x2": x + (n if told else 1), "y2": x + 1, "pred_class": [1] * n, "class_scores": [[0.0, 1.0]] * n, "confidence": [1.0] * n}

    sizes = {"eight": 8, "thirty-two": 32, "again": 8}
    got = {r.run: r for r in inference.compared_files(paths, decode, detector, sizes, 32).collect()}
    assert {k: (r.n_boxes, r.same) for k, r in got.items()} == {k: (70, True) for k in sizes}
    assert len(list((tmp_path / "decoded").iterdir())) == 70
    calls = sorted(p.name.rpartition("-")[0] for p in (tmp_path / "asked").iterdir())
    assert calls == sorted([f"8-{b}" for b in range(8)] * 2 + ["6-8"] * 2 + ["32-0", "32-1", "6-2"])
    alone = inference.run_digest(inference.detect_files(paths, decode, detector, 0, 8, 32)).first()
    assert (got["eight"].n_boxes, got["eight"].digest) == (alone.n_boxes, alone.digest)
    told = {r.run: r.same for r in inference.compared_files(paths, decode, lambda b: detector(b, True), sizes, 32).collect()}
    assert told == {"eight": True, "thirty-two": False, "again": True}
    none = inference.compared_files(paths, decode, lambda b: {c: [] for c in inference.RESULT}, sizes, 32).collect()
    assert {(r.run, r.n_boxes, r.digest, r.same) for r in none} == {(k, 0, "0", True) for k in sizes}
