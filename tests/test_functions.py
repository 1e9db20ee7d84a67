"""Geometry, distributions, names and label text."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from boxtide.functions import distributions as dist
from boxtide.functions import geometry as geo
from boxtide.functions import names
from boxtide.functions.sql import register
from boxtide.functions.text import label_line, six_decimals


def frame(spark, rows, columns):
    return spark.createDataFrame(rows, columns)


def boxed(prefix=""):
    return geo.box(*[F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2")])


def py_iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    meet = max(w, 0) * max(h, 0)
    size = lambda c: max(c[2] - c[0], 0) * max(c[3] - c[1], 0)
    union = size(a) + size(b) - meet
    return 0.0 if meet == 0 or union <= 0 else meet / union


def ious(spark, pairs):
    df = frame(spark, [(*map(float, a), *map(float, b)) for a, b in pairs], "ax1 double, ay1 double, ax2 double, ay2 double, bx1 double, by1 double, bx2 double, by2 double")
    return [r[0] for r in df.select(geo.iou(boxed("a"), boxed("b"))).collect()]


SIDE = st.integers(-20, 20)
BOX = st.tuples(SIDE, SIDE, SIDE, SIDE)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(BOX, BOX), min_size=5, max_size=40))
def test_iou_properties(spark, pairs):
    got, swapped = ious(spark, pairs), ious(spark, [(b, a) for a, b in pairs])
    assert got == swapped and all(0 <= x <= 1 for x in got)
    assert got == pytest.approx([py_iou(a, b) for a, b in pairs])
    scaled = ious(spark, [([3 * x for x in a], [3 * x for x in b]) for a, b in pairs])
    assert got == pytest.approx(scaled)


def test_iou_cases(spark):
    assert ious(spark, [((0, 0, 100, 100), (20, 20, 120, 120)), ((0, 0, 1, 1), (1, 1, 2, 2)), ((5, 5, 5, 5), (5, 5, 5, 5))]) == pytest.approx([6400 / 13600, 0, 0])


def test_remaps(spark):
    df = frame(spark, [(100.0, 100.0, 300.0, 300.0), (-5.0, 470.0, 700.0, 500.0), (650.0, 10.0, 640.0, 20.0)], "x1 double, y1 double, x2 double, y2 double")
    w, h = F.lit(640), F.lit(480)
    got = [[tuple(r[k]) for k in range(3)] for r in df.select(*[geo.remap(boxed(), w, h, t) for t in geo.REMAPS]).collect()]
    assert got[0][1] == (108.0, 108.0, 308.0, 308.0) and got[0][2] == (100.0, 100.0, 300.0, 300.0)
    assert got[0][0] == pytest.approx((320 - 220 * 1.03, 240 - 140 * 1.03, 320 - 20 * 1.03, 240 + 60 * 1.03))
    assert got[1][2] == (0.0, 470.0, 640.0, 480.0) and got[2][2] == (640.0, 10.0, 640.0, 20.0)
    with pytest.raises(ValueError, match="shear"):
        geo.remap(boxed(), w, h, "shear")


def test_two_conversions_differ_off_the_edge(spark):
    df = frame(spark, [(-10.0, -10.0, 20.0, 20.0), (700.0, 0.0, 5.0, 5.0), (0.0, 0.0, 64.0, 48.0)], "x double, y double, w double, h double")
    c = [F.col(k) for k in "xywh"]
    rows = df.select(geo.xywh_to_normalised(*c, F.lit(640), F.lit(480)), geo.xywh_to_clamped(*c, F.lit(640), F.lit(480)), geo.leaves_image(*c, F.lit(640), F.lit(480))).collect()
    assert tuple(rows[0][0]) == pytest.approx((5 / 640, 5 / 480, 10 / 640, 10 / 480)) and tuple(rows[0][1]) == pytest.approx((0, 0, 20 / 640, 20 / 480))
    assert rows[1][0] is None and rows[1][1] is not None and [r[2] for r in rows] == [True, True, False]


def js(p, q):
    p, q = np.array(p) / sum(p), np.array(q) / sum(q)
    m = (p + q) / 2
    s = lambda a: sum(x * math.log(x / y) for x, y in zip(a, m, strict=True) if x > 0)
    return (s(p) + s(q)) / 2 / math.log(2)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), min_size=4, max_size=4), min_size=6, max_size=30))
def test_js_properties(spark, vs):
    vs = [[float(x) for x in v] for v in vs]
    df = frame(spark, list(zip(vs, vs[::-1], strict=True)), "p array<double>, q array<double>")
    rows = df.select("p", "q", dist.js_divergence(F.col("p"), F.col("q")), dist.js_divergence(F.col("q"), F.col("p"))).collect()
    for p, q, a, b in rows:
        p, q = p if sum(p) else [1.0] * 4, q if sum(q) else [1.0] * 4
        assert 0 <= a <= 1 and a == pytest.approx(b, abs=1e-12) and a == pytest.approx(js(p, q), abs=1e-9)


def test_distributions(spark):
    df = frame(spark, [([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])], "p array<double>, q array<double>")
    rows = df.select(dist.js_divergence(F.col("p"), F.col("q")), dist.normalize(F.col("p")), dist.softmax(F.col("p")), dist.argmax(F.col("q")), dist.onehot(F.lit(1), 3)).collect()
    assert [rows[0][0], rows[1][0]] == [1.0, 0.0] and rows[1][1] == [0.5, 0.5]
    assert rows[0][2] == pytest.approx([math.e / (1 + math.e), 1 / (1 + math.e)]) and [r[3] for r in rows] == [1, 0] and rows[0][4] == [0.0, 1.0, 0.0]
    with pytest.raises(Exception, match="lengths"):
        frame(spark, [([1.0], [1.0, 2.0])], "p array<double>, q array<double>").select(dist.js_divergence(F.col("p"), F.col("q"))).collect()
    with pytest.raises(Exception, match="outside"):
        frame(spark, [(7,)], "pred_class int").agg(dist.dense_counts(5)).collect()


def test_sql_functions_stay_in_the_jvm(spark):
    register(spark)
    df = spark.sql("select js_divergence(array(1D, 0D), array(0D, 1D)) as a, box_iou(named_struct('x1', 0D, 'y1', 0D, 'x2', 2D, 'y2', 2D), named_struct('x1', 1D, 'y1', 0D, 'x2', 3D, 'y2', 2D)) as b")
    assert tuple(df.first()) == pytest.approx((1.0, 1 / 3))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_label_text(spark):
    df = frame(spark, [(5 / 640, 0.25), (2.5e-7, float("nan")), (0.1, None)], "a double, b double")
    assert [r[0] for r in df.select(six_decimals("a", "b")).collect()] == ["0.007812 0.250000", None, None]
    b = frame(spark, [(100.0, 100.0, 300.0, 300.0), (10.0, 10.0, 10.0, 20.0)], "x1 double, y1 double, x2 double, y2 double")
    line = label_line(F.lit(5), geo.normalised_from_corners(boxed(), F.lit(640), F.lit(480)))
    assert [r[0] for r in b.select(line).collect()] == ["5 0.312500 0.416667 0.312500 0.416667", None]


def test_names(spark):
    df = frame(spark, [("/d/images/train/000000000007.JPG", 7)], "path string, id long")
    row = df.select(names.stem(F.col("path")), names.suffix(F.col("path")), names.label_path(F.col("path")), names.image_id(F.col("id")), names.box_id(F.lit("i"), F.lit(3), F.lit(12345)), names.box_id(F.lit("i"), F.lit(3), F.lit(7))).first()
    assert tuple(row) == ("000000000007", ".jpg", "/d/labels/train/000000000007.txt", "000000000007", "i_r3_12345", "i_r3_0007")
    assert (names.ratio_name(0.01), names.ratio_name(0.07), names.ratio_name_rounded(0.07)) == ("1pct", "7p0pct", "7pct")
    assert (names.fold_seed(42, 2), names.inner_val_seed(42, 2)) == (2042, 2542)


def test_iou_of_nan_passes_no_gate(spark):
    rows = frame(spark, [(0.0, 0.0, math.nan, 2.0), (0.0, 0.0, 2.0, 2.0)], "x1 double, y1 double, x2 double, y2 double")
    own = geo.box(F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(2.0))
    assert [r[0] for r in rows.select(geo.iou(boxed(), own)).collect()] == [0.0, 1.0]


def test_long_ids_stay_whole(spark):
    from boxtide.functions.names import image_id

    got = spark.createDataFrame([(7,), (123456789012,), (1234567890123,), (1234567890129,)], "n long").select(image_id(F.col("n")))
    assert [r[0] for r in got.collect()] == ["000000000007", "123456789012", "1234567890123", "1234567890129"]


def test_no_private_folder_on_a_cluster():
    from types import SimpleNamespace

    import pytest

    from boxtide.session import shared_dir

    conf = SimpleNamespace(get=lambda *a: None)
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://h:7077", getCheckpointDir=lambda: None))
    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(cluster)
