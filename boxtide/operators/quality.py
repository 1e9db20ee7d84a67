"""The dataset verifier: each check is a row (check, part, status, n_bad, sample)."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import image_id, label_path, stem
from .integrity import Check, census, found_in, problem
from .ordering import even_sample

# The keys that the document of filter statistics has.
STATS_KEYS = [
    "skipped_iscrowd",
    "skipped_invalid_bbox",
    "skipped_unselected_class",
    "kept",
    "label_files_written",
    "label_lines_written",
    "labels_clipped",
    "labels_dropped_zero_area",
    "label_files_skipped_no_anns_left",
]
REPORT = "check string, part string, status string, n_bad long, sample array<string>"


def check(rows: DataFrame, name: str, part: str, ident: str, bad: str = "FAIL") -> DataFrame:
    """OK if `rows`, those that are wrong, are none; else `bad`."""
    found = problem(rows.select(F.col(ident).cast("string").alias("_bad")), name, "_bad", 5)
    return found.select("check", F.lit(part).alias("part"), F.when(F.col("n_bad") == 0, "OK").otherwise(bad).alias("status"), "n_bad", "sample")


def union(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def stats_document(spark: SparkSession, text: str | None, keys: list[str] = STATS_KEYS) -> DataFrame:
    """Q1: the document is there, is JSON, and has the keys."""
    try:
        missing = sorted(set(keys) - set(json.loads(text))) if text is not None else ["document"]
    except ValueError:
        missing = ["valid JSON"]
    return spark.createDataFrame([("filter statistics", "all", "FAIL" if missing else "OK", len(missing), missing[:5])], REPORT)


def links(listing: DataFrame, expected: int, part: str) -> DataFrame:
    """Q2: every link of `listing` (path, resolved) resolves, and there are as many as expected."""
    broken = check(listing.where(~F.col("resolved")), "broken links", part, "path")
    n = listing.agg(F.count("*").alias("n"))
    off = F.abs(F.col("n") - expected)
    count = n.select(F.lit("number of links").alias("check"), F.lit(part).alias("part"), F.when(off == 0, "OK").otherwise("FAIL").alias("status"), off.alias("n_bad"), F.array(F.col("n").cast("string")).alias("sample"))
    return union(broken, count)


def of_census(members: DataFrame, tags: list[str], checks: list[tuple[str, str, Column]]) -> DataFrame:
    """Checks (name, part, what is bad) over a census of stems, all of one exchange."""
    named: list[Check] = [(f"{k}", bad, F.lit(1)) for k, (_, _, bad) in enumerate(checks)]
    found = found_in(census(members, tags, "stem"), named, "stem", 5)
    labels = found.sparkSession.createDataFrame([(f"{k}", n, p) for k, (n, p, _) in enumerate(checks)], "check string, name string, part string")
    status = F.when(F.col("n_bad") == 0, "OK").otherwise("FAIL")
    return found.join(F.broadcast(labels), "check").select(F.col("name").alias("check"), "part", status.alias("status"), "n_bad", "sample")


def _stems(files: DataFrame, tag: str) -> DataFrame:
    return files.select(stem(F.col("path")).alias("stem"), F.lit(tag).alias("tag"))


def _only(a: str, b: str) -> Column:
    return (F.col(f"n_{a}") > 0) & (F.col(f"n_{b}") == 0)


def pairing(images: DataFrame, labels: DataFrame, part: str) -> DataFrame:
    """Q3: images without labels, then labels without images, by stem of `path`; several files of a stem count as one."""
    members = _stems(images, "image").union(_stems(labels, "label"))
    return of_census(members, ["image", "label"], [("image without label", part, _only("image", "label")), ("label without image", part, _only("label", "image"))])


def label_paths(images: DataFrame, labels: DataFrame, root: str, part: str, n: int = 10) -> DataFrame:
    """Q4: for n evenly spaced images the label path made from theirs exists, and lies below root."""
    expected = even_sample(images.select("path"), n, "path").select(label_path(F.col("path")).alias("path"))
    lacking = expected.join(labels.select("path"), "path", "left_anti")
    outside = expected.where(~F.startswith("path", F.lit(root)))
    return union(check(lacking, "label path missing", part, "path"), check(outside, "label path outside root", part, "path"))


def parsed_lines(lines: DataFrame, classes: list[int]) -> DataFrame:
    """`lines` (path, line) that aren't blank, with bad_class and bad_coords; a line may be both."""
    token = F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " ")
    out = lines.where(F.length(F.trim(F.regexp_replace("line", r"\s+", " "))) > 0).withColumn("_t", token)
    number = [F.expr(f"try_cast(get(_t, {k}) as double)") for k in range(1, 5)]
    five = F.size("_t") == 5
    in_range = F.lit(True)
    for k, x in enumerate(number):
        low = x >= 0 if k < 2 else x > 0
        in_range = in_range & F.coalesce(low & (x <= 1) & ~F.isnan(x), F.lit(False))
    cls = F.when(F.get("_t", F.lit(0)).rlike(r"^[+-]?\d+$"), F.expr("try_cast(get(_t, 0) as bigint)"))
    return out.select(
        "path",
        "line",
        (five & F.coalesce(~cls.isin(*classes), F.lit(True))).alias("bad_class"),
        (~five | ~in_range).alias("bad_coords"),
        cls.alias("class_id"),
    )


def label_lines(lines: DataFrame, classes: list[int], part: str) -> DataFrame:
    """Q5 and Q6: class ids within the set; five tokens with coordinates in range."""
    parsed = parsed_lines(lines, classes)
    return union(check(parsed.where("bad_class"), "class id", part, "path"), check(parsed.where("bad_coords"), "coordinates", part, "path"))


def partitions(train: DataFrame, val: DataFrame, unlabelled: DataFrame, labelled: DataFrame) -> DataFrame:
    """Q7: the parts share no id, and train and val make up the labelled ids."""
    pairs = [("train/val", train, val), ("train/unlabeled", train, unlabelled), ("val/unlabeled", val, unlabelled)]
    shared = [check(a.select("id").intersect(b.select("id")), "shared ids", name, "id") for name, a, b in pairs]
    both = train.select("id").union(val.select("id")).distinct()
    every = labelled.select("id").distinct()
    return union(*shared, check(every.exceptAll(both).union(both.exceptAll(every)), "ids not covered", "labeled", "id"))


def presence(labelled: DataFrame, unlabelled: DataFrame, images: DataFrame, labels: DataFrame) -> DataFrame:
    """Q8: labelled ids have an image and a label, unlabelled ones an image."""
    named = lambda ids, tag: ids.select(image_id(F.col("id")).alias("stem"), F.lit(tag).alias("tag"))
    members = union(named(labelled, "labeled"), named(unlabelled, "unlabeled"), _stems(images, "image"), _stems(labels, "label"))
    checks = [("id without image", "labeled", _only("labeled", "image")), ("id without label", "labeled", _only("labeled", "label")), ("id without image", "unlabeled", _only("unlabeled", "image"))]
    return of_census(members, ["labeled", "unlabeled", "image", "label"], checks)


def coverage(class_ids: DataFrame, classes: list[int], part: str, bad: str = "FAIL") -> DataFrame:
    """Q9 and Q10: every class occurs. With bad='WARN' a gap only warns."""
    wanted = class_ids.sparkSession.createDataFrame([(c,) for c in classes], "class_id int")
    found = class_ids.select(F.col("class_id").cast("int").alias("class_id")).distinct()  # before the join, which would deal all rows out to a task a class
    return check(wanted.join(found, "class_id", "left_anti"), "class missing", part, "class_id", bad)


def instances(class_ids: DataFrame, classes: list[int]) -> DataFrame:
    """class_id, n of each class, zero included."""
    wanted = class_ids.sparkSession.createDataFrame([(c,) for c in classes], "class_id int")
    counts = class_ids.groupBy(F.col("class_id").cast("int").alias("class_id")).agg(F.count("*").alias("n"))
    return wanted.join(counts, "class_id", "left").fillna(0, ["n"])


def status_counts(report: DataFrame) -> DataFrame:
    return report.groupBy("status").agg(F.count("*").alias("n"))


def exit_code(report: DataFrame, strict: bool = False) -> int:
    """1 if a check failed, or with `strict` warned; else 0."""
    bad: Column = F.col("status").isin("FAIL", "WARN") if strict else F.col("status") == "FAIL"
    return int(not report.where(bad).isEmpty())
