"""What a confidence threshold alone would admit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from .admission import at_least
from .ordering import values_at


def class_audit(detections: DataFrame, tau: float, class_names: list[str], medians: bool = True) -> DataFrame:
    """A row a class: counts and shares of all and of admitted boxes, mean and true median confidences.

    Medians are selected by counts that narrow a class's range (`values_at`): no sort, and no task holds a class.
    """
    classes = detections.sparkSession.createDataFrame(list(enumerate(class_names)), "pred_class int, class_name string")
    admitted = at_least(F.col("confidence"), tau)
    own = F.when(admitted, F.col("confidence"))
    numbers = [F.count("*").alias("det_count"), F.count_if(admitted).alias("admitted_count"), F.avg("confidence").alias("mean_all"), F.avg(own).alias("mean_admitted")]
    counts = detections.groupBy("pred_class").agg(*numbers)
    if medians:
        counts = counts.join(class_medians(detections, tau), "pred_class", "left")
    totals = counts.agg(F.coalesce(F.sum("det_count"), F.lit(0)).alias("_det"), F.coalesce(F.sum("admitted_count"), F.lit(0)).alias("_adm"))
    out = classes.join(counts, "pred_class", "left").fillna(0, ["det_count", "admitted_count"]).join(F.broadcast(totals))
    return out.select(
        "pred_class",
        "class_name",
        "det_count",
        "admitted_count",
        (100.0 * F.col("det_count") / F.greatest("_det", F.lit(1))).alias("det_pct"),
        (100.0 * F.col("admitted_count") / F.greatest("_adm", F.lit(1))).alias("admitted_pct"),
        "mean_all",
        "mean_admitted",
        *(["median_all", "median_admitted"] if medians else []),
    )


def class_medians(detections: DataFrame, tau: float) -> DataFrame:
    """pred_class, median_all, median_admitted. Within a class the admitted boxes are the last ones by confidence."""
    c = F.col("confidence")
    rows = checkpoint(detections.where(F.col("pred_class").isNotNull() & c.isNotNull() & ~F.isnan(c)).select("pred_class", "confidence"))
    sizes = checkpoint(rows.groupBy("pred_class").agg(F.count("*").alias("_n"), F.count_if(at_least(c, tau)).alias("_k")))
    n, k = F.col("_n"), F.col("_k")
    middle = {"all": (F.lit(0), n), "admitted": (n - k, k)}
    places = F.array(*[F.struct(F.lit(name).alias("of"), (first + F.floor((m - F.lit(x)) / 2)).cast("long").alias("place")) for name, (first, m) in middle.items() for x in (1, 0)])
    wanted = sizes.select("pred_class", F.explode(places).alias("x"), "_k").where("x.of = 'all' or _k > 0").select("pred_class", "x.*")
    found = wanted.join(values_at(rows, "pred_class", "confidence", wanted), ["pred_class", "place"])
    return found.groupBy("pred_class").agg(*[F.avg(F.when(F.col("of") == name, c)).alias(f"median_{name}") for name in middle])


def image_audit(images: DataFrame, detections: DataFrame, tau: float) -> DataFrame:
    """A row an image: n_det, n_admitted, max_conf (null without boxes), admitted_classes in box order."""
    admitted = at_least(F.col("confidence"), tau)
    classes = F.array_sort(F.collect_list(F.when(admitted, F.struct("det_index", "pred_class"))))
    counts = detections.groupBy("image_id").agg(
        F.count("*").alias("n_det"), F.count_if(admitted).alias("n_admitted"), F.max("confidence").alias("max_conf"), F.transform(classes, lambda x: x["pred_class"]).alias("admitted_classes")
    )
    out = images.select("image_id").join(counts, "image_id", "left")
    return out.select(
        "image_id",
        F.coalesce("n_det", F.lit(0)).alias("n_det"),
        F.coalesce("n_admitted", F.lit(0)).alias("n_admitted"),
        "max_conf",
        F.coalesce("admitted_classes", F.array().cast("array<int>")).alias("admitted_classes"),
    )


def audit_summary(images: DataFrame, detections: DataFrame, tau: float, class_names: list[str], saturated: float = 70.0, imbalanced: float = 60.0) -> DataFrame:
    """One row: totals, saturation, the class admitted most (the first of equal ones) and the two flags."""
    per_class = class_audit(detections, tau, class_names, medians=False)
    top = per_class.agg(
        F.max_by("class_name", F.struct("admitted_count", -F.col("pred_class"))).alias("top_class"),
        F.max("admitted_pct").alias("top_class_pct"),
        F.sum("det_count").alias("total_det"),
        F.sum("admitted_count").alias("admitted"),
    )
    per_image = detections.groupBy("image_id").agg(F.count_if(at_least(F.col("confidence"), tau)).alias("n"))
    seen = images.select("image_id").join(per_image, "image_id", "left").agg(
        F.count("*").alias("n_images"), F.count("n").alias("images_with_any_det"), F.count_if(F.col("n") > 0).alias("images_with_admitted")
    )
    out = seen.join(top).withColumn("saturation_pct", 100.0 * F.col("images_with_admitted") / F.greatest("n_images", F.lit(1)))
    return out.withColumn("saturation_flag", F.col("saturation_pct") > saturated).withColumn("imbalance_flag", F.col("top_class_pct") > imbalanced)


def write_image_audit(rows: DataFrame, path: str) -> None:
    """CSV of fname, n_det, n_admitted, max_conf; blank where there is no box."""
    out = rows.select(F.col("image_id").alias("fname"), "n_det", "n_admitted", "max_conf")
    out.write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")
