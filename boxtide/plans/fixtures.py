"""Detection-shaped relations derived by formula from the order tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import box
from ..functions.names import box_id, image_id
from ..session import shared_dir
from ..sources.store import read_buckets, write_buckets

CLASSES, WIDTH, HEIGHT = 5, 640, 480


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def objects(spark: SparkSession, sf_dir: str, key: str = "l_orderkey") -> DataFrame:
    """Line items numbered within their order; `key` is l_orderkey or image_id, whichever the rows are joined by later, so that they are dealt out once."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    lines = lines.withColumn("image_id", image_id(F.col("l_orderkey"))) if key == "image_id" else lines
    order = Window.partitionBy(key).orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return lines.withColumn("obj", F.row_number().over(order) - 1)


def saved_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What boxes are derived from, numbered and saved in buckets by image once: rounds that are derived from it move and sort nothing for that."""
    rows = objects(spark, sf_dir, "image_id").select("image_id", "l_partkey", "l_suppkey", "l_quantity", "obj")
    place = f"{shared_dir(spark)}/objects-{uuid.uuid4().hex}"
    return read_buckets(spark, place, rows.schema, write_buckets(rows, place))


def detections(spark: SparkSession, sf_dir: str, r: int, *others: str, lines: DataFrame | None = None) -> DataFrame:
    """Boxes of round r, with those other columns of the line items; of `saved_objects` where these are given."""
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    x1 = 40 * (part % 12) + (supp + 3 * r) % 9
    y1 = 30 * (supp % 10) + (part + 5 * r) % 7
    cls = ((part + F.when((13 * part + 11 * r) % 17 == 0, 1).otherwise(0)) % CLASSES).cast("int")
    w = [(1 + (supp * (k + 3) + r) % 7 + F.when(F.col("pred_class") == k, 20).otherwise(0)).cast("double") for k in range(CLASSES)]
    total = F.col("w0") + F.col("w1") + F.col("w2") + F.col("w3") + F.col("w4")
    return (
        (objects(spark, sf_dir, "image_id") if lines is None else lines)
        .where((7 * part + 3 * supp + 5 * r) % 10 != 0)
        .withColumn("pred_class", cls)
        .withColumns({f"w{k}": x for k, x in enumerate(w)})
        .withColumn("total", total)
        .select(
            "image_id",
            box_id(F.col("image_id"), F.lit(r), F.col("obj")).alias("box_id"),
            F.lit(r).alias("round_id"),
            box(x1, y1, x1 + 60 + F.col("l_quantity"), y1 + 50 + F.col("l_quantity")).alias("box"),
            "pred_class",
            F.array(*[F.col(f"w{k}") / F.col("total") for k in range(CLASSES)]).alias("class_scores"),
            (0.05 + 0.95 * ((31 * part + 17 * supp + 13 * r) % 1000) / 1000.0).alias("confidence"),
            F.col("obj").alias("det_index"),
            *others,
        )
    )


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without line items are images without boxes."""
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        image_id(F.col("o_orderkey")).alias("image_id"),
        F.concat(image_id(F.col("o_orderkey")), F.lit(".jpg")).alias("file_name"),
        F.lit(WIDTH).alias("width"),
        F.lit(HEIGHT).alias("height"),
    )


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, supp, q = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity")
    x1, y1 = 40 * (part % 12) + supp % 9, 30 * (supp % 10) + part % 7
    return objects(spark, sf_dir).select(
        F.col("l_orderkey").alias("image_id"),
        F.col("obj").alias("position"),
        (part % 9 + 1).cast("int").alias("category_id"),
        (supp % 29 == 0).cast("int").alias("iscrowd"),
        F.array((x1 - 20).cast("double"), (y1 - 20).cast("double"), q - 3, q - 3).alias("bbox"),
    )


def categories(spark: SparkSession) -> DataFrame:
    return spark.range(1, 10).select(F.col("id"), F.concat(F.lit("category "), F.col("id").cast("string")).alias("name"))


def jittered(spark: SparkSession, sf_dir: str, t: int, transforms: int, lines: DataFrame | None = None) -> DataFrame:
    """What a detector might find in the transformed images: boxes of round t, moved, some lost, some of another class."""
    part, supp, k = F.col("l_partkey"), F.col("l_suppkey"), F.col("transform")
    each = detections(spark, sf_dir, t, "l_partkey", "l_suppkey", lines=lines).withColumn("transform", F.explode(F.array(*[F.lit(x) for x in range(transforms)])))
    cls = (F.col("pred_class") + F.when((part + k) % 13 == 0, 1).otherwise(0)) % CLASSES
    return each.where((supp + k) % 11 != 0).select("image_id", "transform", "box", cls.cast("int").alias("pred_class"), ((part + k) % 5).cast("double").alias("shift"))
