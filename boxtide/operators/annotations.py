"""Annotation documents as relations: filtering, class ids, label text, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import leaves_image, xywh_to_clamped, xywh_to_normalised
from ..functions.names import image_id
from ..functions.text import label_line
from ..schema import SELECTED_CATEGORIES


def reason(selected: list[int]) -> Column:
    """The first of iscrowd, invalid_bbox, unselected_class that holds for an annotation, else kept."""
    b = F.col("bbox")
    side = lambda k: F.get(b, F.lit(k))
    bad = b.isNull() | (F.size(b) < 4) | (side(2) <= 0) | (side(3) <= 0)
    return (
        F.when(F.coalesce(F.col("iscrowd"), F.lit(0)) != 0, "iscrowd")
        .when(F.coalesce(bad, F.lit(False)), "invalid_bbox")
        .when(~F.coalesce(F.col("category_id").isin(*selected), F.lit(False)), "unselected_class")
        .otherwise("kept")
    )


def labelled_by_reason(annotations: DataFrame, selected: list[int] | None = None) -> DataFrame:
    return annotations.withColumn("reason", reason(list(SELECTED_CATEGORIES) if selected is None else selected))


def reason_counts(annotations: DataFrame, selected: list[int] | None = None) -> DataFrame:
    return labelled_by_reason(annotations, selected).groupBy("reason").agg(F.count("*").alias("n"))


def mapped_class(category: Column, mapping: dict[int, int] | None = None) -> Column:
    """The class id of a category by a constant map; null where it has none."""
    pairs = sorted((mapping or SELECTED_CATEGORIES).items())
    table = F.map_from_arrays(F.array(*[F.lit(k) for k, _ in pairs]), F.array(*[F.lit(v) for _, v in pairs]))
    return F.try_element_at(table, category.cast("int"))


def dense_classes(categories: DataFrame) -> DataFrame:
    """category_id, class_id: numbered from 0 in the order of the ids. The dictionary is small by nature."""
    from pyspark.sql import Window

    return categories.select(F.col("id").alias("category_id"), (F.row_number().over(Window.orderBy("id")) - 1).cast("int").alias("class_id"))


def _sides() -> list[Column]:
    return [F.get("bbox", F.lit(k)) for k in range(4)]


def converted(annotations: DataFrame, images: DataFrame, mapping: dict[int, int] | None = None) -> DataFrame:
    """Kept annotations of images with known sizes: class_id, shape (null without area), clipped.

    Corners are clipped before the centre is taken.
    """
    mapping = mapping or SELECTED_CATEGORIES
    kept = labelled_by_reason(annotations, list(mapping)).where("reason = 'kept'").drop("reason")
    sizes = images.where("width > 0 and height > 0").select(F.col("id").alias("image_id"), "width", "height")
    size = F.col("width"), F.col("height")
    return kept.join(sizes, "image_id").select(
        "image_id",
        mapped_class(F.col("category_id"), mapping).alias("class_id"),
        xywh_to_normalised(*_sides(), *size).alias("shape"),
        leaves_image(*_sides(), *size).alias("clipped"),
    )


def converted_clamped(annotations: DataFrame, images: DataFrame, categories: DataFrame, image_ids: list[int] | None = None) -> DataFrame:
    """The other conversion: every image, empty ones too, classes numbered by category id, each number clamped by itself.

    An empty list of ids means all images; ids without an image are passed over.
    """
    wanted = images.where(F.col("id").isin(*image_ids)) if image_ids else images
    usable = annotations.where((F.coalesce(F.col("iscrowd"), F.lit(0)) == 0) & (_sides()[2] > 0) & (_sides()[3] > 0))
    usable = usable.join(F.broadcast(dense_classes(categories)), "category_id")
    shape = xywh_to_clamped(*_sides(), F.col("width"), F.col("height"))
    rows = usable.join(wanted.select(F.col("id").alias("image_id"), "width", "height"), "image_id")
    rows = rows.select("image_id", "position", "class_id", shape.alias("shape")).where("shape is not null")
    return wanted.select(F.col("id").alias("image_id")).join(rows, "image_id", "left")


def label_files(shapes: DataFrame) -> DataFrame:
    """image_id (12 digits), file_name, lines: the label lines of each image with one, by class, cx, cy."""
    rows = shapes.where("shape is not null").select(
        image_id(F.col("image_id")).alias("image_id"), "class_id", F.col("shape.cx").alias("cx"), F.col("shape.cy").alias("cy"), label_line(F.col("class_id"), F.col("shape")).alias("line")
    )
    ordered = F.array_sort(F.collect_list(F.struct("class_id", "cx", "cy", "line")))
    out = rows.groupBy("image_id").agg(F.transform(ordered, lambda x: x["line"]).alias("lines"))
    return out.select("image_id", F.concat("image_id", F.lit(".txt")).alias("file_name"), "lines")


def conversion_stats(annotations: DataFrame, images: DataFrame, mapping: dict[int, int] | None = None) -> DataFrame:
    """One row of counts: what became lines and files, what was clipped, dropped or skipped."""
    mapping = mapping or SELECTED_CATEGORIES
    kept = labelled_by_reason(annotations, list(mapping)).where("reason = 'kept'")
    sizes = images.select(F.col("id").alias("image_id"), F.col("width").alias("w"), F.col("height").alias("h"))
    known = F.coalesce((F.col("w") > 0) & (F.col("h") > 0), F.lit(False))
    shape = xywh_to_normalised(*_sides(), F.col("w"), F.col("h"))
    flagged = kept.join(sizes, "image_id", "left").select(
        "image_id", known.alias("known"), (known & shape.isNotNull()).alias("line"), (known & shape.isNotNull() & leaves_image(*_sides(), F.col("w"), F.col("h"))).alias("clipped")
    )
    per_image = flagged.groupBy("image_id").agg(
        F.bool_and("known").alias("known"), F.count_if("line").alias("lines"), F.count_if("clipped").alias("clipped"), F.count("*").alias("n")
    )
    return per_image.agg(
        F.count_if(F.col("lines") > 0).alias("label_files_written"),
        F.coalesce(F.sum("lines"), F.lit(0)).alias("label_lines_written"),
        F.coalesce(F.sum("clipped"), F.lit(0)).alias("labels_clipped"),
        F.coalesce(F.sum(F.when(F.col("known"), F.col("n") - F.col("lines"))), F.lit(0)).alias("labels_dropped_zero_area"),
        F.count_if(~F.col("known")).alias("label_files_skipped_no_dims"),
        F.count_if(F.col("known") & (F.col("lines") == 0)).alias("label_files_skipped_no_anns_left"),
    )


def class_counts(annotations: DataFrame, classes: DataFrame, ratio: float) -> DataFrame:
    """For each of `classes` (category_id): instances, distinct images, and the instances to expect at `ratio`, cut to whole."""
    kept = labelled_by_reason(annotations, []).where("reason = 'unselected_class'")  # valid, of any class
    counts = kept.groupBy("category_id").agg(F.count("*").alias("instances"), F.count_distinct("image_id").alias("images"))
    out = classes.select("category_id").join(counts, "category_id", "left").fillna(0, ["instances", "images"])
    return out.withColumn("expected", (F.col("instances") * F.lit(ratio)).cast("long"))


def union_of_images(annotations: DataFrame, selected: list[int]) -> DataFrame:
    """How many images hold any of the selected classes."""
    return labelled_by_reason(annotations, selected).where("reason = 'kept'").agg(F.count_distinct("image_id").alias("images"))


def not_viable(counts: DataFrame, least: int = 500) -> DataFrame:
    return counts.where(F.col("expected") < least)


def require_all_classes(shapes: DataFrame, classes: int) -> None:
    """Fails if a class has no line left after conversion."""
    found = {r[0] for r in shapes.where("shape is not null").select("class_id").distinct().collect()}
    if missing := [k for k in range(classes) if k not in found]:
        raise ValueError(f"classes without a label after clipping: {missing}")
