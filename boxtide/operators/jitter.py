"""How steadily a matched box is found again in transformed images."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import iou, remap

TRANSFORMS = ("scale", "translate", "brightness")


def jitter_candidates(matches: DataFrame, current: DataFrame, images: DataFrame, tau_pre: float, default_size: int = 640) -> DataFrame:
    """image_id, box_id, box, pred_class, width, height of the matched boxes with iou >= tau_pre.

    This filter stands before any detector is asked. Images of unknown size count as 640 x 640. Matches that kept their
    own `box` are not joined with `current`.
    """
    kept = matches.where((F.col("status") == "matched") & (F.col("iou") >= tau_pre) & ~F.isnan("iou"))
    own = kept.withColumnsRenamed({"box_id_t": "box_id", "pred_class_t": "pred_class"})
    if "box" not in matches.columns:
        own = own.select("image_id", "box_id").join(current.select("image_id", "box_id", "box", "pred_class"), ["image_id", "box_id"])
    sizes = images.select("image_id", "width", "height")
    return own.select("image_id", "box_id", "box", "pred_class").join(sizes, "image_id", "left").withColumns(
        {"width": F.coalesce("width", F.lit(default_size)), "height": F.coalesce("height", F.lit(default_size))}
    )


def jitter_triples(candidates: DataFrame, found: DataFrame, gate: float) -> DataFrame:
    """image_id, box_id, iou_0, iou_1, iou_2 of the boxes that all three transforms find at the gate or above.

    Of each transform the best overlap with a found box of the same class counts, 0 where there is none. Boxes that are not found by all have no row; scoring gives them 0.
    Both sides meet by image alone, and what is dealt out by image stays so: the class is a bound of the join
    and no key of it, and a box's three overlaps are made in one group.
    """
    moved = {f"_box_{k}": remap(F.col("box"), F.col("width"), F.col("height"), t) for k, t in enumerate(TRANSFORMS)}
    expected = candidates.select("image_id", "box_id", "pred_class", *[b.alias(name) for name, b in moved.items()])
    f = found.select("image_id", F.col("transform"), F.col("box").alias("_found"), F.col("pred_class").alias("_class"))
    same_class = F.col("pred_class").between(F.col("_class"), F.col("_class"))
    joined = expected.alias("e").join(f.alias("f"), (F.col("e.image_id") == F.col("f.image_id")) & same_class, "left")
    at = F.when(F.col("transform") == 0, F.col("_box_0")).when(F.col("transform") == 1, F.col("_box_1")).when(F.col("transform") == 2, F.col("_box_2"))
    each = joined.select(F.col("e.image_id").alias("image_id"), "box_id", "transform", iou(at, F.col("_found")).alias("_iou"))
    best = [F.max(F.when(F.col("transform") == k, F.col("_iou"))) for k in range(len(TRANSFORMS))]
    wide = each.groupBy("image_id", "box_id").agg(*[F.when(b >= gate, b).otherwise(0.0).alias(f"iou_{k}") for k, b in enumerate(best)])
    return wide.where(F.forall(F.array("iou_0", "iou_1", "iou_2"), lambda x: x >= gate))


def jitter_by_detector(candidates: DataFrame, detect: Callable[[DataFrame, str], DataFrame], gate: float) -> DataFrame:
    """Asks the detector once a transform for all images that have candidates.

    detect(images, transform) gives image_id, box, pred_class; images it can't read have no rows,
    so their boxes score 0.
    """
    from functools import reduce

    images = candidates.select("image_id", "width", "height").distinct()
    found = reduce(DataFrame.unionByName, [detect(images, t).select("image_id", "box", "pred_class", F.lit(k).alias("transform")) for k, t in enumerate(TRANSFORMS)])
    return jitter_triples(candidates, found, gate)
