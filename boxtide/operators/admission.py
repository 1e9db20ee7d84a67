"""Which boxes become pseudo-labels. A policy is a function that gives a boolean column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import AdmissionConfig

Policy = Callable[[DataFrame], Column]


def at_least(x: Column, low: float) -> Column:
    """False for null and NaN, which Spark would order last."""
    return F.coalesce((x >= low) & ~F.isnan(x), F.lit(False))


def dual_gate(config: AdmissionConfig = AdmissionConfig()) -> Policy:
    """A stability that is not null and at least tau_stab, and a confidence of at least tau_conf."""
    return lambda scored: at_least(F.col("stability"), config.tau_stab) & at_least(F.col("confidence"), config.tau_conf)


def confidence_gate(tau: float) -> Policy:
    return lambda scored: at_least(F.col("confidence"), tau)


def admit(scored: DataFrame, policy: Policy) -> DataFrame:
    """`scored` with the column `admitted`."""
    return scored.withColumn("admitted", policy(scored))


def admitted_boxes(scored: DataFrame, policy: Policy, *order: str) -> DataFrame:
    """The admitted rows, in the order of image and box."""
    return scored.where(policy(scored)).orderBy(*(order or ("image_id", "box_id_t")))


def pseudo_label_stats(admitted: DataFrame, n_candidates: int, class_names: list[str]) -> DataFrame:
    """A row a class, zero included: count and share; with the totals on each row."""
    classes = admitted.sparkSession.createDataFrame(list(enumerate(class_names)), "pred_class int, class_name string")
    counts = admitted.groupBy("pred_class").agg(F.count("*").alias("n"))
    totals = admitted.agg(F.count("*").alias("n_admitted"), F.count_distinct("image_id").alias("images_with_labels"))
    out = classes.join(counts, "pred_class", "left").join(totals)
    return out.select(
        "pred_class",
        "class_name",
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
        F.coalesce(F.try_divide(100.0 * F.coalesce("n", F.lit(0)), F.col("n_admitted")), F.lit(0.0)).alias("pct"),
        "n_admitted",
        "images_with_labels",
        F.lit(n_candidates).cast("long").alias("n_candidates"),
        (100.0 * F.col("n_admitted") / max(1, n_candidates)).alias("admitted_pct"),
    )


def naive_labels(detections: DataFrame, tau: float, classes: int, round_id: int) -> DataFrame:
    """Confidence-only labels: ids count the admitted boxes of the round, scores are one-hot.

    `detections` has det_index, the order of the boxes within an image. The running number is the
    number of admitted boxes of the images before plus the place within the image, so only
    the counts of images meet in one window over ranges of images.
    """
    from ..functions.distributions import onehot
    from ..functions.names import box_id
    from .ordering import numbered_by

    kept = detections.where(at_least(F.col("confidence"), tau))
    numbered = numbered_by(kept, "image_id", "det_index")
    return numbered.select(
        "image_id",
        box_id(F.col("image_id"), F.lit(round_id), F.col("position"), 5).alias("box_id"),
        F.lit(round_id).alias("round_id"),
        "box",
        "pred_class",
        onehot(F.col("pred_class"), classes).alias("class_scores"),
        "confidence",
    )
