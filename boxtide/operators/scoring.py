"""Consistency of matched boxes across rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ScoringConfig
from ..session import checkpoint
from .integrity import match_report, require_clean
from .ordering import values_at


def jitter_component(a: Column, b: Column, c: Column) -> Column:
    """1 minus the population deviation of three overlaps; null unless all three are there."""
    mean = (a + b + c) / 3
    spread = F.sqrt(((a - mean) * (a - mean) + (b - mean) * (b - mean) + (c - mean) * (c - mean)) / 3)
    return F.when(a.isNotNull() & b.isNotNull() & c.isNotNull(), 1 - spread)


def stability(cls: Column, loc: Column, jitter: Column, config: ScoringConfig) -> Column:
    """The weighted sum within [0, 1]; weights aren't redistributed."""
    return F.least(F.greatest(config.alpha * cls + config.beta * loc + config.gamma * jitter, F.lit(0.0)), F.lit(1.0))


def score(matches: DataFrame, jitter: DataFrame | None = None, config: ScoringConfig = ScoringConfig()) -> DataFrame:
    """`matches` with c_cls_dist, c_loc, c_jitter_loc, jitter_executed and stability.

    Matched boxes without a jitter triple (image_id, box_id, iou_0, iou_1, iou_2) have
    c_jitter_loc 0 and jitter_executed false; unmatched and ambiguous ones have nulls and
    false. The divergence and overlap are those that the matching computed.
    """
    if jitter is None:
        joined = matches.withColumns({f"iou_{k}": F.lit(None).cast("double") for k in range(3)})
    else:
        joined = matches.join(jitter.withColumnRenamed("box_id", "box_id_t"), ["image_id", "box_id_t"], "left")
    found = jitter_component(F.col("iou_0"), F.col("iou_1"), F.col("iou_2"))
    matched = F.col("status") == "matched"
    return (
        joined.withColumn("c_cls_dist", F.when(matched, 1 - F.col("js")))
        .withColumn("c_loc", F.when(matched, F.col("iou")))
        .withColumn("c_jitter_loc", F.when(matched, F.coalesce(found, F.lit(0.0))))
        .withColumn("jitter_executed", matched & found.isNotNull())
        .withColumn("stability", F.when(matched, stability(F.col("c_cls_dist"), F.col("c_loc"), F.col("c_jitter_loc"), config)))
        .drop("iou_0", "iou_1", "iou_2")
    )


def checked_score(matches: DataFrame, current: DataFrame, previous: DataFrame, images: DataFrame, jitter: DataFrame | None = None, config: ScoringConfig = ScoringConfig()) -> DataFrame:
    """`score`, after checks that every image of the pool has a match result and every id in `matches` is in its pool.

    ValueError names the check that fails and its first ids. images: those of the current pool.
    """
    require_clean(match_report(matches, current, previous, matches.select("image_id").distinct(), images))
    return score(matches, jitter, config)


def score_summary(scored: DataFrame) -> DataFrame:
    """mean_s, upper_median_s (of an even number the upper of the middle two), n_scored, over non-null scores.

    The median is selected by counts that narrow its range (`values_at`), not by a sort.
    """
    rows = checkpoint(scored.where("stability is not null").select(F.lit(0).alias("_all"), "stability"))
    means = checkpoint(rows.agg(F.avg("stability").alias("mean_s"), F.count("*").alias("n_scored")))
    upper = values_at(rows, "_all", "stability", means.select(F.lit(0).alias("_all"), F.expr("n_scored div 2").alias("place")))
    return means.join(upper.select(F.col("stability").alias("upper_median_s")), how="left")
