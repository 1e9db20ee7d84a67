"""Tables of evaluation results: rows of (method, round_id, map50, map50_95, checkpoint, n_images)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def round_table(results: DataFrame, metric: str = "map50", methods: list[str] | None = None) -> DataFrame:
    """A row a round, a column a method with four decimals, N/A where it has none; the last of equal rounds counts."""
    names = methods if methods is not None else sorted(r[0] for r in results.select("method").distinct().collect())
    order = "position" if "position" in results.columns else metric
    wide = results.groupBy("round_id").pivot("method", names).agg(F.max_by(metric, order))
    return wide.select("round_id", *[F.when(F.col(f"`{m}`").isNotNull(), F.format_string("%.4f", F.col(f"`{m}`"))).otherwise("N/A").alias(m) for m in names]).orderBy("round_id")


def best_rounds(results: DataFrame, metric: str = "map50") -> DataFrame:
    """Each method's best round; the first of equal ones."""
    order = [F.desc(metric), F.asc("position" if "position" in results.columns else "round_id")]
    ranked = results.withColumn("_k", F.row_number().over(Window.partitionBy("method").orderBy(*order)))
    return ranked.where("_k = 1").select("method", "round_id", "map50", "map50_95").orderBy("method")


def fold_summary(results: DataFrame, metric: str = "map50") -> DataFrame:
    """mean and sample deviation over `fold` of each fold's best; 0 and 0 without folds, deviation 0 for one."""
    best = results.groupBy("fold").agg(F.max(metric).alias("best"))
    return best.agg(F.coalesce(F.avg("best"), F.lit(0.0)).alias("mean"), F.coalesce(F.stddev_samp("best"), F.lit(0.0)).alias("std"), F.count("*").alias("folds"))


def write_results_csv(results: DataFrame, path: str) -> bool:
    """One CSV file with a header; none for no rows."""
    if results.isEmpty():
        return False
    columns = ["method", "round_id", "map50", "map50_95", "checkpoint", "n_images"]
    results.select(*columns).coalesce(1).write.mode("overwrite").csv(path, header=True)
    return True


def evaluate_checked(evaluate: Callable[[str], dict], checkpoint: str, images: DataFrame, exists: Callable[[str], bool], classes: int, class_names: list[str] | None = None) -> dict:
    """What the injected evaluator finds, with n_images: the .jpg files among `images` (path); arguments are checked first."""
    if class_names is not None and len(class_names) != classes:
        raise ValueError(f"{len(class_names)} class names for {classes} classes")
    if not exists(checkpoint):
        raise FileNotFoundError(f"no checkpoint {checkpoint}")
    n = images.where(F.endswith(F.col("path"), F.lit(".jpg"))).count()
    return evaluate(checkpoint) | {"n_images": n}
