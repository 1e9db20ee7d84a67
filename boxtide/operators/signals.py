"""Churn, yield and drift of a round, and the rules that stop the loop."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import dense_counts, js_divergence
from ..schema import StoppingConfig


def churn_parts(matches: DataFrame, n_prev: DataFrame, tau_geom_change: float) -> DataFrame:
    """One row: n_t, n_prev, n_matched, n_ambiguous, n_new, n_removed, n_class_change, n_geom_change, raw_churn.

    n_prev is a one-row relation with the number of previous boxes. Each matched pair holds one
    of them, so those removed are the rest. A pair may count as changed twice, and the rate
    isn't clamped.
    """
    matched = F.col("status") == "matched"
    counts = matches.agg(
        F.count("*").alias("n_t"),
        F.count_if(matched).alias("n_matched"),
        F.count_if(F.col("status") == "ambiguous").alias("n_ambiguous"),
        F.count_if(F.col("status") == "unmatched").alias("n_new"),
        F.count_if(matched & (F.col("pred_class_t") != F.col("pred_class_prev"))).alias("n_class_change"),
        F.count_if(matched & (F.col("iou") < tau_geom_change)).alias("n_geom_change"),
    )
    out = counts.join(F.broadcast(n_prev)).withColumn("n_removed", F.col("n_prev") - F.col("n_matched"))
    events = F.col("n_new") + F.col("n_removed") + F.col("n_class_change") + F.col("n_geom_change")
    union = F.col("n_t") + F.col("n_prev") - F.col("n_matched")
    return out.withColumn("raw_churn", F.coalesce(F.try_divide(events.cast("double"), union), F.lit(0.0)))


def stable_yield(admitted: DataFrame) -> DataFrame:
    """n_admitted, n_t and stable_yield of rows with `admitted`."""
    out = admitted.agg(F.count_if("admitted").alias("n_admitted"), F.count("*").alias("n_t"))
    return out.withColumn("stable_yield", F.coalesce(F.try_divide(F.col("n_admitted").cast("double"), "n_t"), F.lit(0.0)))


def class_drift(current: DataFrame, previous: DataFrame, classes: int) -> DataFrame:
    """class_drift of the class counts of two pools; an empty previous pool counts as uniform. 0 without classes."""
    if classes == 0:
        return current.sparkSession.createDataFrame([(0.0,)], "class_drift double")
    a = current.agg(dense_counts(classes).alias("a"))
    b = previous.agg(dense_counts(classes).alias("b"))
    return a.join(F.broadcast(b)).select(js_divergence(F.col("a"), F.col("b")).alias("class_drift"))


def infer_classes(*pools: DataFrame) -> int:
    """The length of the class scores of the first box that a pool has; 0 without boxes."""
    for pool in pools:
        row = pool.select(F.size("class_scores")).first()
        if row is not None:
            return row[0]
    return 0


def signal_deltas(signals: DataFrame, config: StoppingConfig = StoppingConfig()) -> DataFrame:
    """`signals` (round_id, raw_churn, stable_yield, class_drift) with what each round meets and how often in a row.

    Rounds up to warmup_rounds lend their values to the next round's differences but meet
    nothing themselves. A counter of consecutive rounds restarts at each that fails; stop is
    set from k_consecutive on, risk_stop where churn is high while the yield rises. One row a
    round, so the window over all of them is small by nature.
    """
    w = Window.orderBy("round_id")
    delta = lambda c: F.abs(F.col(c) - F.lag(c).over(w))
    out = signals.withColumns({f"d_{k}": delta(c) for k, c in (("churn", "raw_churn"), ("yield", "stable_yield"), ("drift", "class_drift"))})
    counted = (F.col("round_id") > config.warmup_rounds) & F.col("d_churn").isNotNull()
    met = (
        (F.col("d_churn") < config.epsilon_churn)
        & ((F.col("d_yield") < config.epsilon_yield) | (F.col("stable_yield") < config.tau_yield))
        & ((F.col("d_drift") < config.epsilon_drift) | (F.col("class_drift") > config.tau_drift))
    )
    out = out.withColumn("met", counted & F.coalesce(met, F.lit(False)))
    out = out.withColumn("_island", F.sum((~F.col("met")).cast("int")).over(w))
    in_island = Window.partitionBy("_island").orderBy("round_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = out.withColumn("consecutive", F.sum(F.col("met").cast("int")).over(in_island).cast("int")).drop("_island")
    out = out.withColumn("stop", F.col("consecutive") >= config.k_consecutive)
    if config.tau_risk_churn is None:
        return out.withColumn("risk_stop", F.lit(False))
    rising = F.col("stable_yield") > F.lag("stable_yield").over(w)
    return out.withColumn("risk_stop", F.coalesce((F.col("raw_churn") > config.tau_risk_churn) & rising, F.lit(False)))


@dataclass
class StoppingState:
    """The loop's memory: three numbers a round."""

    config: StoppingConfig = StoppingConfig()
    history: list[tuple[int, float, float, float]] = field(default_factory=list)
    consecutive: int = 0
    stopped: bool = False
    reason: str | None = None

    def observe(self, round_id: int, churn: float, yielded: float, drift: float) -> StoppingState:
        c = self.config
        before = self.history[-1] if self.history else None
        self.history.append((round_id, churn, yielded, drift))
        if before is None:
            return self
        if round_id > c.warmup_rounds:
            met = (
                abs(churn - before[1]) < c.epsilon_churn
                and (abs(yielded - before[2]) < c.epsilon_yield or yielded < c.tau_yield)
                and (abs(drift - before[3]) < c.epsilon_drift or drift > c.tau_drift)
            )
            self.consecutive = self.consecutive + 1 if met else 0
            if self.consecutive >= c.k_consecutive:
                self.stopped, self.reason = True, "convergence"
        if c.tau_risk_churn is not None and churn > c.tau_risk_churn and yielded > before[2]:
            self.stopped = True
            self.reason = f"risk_stop: churn {churn:.4f} > {c.tau_risk_churn} while the yield rose from {before[2]:.4f} to {yielded:.4f}"
        return self
