"""The round loop: the driver keeps three numbers a round, all else is relations in the store."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.distributions import dense_counts, js_divergence
from ..operators.admission import Policy, admit, at_least, dual_gate
from ..operators.jitter import jitter_by_detector, jitter_candidates
from ..operators.matching import match
from ..operators.integrity import admitted_report, require_clean, round_report
from ..operators.scoring import score
from ..operators.signals import StoppingState, infer_classes
from ..schema import BANK_ROW, LoopConfig
from ..session import checkpoint as saved
from ..session import shared_dir
from ..sources.store import RoundStore, by_image, joined_in_buckets, read_buckets, write_buckets

Infer = Callable[[str, int], tuple[DataFrame, DataFrame]]  # checkpoint, round: images, detections
Train = Callable[[DataFrame, int, str | None], str]  # admitted boxes, round, checkpoint: new checkpoint
JitterDetect = Callable[[DataFrame, str], DataFrame]
Evaluate = Callable[[str, int], object]


def bank_rows(detections: DataFrame, scored: DataFrame) -> DataFrame:
    """Every box of a round with its match, components, stability and whether it is admitted; lacking values null or false."""
    s = scored.select(
        "image_id",
        F.col("box_id_t").alias("box_id"),
        "status",
        F.col("box_id_prev").alias("matched_prev_id"),
        "pred_class_prev",
        "c_cls_dist",
        "c_loc",
        "c_jitter_loc",
        "jitter_executed",
        "stability",
        "admitted",
    )
    joined = detections.join(s, ["image_id", "box_id"], "left")
    return joined.select("round_id", *[F.coalesce(c, F.lit(False)).alias(c) if c in ("admitted", "jitter_executed") else c for c in BANK_ROW.fieldNames()])


def _kept_rows(scored: DataFrame) -> DataFrame:
    """`bank_rows` of matches that kept the boxes' own columns."""
    names = {"box_id_t": "box_id", "pred_class_t": "pred_class", "box_id_prev": "matched_prev_id"}
    rows = scored.withColumnsRenamed(names)
    return rows.select(*[F.coalesce(c, F.lit(False)).alias(c) if c in ("admitted", "jitter_executed") else c for c in BANK_ROW.fieldNames()])


def bootstrap_rows(detections: DataFrame) -> DataFrame:
    """The rows of a round that has none before: no match, no score, nothing admitted."""
    empty = {f.name: F.lit(None).cast(f.dataType) for f in BANK_ROW.fields if f.name not in detections.columns}
    return detections.withColumns(empty | {"admitted": F.lit(False), "jitter_executed": F.lit(False)}).select("round_id", *BANK_ROW.fieldNames())


def round_signals(rows: DataFrame, previous: DataFrame, tau_geom_change: float, classes: int) -> DataFrame:
    """One row of counts and signals, from the stored rows of a round and the pool before."""
    matched = F.col("status") == "matched"
    now = rows.agg(
        F.count("*").alias("n_t"),
        F.count_if("admitted").alias("n_admitted"),
        F.count_if(matched).alias("n_matched"),
        F.count_if(F.col("status") == "unmatched").alias("n_new"),
        F.count_if(matched & (F.col("pred_class") != F.col("pred_class_prev"))).alias("n_class_change"),
        F.count_if(matched & (F.col("c_loc") < tau_geom_change)).alias("n_geom_change"),
        *([dense_counts(classes).alias("a")] if classes else []),
    )
    before = previous.agg(F.count("*").alias("n_prev"), *([dense_counts(classes).alias("b")] if classes else []))
    both = now.join(before)
    events = F.col("n_new") + F.col("n_prev") - F.col("n_matched") + F.col("n_class_change") + F.col("n_geom_change")
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    drift = js_divergence(F.col("a"), F.col("b")) if classes else F.lit(0.0)
    return both.select(
        "n_t",
        "n_admitted",
        share(events, F.col("n_t") + F.col("n_prev") - F.col("n_matched")).alias("raw_churn"),
        share(F.col("n_admitted"), F.col("n_t")).alias("stable_yield"),
        drift.alias("class_drift"),
    )


@dataclass
class LoopResult:
    checkpoint: str
    reason: str
    state: StoppingState
    evaluations: list = field(default_factory=list)


def run_loop(
    spark: SparkSession,
    store: RoundStore,
    config: LoopConfig,
    infer: Infer,
    train: Train,
    checkpoint: str | None = None,
    jitter: JitterDetect | None = None,
    policy: Policy | None = None,
    evaluate: Evaluate | None = None,
    resume: bool = False,
) -> LoopResult:
    """Rounds 1 to max_rounds, or until a stop; round 0 trains on no pseudo-label, or stores its candidates.

    Each round is checked before it is stored: ids in matches are in their pools, every image and box
    has a result, no box is admitted twice; ValueError names what is wrong.
    The previous pool is read back from its committed partition, so no lineage grows over
    rounds. The detector runs once a round: its boxes are saved before they are matched,
    jittered and stored. On convergence the plain form ends at once and the other trains once more; a risk stop
    keeps the checkpoint that the round began with.

    With `resume` a loop that ended anywhere goes on: committed rounds are not run again, the stopping
    state is rebuilt from their metadata, and training or evaluation that the store's marks say was finished isn't
    repeated; what was under way is begun anew. Its `evaluations` are those of this call. Without it
    a store that has rounds is an error.
    """
    policy = policy or dual_gate(config.admission)
    state, evaluations = StoppingState(config.stopping), []
    done = {r.round_id: r for r in store.all_metadata().collect()} if resume else {}
    marks = store.marks() if resume else {}
    if sorted(done) != list(range(len(done))):
        raise ValueError(f"{store.path} has rounds {sorted(done)}, which are not the first ones")

    def trained(rows: DataFrame, t: int, checkpoint: str | None) -> str:
        if ("trained", t) in marks:
            return marks["trained", t]
        new = train(rows, t, checkpoint)
        store.mark("trained", t, new)
        return new

    if 0 in done:
        checkpoint = done[0].model_checkpoint
    else:
        if config.bootstrap:
            if checkpoint is None:
                raise ValueError("a loop that bootstraps needs a checkpoint")
            images, found = infer(checkpoint, 0)
            rows = bootstrap_rows(by_image(found))
        else:
            images = spark.createDataFrame([], "image_id string")
            rows = spark.createDataFrame([], "round_id int, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in BANK_ROW.fields))
            checkpoint = trained(rows, 0, checkpoint)
        attempt = store.write(0, rows, images)
        n = store.written_rows(0, attempt).count()
        store.commit(attempt, round_id=0, n_candidates=n, n_admitted=0, raw_churn=0.0, stable_yield=0.0, class_drift=0.0, stop_condition_met=False, model_checkpoint=checkpoint)

    for t in range(1, config.max_rounds + 1):
        if t in done:
            checkpoint = done[t].model_checkpoint
            state.observe(t, done[t].raw_churn, done[t].stable_yield, done[t].class_drift)
        else:
            _one_round(store, config, infer, checkpoint, jitter, policy, state, t)
        risky = state.stopped and state.reason != "convergence"
        last = state.stopped or t == config.max_rounds
        if risky or (last and not config.train_on_stop):
            break
        if t + 1 in done:
            continue
        checkpoint = trained(store.pool(t).where("admitted"), t, checkpoint)
        if evaluate is not None and not state.stopped and ("evaluated", t) not in marks:
            evaluations.append(evaluate(checkpoint, t))
            store.mark("evaluated", t)
        if last:
            break
    return LoopResult(checkpoint, state.reason or "max_rounds", state, evaluations)


def _one_round(store: RoundStore, config: LoopConfig, infer: Infer, checkpoint: str, jitter: JitterDetect | None, policy: Policy, state: StoppingState, t: int) -> None:
    """Infers, matches, scores, admits, stores, checks and commits round `t`, which the state then knows.

    The store deals out boxes by image, and so are those found; what belongs to a box goes along through the matching.
    So neither the join with the round before, nor the stored rows, nor their checks move the boxes again. Rows that fail a check
    are dropped before they are committed.
    """
    images, found = infer(checkpoint, t)
    place, kind = f"{shared_dir(store.spark)}/found-{uuid.uuid4().hex}", found.schema
    found = read_buckets(store.spark, place, kind, write_buckets(by_image(found), place))
    before = store.pool(t - 1)
    matches = match(found, before, config.matching, keep=["box", "class_scores"])
    triples = None
    if jitter is not None:
        matches = saved(matches)
        sizes = images if "width" in images.columns else images.select("image_id", F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"))
        asked = jitter_candidates(matches, found, sizes, config.tau_pre)
        triples = jitter_by_detector(asked, jitter, config.matching.min_iou_gate)
    scored = admit(score(matches, triples, config.scoring), policy)
    attempt = store.write(t, _kept_rows(scored).withColumn("round_id", F.lit(t)), images)
    rows = store.written_rows(t, attempt)
    own = rows.withColumnsRenamed({"box_id": "box_id_t", "matched_prev_id": "box_id_prev"})
    try:
        with joined_in_buckets(store.spark):
            require_clean(round_report(own, found, before, own))
    except ValueError:
        store.drop(t, attempt)
        raise
    s = round_signals(rows, before, config.stopping.tau_geom_change, infer_classes(rows, before)).first()
    state.observe(t, s.raw_churn, s.stable_yield, s.class_drift)
    store.commit(
        attempt,
        round_id=t,
        n_candidates=s.n_t,
        n_admitted=s.n_admitted,
        raw_churn=s.raw_churn,
        stable_yield=s.stable_yield,
        class_drift=s.class_drift,
        stop_condition_met=state.consecutive > 0,
        model_checkpoint=checkpoint,
    )


def naive_round(detections: DataFrame, images: DataFrame, tau: float, class_names: list[str], round_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(labels, per-class audit, summary) of a round that admits by confidence alone."""
    from ..operators.admission import naive_labels
    from ..operators.audit import audit_summary, class_audit

    labels = naive_labels(detections, tau, len(class_names), round_id)
    return labels, class_audit(detections, tau, class_names, medians=False), audit_summary(images, detections, tau, class_names)


def naive_loop(store: RoundStore, config: LoopConfig, tau: float, class_names: list[str], infer: Infer, train: Train, checkpoint: str) -> tuple[str, list[dict]]:
    """Rounds that admit by confidence alone and train on what they admit; the last checkpoint and a summary of each round.

    Each round's boxes are stored, with those above `tau` admitted, and committed; the next one's detector is
    trained on them. Nothing is matched or scored, and no signal stops the loop.
    """
    spark, audits = store.spark, []
    for t in range(config.max_rounds):
        images, found = infer(checkpoint, t)
        rows = saved(bootstrap_rows(by_image(found)).withColumn("admitted", at_least(F.col("confidence"), tau)))
        require_clean(admitted_report(rows.where("admitted"), rows))
        attempt = store.write(t, rows, images)
        _, _, summary = naive_round(found, images, tau, class_names, t)
        audits.append(summary.first().asDict())
        n = store.written_rows(t, attempt).agg(F.count("*").alias("n"), F.count_if("admitted").alias("k")).first()
        store.commit(attempt, round_id=t, n_candidates=n.n, n_admitted=n.k, raw_churn=0.0, stable_yield=n.k / n.n if n.n else 0.0, class_drift=0.0, stop_condition_met=False, model_checkpoint=checkpoint)
        checkpoint = train(store.pool(t).where("admitted"), t, checkpoint)
    return checkpoint, audits


def evaluate_rounds(store: RoundStore, evaluate: Evaluate, exists: Callable[[str], bool]) -> list:
    """Evaluates the checkpoint of each committed round, in order; those that are gone are passed over."""
    return [evaluate(r.model_checkpoint, r.round_id) for r in store.all_metadata().collect() if exists(r.model_checkpoint)]
