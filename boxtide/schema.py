"""Row types, configurations and their checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

BOX = T.StructType([T.StructField(c, T.DoubleType()) for c in ("x1", "y1", "x2", "y2")])

#: One box after suppression; `images` lists the images apart, so that empty ones are kept.
DETECTION = T.StructType(
    [
        T.StructField("image_id", T.StringType(), False),
        T.StructField("box_id", T.StringType(), False),
        T.StructField("round_id", T.IntegerType(), False),
        T.StructField("box", BOX, False),
        T.StructField("pred_class", T.IntegerType(), False),
        T.StructField("class_scores", T.ArrayType(T.DoubleType()), False),
        T.StructField("confidence", T.DoubleType(), False),
    ]
)

#: One row a box of a round, as the store keeps it; round_id is the partition.
BANK_ROW = T.StructType(
    [f for f in DETECTION.fields if f.name != "round_id"]
    + [
        T.StructField("status", T.StringType()),
        T.StructField("matched_prev_id", T.StringType()),
        T.StructField("pred_class_prev", T.IntegerType()),
        T.StructField("c_cls_dist", T.DoubleType()),
        T.StructField("c_loc", T.DoubleType()),
        T.StructField("c_jitter_loc", T.DoubleType()),
        T.StructField("jitter_executed", T.BooleanType()),
        T.StructField("stability", T.DoubleType()),
        T.StructField("admitted", T.BooleanType()),
    ]
)

ROUND_METADATA = T.StructType(
    [
        T.StructField("round_id", T.IntegerType(), False),
        T.StructField("n_candidates", T.LongType()),
        T.StructField("n_admitted", T.LongType()),
        T.StructField("raw_churn", T.DoubleType()),
        T.StructField("stable_yield", T.DoubleType()),
        T.StructField("class_drift", T.DoubleType()),
        T.StructField("stop_condition_met", T.BooleanType()),
        T.StructField("model_checkpoint", T.StringType()),
    ]
)

EVAL_RESULT = T.StructType(
    [
        T.StructField("map50", T.DoubleType()),
        T.StructField("map50_95", T.DoubleType()),
        T.StructField("per_class", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("checkpoint", T.StringType()),
        T.StructField("round_id", T.LongType()),
        T.StructField("n_images", T.LongType()),
        T.StructField("speed_ms", T.DoubleType()),
    ]
)

ANNOTATION_DOCUMENT = T.StructType(
    [
        T.StructField(
            "images",
            T.ArrayType(
                T.StructType(
                    [T.StructField("id", T.LongType()), T.StructField("file_name", T.StringType()), T.StructField("width", T.LongType()), T.StructField("height", T.LongType())]
                )
            ),
        ),
        T.StructField(
            "annotations",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("image_id", T.LongType()),
                        T.StructField("category_id", T.LongType()),
                        T.StructField("bbox", T.ArrayType(T.DoubleType())),
                        T.StructField("iscrowd", T.LongType()),
                    ]
                )
            ),
        ),
        T.StructField("categories", T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())]))),
    ]
)

# Fixed values of the data model.
CLASS_NAMES = ["bicycle", "car", "motorcycle", "bus", "truck"]
SELECTED_CATEGORIES = {2: 0, 3: 1, 4: 2, 6: 3, 8: 4}  # category id: class id


@dataclass(frozen=True)
class MatchingConfig:
    min_iou_gate: float = 0.3
    lambda_cls: float = 1.0
    epsilon_match: float = 0.05


@dataclass(frozen=True)
class ScoringConfig:
    alpha: float = 0.33
    beta: float = 0.33
    gamma: float = 0.34


@dataclass(frozen=True)
class AdmissionConfig:
    tau_stab: float = 0.6
    tau_conf: float = 0.4


@dataclass(frozen=True)
class StoppingConfig:
    epsilon_churn: float = 0.02
    epsilon_yield: float = 0.03
    epsilon_drift: float = 0.01
    tau_yield: float = 0.05
    tau_drift: float = 0.10
    tau_geom_change: float = 0.5
    k_consecutive: int = 2
    warmup_rounds: int = 2
    tau_risk_churn: float | None = None  # a number switches the risk stop on


@dataclass(frozen=True)
class LoopConfig:
    """What the two forms of the round loop do differently, and their thresholds."""

    matching: MatchingConfig = MatchingConfig()
    scoring: ScoringConfig = ScoringConfig()
    admission: AdmissionConfig = AdmissionConfig()
    stopping: StoppingConfig = StoppingConfig()
    tau_pre: float = 0.3
    max_rounds: int = 10
    bootstrap: bool = False  # round 0 stores its candidates instead of training on none
    train_on_stop: bool = False  # trains once more on convergence and in the last round

    def __post_init__(self) -> None:
        if self.tau_pre != self.matching.min_iou_gate:
            raise ValueError(f"tau_pre ({self.tau_pre}) must equal min_iou_gate ({self.matching.min_iou_gate})")
        if self.max_rounds < 1:
            raise ValueError("max_rounds must be at least 1")
