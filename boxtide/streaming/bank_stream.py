"""Signals of rounds as they arrive: the store's metadata as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.signals import StoppingState
from ..schema import ROUND_METADATA, StoppingConfig


def metadata_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(ROUND_METADATA).json(f"{path}/commits")


def watch_rounds(spark: SparkSession, path: str, checkpoint: str, state: StoppingState | None = None) -> tuple[StoppingState, StreamingQuery]:
    """Feeds each newly committed round, in order, to a stopping state; a row a round reaches the driver."""
    state = state or StoppingState(StoppingConfig())

    def observe(batch: DataFrame, _: int) -> None:
        for r in batch.where("round_id > 0").orderBy("round_id").collect():
            if r.round_id not in {h[0] for h in state.history}:
                state.observe(r.round_id, r.raw_churn, r.stable_yield, r.class_drift)

    query = metadata_stream(spark, path).writeStream.foreachBatch(observe).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    return state, query
