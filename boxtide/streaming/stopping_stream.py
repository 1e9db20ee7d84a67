"""The stopping rules as a stateful stream: what a round needs of those before it is kept in state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.signals import StoppingState
from ..schema import StoppingConfig

ROUND = "round_id int, raw_churn double, stable_yield double, class_drift double"
STOPS = "loop string, round_id int, met boolean, consecutive int, stop boolean, risk_stop boolean"


class StoppingProcessor(StatefulProcessor):
    """Of one loop: the round before, how many in a row met the rules, and rounds that came early."""

    def __init__(self, config: StoppingConfig, first_round: int) -> None:
        self.config, self.first_round = config, first_round

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.before = handle.getValueState("before", f"{ROUND}, consecutive int")
        self.early = handle.getMapState("early", "round_id int", ROUND)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        before = self.before.get() if self.before.exists() else None
        due = before[0] + 1 if before else self.first_round
        for frame in rows:
            for r in frame.itertuples(index=False):
                if r.round_id >= due and not self.early.containsKey((int(r.round_id),)):
                    self.early.updateValue((int(r.round_id),), (int(r.round_id), float(r.raw_churn), float(r.stable_yield), float(r.class_drift)))
        out = []
        while self.early.containsKey((due,)):
            now = tuple(self.early.getValue((due,)))
            self.early.removeKey((due,))
            state = StoppingState(self.config, [tuple(before[:4])] if before else [], before[4] if before else 0).observe(*now)
            risk = (state.reason or "").startswith("risk_stop")
            out.append((key[0], due, state.consecutive > 0, state.consecutive, state.consecutive >= self.config.k_consecutive, risk))
            before, due = (*now, state.consecutive), due + 1
        if out:
            self.before.update(before)
            yield pd.DataFrame(out, columns=[field.split()[0] for field in STOPS.split(", ")])

    def close(self) -> None:
        pass


def keep_state_in_files(spark: SparkSession) -> None:
    """Lets streams that this session starts keep their state in RocksDB, checkpointed with the stream."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stopping_stream(rounds: DataFrame, config: StoppingConfig = StoppingConfig(), first_round: int = 1) -> DataFrame:
    """STOPS of a stream of rounds (loop, round_id and three signals): what `signal_deltas` gives of a whole history.

    The state of a loop is its last round, the count of rounds in a row that met the rules, and rounds that came
    before their turn, which wait for those before them; it doesn't grow with the rounds that are done. A round
    given again changes nothing. Loops are independent of each other and dealt out by name.
    Rows without a round number or with a signal that is null are no rounds. The session's state store must
    be one that can hold more than a value a key (`keep_state_in_files`).
    """
    whole = rounds.selectExpr("loop", "cast(round_id as int) round_id", "raw_churn", "stable_yield", "class_drift").dropna(subset=["round_id", "raw_churn", "stable_yield", "class_drift"])
    return whole.groupBy("loop").transformWithStateInPandas(StoppingProcessor(config, first_round), STOPS, "append", "none")
