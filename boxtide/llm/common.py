"""Helpers that the training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint, shared_dir


def new_folder(spark: SparkSession, what: str) -> str:
    """A path below `shared_dir` that no other run uses."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def cut_by_bytes(batches: Iterable[pa.RecordBatch], text: int, most: int) -> Iterator[pa.RecordBatch]:
    """The rows again, in slices of about `most` bytes in column `text` or of one row."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy().astype(np.int64))
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield b.slice(at, to - at)
            at = to


@contextmanager
def batches_of(spark: SparkSession, most: int) -> Iterator[None]:
    """While this holds, Python workers are sent batches of about `most` bytes or of one row; for relations with rows of some MB that are written inside."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Rows of a broadcast relation, at most.
FEW = 1 << 20


def few(df: DataFrame, most: int = FEW) -> DataFrame:
    """`df`, to be broadcast in a join if it has `most` rows or fewer; else joined by a shuffle. It is counted: give a table or a checkpointed frame."""
    return F.broadcast(df) if df.count() <= most else df


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """`df` checkpointed in the order of the columns, with a gapless long `position` from 0.

    Rows are dealt by range and numbered within their partition; only one count for each
    partition meets in a single task. Give enough columns to tell all but equal rows
    apart: then no group is too large for a partition. Nulls come first.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = checkpoint(dealt.withColumn("_mid", F.monotonically_increasing_id()))
    part = F.shiftright("_mid", 33).cast("int").alias("_part")
    within = F.col("_mid").bitwiseAND((1 << 33) - 1)
    sizes = dealt.groupBy(part).agg(F.count("*").alias("_n"))
    before = sizes.selectExpr(
        "_part", "coalesce(sum(_n) over (order by _part rows between unbounded preceding and 1 preceding), 0L) as _before"
    )
    return (
        dealt.withColumn("_part", part)
        .join(before, "_part")
        .withColumn("position", F.col("_before") + within)
        .drop("_mid", "_part", "_before")
    )
