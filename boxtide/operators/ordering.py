"""Positions in a global order, batches and samples by position."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint


def numbered_by(df: DataFrame, *order: str) -> DataFrame:
    """`df` with `position`, from 0 in the order of the columns.

    Rows are dealt by range and numbered within their partition; only a count for each partition
    meets in one task. The numbers are checkpointed, so that the counts are those of the same
    partitions, also after a lost executor. The order must be total for the numbers to be
    the same in every run.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = checkpoint(dealt.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.selectExpr("_part", "coalesce(sum(_n) over (order by _part rows between unbounded preceding and 1 preceding), 0L) as _before")
    within = F.col("_at").bitwiseAND((1 << 33) - 1)
    return dealt.withColumn("_part", part).join(before, "_part").withColumn("position", F.col("_before") + within).drop("_at", "_part", "_before")


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows sorted by `key`, batch by batch, as tables that cut no group in two; many small groups share a table."""
    held: pa.Table | None = None
    for b in batches:
        now = pa.Table.from_batches([b])
        now = pa.concat_tables([held, now]) if held is not None else now
        if not now.num_rows:
            continue
        groups = now[key].combine_chunks()
        whole = pc.sum(pc.not_equal(groups, groups[-1])).as_py() or 0
        if whole:
            yield now.slice(0, whole)
        held = now.slice(whole)
    if held is not None and held.num_rows:
        yield held


def batches(images: DataFrame, size: int, key: str = "image_id") -> DataFrame:
    """`images` sorted by their key, with batch_id and place: runs of `size` in that order."""
    n = numbered_by(images, key)
    return n.withColumn("batch_id", F.expr(f"position div {int(size)}")).withColumn("place", F.col("position") % size).drop("position")


def even_sample(rows: DataFrame, n: int, key: str) -> DataFrame:
    """The rows at places i * rows div n for i < n in the order of the key."""
    total = rows.count()
    wanted = sorted({i * total // n for i in range(n)}) if total else []
    return numbered_by(rows, key).where(F.col("position").isin(wanted))


def first_n(rows: DataFrame, n: int, *order: str) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def values_at(rows: DataFrame, group: str, value: str, wanted: DataFrame, parts: int = 1024) -> DataFrame:
    """(group, place, value): the value at each place of `wanted` (group, place), from 0 in a group's ascending order.

    Nothing is sorted: the values between a place's bounds are counted in `parts` equal parts, the one
    that holds the place gives the next bounds, the least and the greatest value in it, until these are equal.
    Each turn is one aggregation with counts combined before the shuffle, however many rows a group
    has and however often a value comes. `wanted` is sent to all tasks: a few places of groups that are few by nature, such as
    classes. `rows` is read once a turn, some three or four times for numbers without order in their
    digits: give a table or a checkpointed frame. Null groups, null values and NaN don't count; a place
    beyond a group's values has no row.
    """
    v = F.col("_v")
    own = rows.select(F.col(group).alias("_g"), F.col(value).cast("double").alias("_v")).where(F.col("_g").isNotNull() & v.isNotNull() & ~F.isnan(v))
    ends = own.groupBy("_g").agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.count("*").alias("n"))
    state = wanted.select(F.col(group).alias("_g"), "place").distinct().join(ends, "_g").where("place < n")
    state = checkpoint(state.select("_g", "place", F.col("place").alias("rank"), "lo", "hi"))
    while not (wide := state.where("lo < hi")).isEmpty():
        part = F.least(F.lit(parts - 1), F.floor((v - F.col("lo")) / (F.col("hi") - F.col("lo")) * parts)).alias("part")
        counted = own.join(F.broadcast(wide), "_g").where(v.between(F.col("lo"), F.col("hi"))).groupBy("_g", "place", "rank", part)
        counted = counted.agg(F.count("*").alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"))
        before = F.sum("n").over(Window.partitionBy("_g", "place").orderBy("part")) - F.col("n")
        narrowed = counted.withColumn("before", before).where("rank >= before and rank < before + n")
        state = checkpoint(state.where("lo >= hi").unionByName(narrowed.select("_g", "place", (F.col("rank") - F.col("before")).alias("rank"), "lo", "hi")))
    return state.select(F.col("_g").alias(group), "place", F.col("lo").alias(value))
