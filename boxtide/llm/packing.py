"""Best-fit packing by a configuration program over the histogram of lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint
from .encoder import encoded

CAPACITY = 2048
#: Rounds of multiplicative weights, at most; by how much a round lowers a weight whose length it covers whole; when to stop.
ROUNDS, ETA, GAP = 30, 4.0, 0.002
#: Rounds in which what is left after rounding down is placed by priced sequences.
LAST_ROUNDS = 40

Config = tuple[tuple[int, int], ...]  # (length, pieces of it)


def best_fillings(prices: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack by dynamic programming: for each room the best sum of prices, and the place of the length to take first, -1 to leave a token free."""
    best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        if upto[room]:
            value = best[room - lengths[: upto[room]]] + prices[: upto[room]]
            k = int(value.argmax())
            if value[k] > best[room]:
                best[room], take[room] = value[k], k
    return best, take


def _filled(k: int, lengths: list[int], take: list[int], capacity: int) -> tuple[dict[int, int], int]:
    """The best sequence that holds the length at place k: pieces by place, and the room that it leaves."""
    taken, room = {k: 1}, capacity - lengths[k]
    while room > 0:
        one = take[room]
        if one < 0:
            room -= 1
            continue
        taken[one] = taken.get(one, 0) + 1
        room -= lengths[one]
    return taken, capacity - sum(n * lengths[k] for k, n in taken.items())


def _largest_first(places: np.ndarray, lengths: np.ndarray, left: np.ndarray, capacity: int) -> dict[int, int]:
    """Pieces by place of a sequence that is filled by the largest lengths that fit and are left, as far as whole pieces are."""
    room, taken, k = capacity, {}, len(places) - 1
    sizes = lengths[places]
    while k >= 0:
        k = min(k, int(np.searchsorted(sizes, room, "right")) - 1)
        if k >= 0:
            size = int(sizes[k])
            taken[int(places[k])] = n = min(max(1, int(left[places[k]])), room // size)
            room -= n * size
            k -= 1
    return taken


@dataclass
class Program:
    """A fractional covering of a histogram: how often each configuration is used, their sum, and a bound that no covering is below."""

    uses: dict[Config, float]
    value: float
    bound: float


def solve(counts: np.ndarray, capacity: int, rounds: int = ROUNDS, eta: float = ETA, gap: float = GAP) -> Program:
    """The configuration program over the histogram, by multiplicative weights.

    The program: use configurations, a fraction if need be, so that every length is covered as often as
    it occurs, with the least sum of uses. A length's price is its size times its weight, which falls by an
    exponential of the share of its demand that a round covers. A round has one knapsack,
    which prices the best sequence for every length; longest first, those that leave no room
    are used until the first of their lengths is covered. Prices divided by the best
    sequence's are a dual solution, so each round gives a bound that no covering is below. When
    a round covers no more than `gap` of the bound, or no more than that is uncovered, the
    rest is covered largest first.
    """
    lengths = np.flatnonzero(counts)
    demand, sizes = counts[lengths].astype(float), lengths.tolist()
    weights, left = np.ones(len(lengths)), demand.copy()
    uses: dict[Config, float] = {}
    bound = 0.0

    def cover(taken: dict[int, int]) -> float:
        amount = float(min(left[i] / n for i, n in taken.items()))
        if amount > 1e-9:
            config = tuple(sorted((sizes[i], n) for i, n in taken.items()))
            uses[config] = uses.get(config, 0.0) + amount
        for i, n in taken.items():
            left[i] = max(0.0, left[i] - n * amount)
            left[i] *= left[i] > 1e-9
        return amount

    for _ in range(rounds) if len(lengths) else ():
        prices, before = lengths * weights, left.copy()
        best, take = best_fillings(prices, lengths, capacity)
        bound = max(bound, float(demand @ prices / best[capacity]))
        none = left == 0
        if none.any():
            take = best_fillings(np.where(none, 0.0, prices), lengths, capacity)[1]
        fillings, covered = take.tolist(), 0.0
        for k in range(len(sizes) - 1, -1, -1):
            if left[k]:
                taken, room = _filled(k, sizes, fillings, capacity)
                covered += 0.0 if room else cover(taken)
        weights *= np.exp(-eta * (before - left) / demand)
        weights /= weights.max()
        if covered <= gap * bound or left @ lengths <= gap * bound * capacity:
            break
    while left.any():
        cover(_largest_first(np.flatnonzero(left), lengths, left, capacity))
    return Program(uses, sum(uses.values()), bound)


def configurations(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """(lengths of a sequence, how often it is used), which hold counts[l] pieces of each length l.

    The configuration program is solved and its uses of full sequences rounded down, the largest first; what is left
    is a smaller histogram, whose program is solved again, as long as that places any
    sequence. The rest, a sequence or so for each configuration, is placed whole: by full sequences
    that the knapsack prices, as often as the counts allow, then largest first, each filled up
    by the largest lengths that fit. The work depends on the number of different lengths, not of pieces.
    """
    out: list[tuple[list[int], int]] = []
    left = counts.astype(np.int64).copy()
    left[0] = 0

    def use(taken: dict[int, int], most: float = np.inf) -> int:
        times = int(min(most, *(left[size] // k for size, k in taken.items())))
        if times:
            for size, k in taken.items():
                left[size] -= k * times
            out.append(([size for size, k in sorted(taken.items(), reverse=True) for _ in range(k)], times))
        return times

    placed = left.any()
    while placed:
        uses = solve(left, capacity).uses
        full = [(x, c) for c, x in uses.items() if x >= 1 and sum(size * n for size, n in c) == capacity]
        placed = sum(use(dict(c), x) for x, c in sorted(full, reverse=True))
    whole = np.maximum(left, 1).astype(float)
    for _ in range(LAST_ROUNDS):
        lengths = np.flatnonzero(left)
        sizes, used = lengths.tolist(), 0
        prices = lengths * (1 + lengths / (2 * capacity)) * np.exp(left[lengths] / whole[lengths] - 1)
        take = best_fillings(prices, lengths, capacity)[1].tolist()
        for k in range(len(sizes) - 1, -1, -1):
            taken, free = _filled(k, sizes, take, capacity)
            used += 0 if free else use({sizes[i]: n for i, n in taken.items()})
        if not used:
            break
    every = np.arange(len(left))
    while left.any():
        use(_largest_first(np.flatnonzero(left), every, left, capacity))
    return out


def slots(configs: list[tuple[list[int], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (length << 40 | first rank), and for each the first sequence and the offset.

    The pieces of a length are ranked from 0; from a key on, each next one goes to the next
    sequence, at the same offset.
    """
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, times in configs:
        at = 0
        for size in lengths:
            rows.append(((size << 40) | used.get(size, 0), sequence, at))
            used[size] = used.get(size, 0) + times
            at += size
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 3)
    return table[:, 0], table[:, 1], table[:, 2]


def pieces(docs: DataFrame, tokenizer: str, end: int, capacity: int, key: str = "doc_id") -> DataFrame:
    """key, piece, start, length, ids_crc32 of each piece, with _part and its _rank among those of its length there."""
    kind = docs.schema[key].dataType.simpleString()
    names = ["piece", "start", "length", "ids_crc32", "_part", "_rank"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, met = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        tail = np.array([end], "<u4").tobytes()
        for b in batches:
            rows, of = [], []
            for n, found in enumerate(encoded(b.column(1), tokenizer)):
                ids = found.tobytes() + tail
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    size = len(own) // 4
                    rows.append((k, at // 4, size, zlib.crc32(own), part, met[size]))
                    met[size] += 1
                    of.append(n)
            table = np.array(rows, np.int64).reshape(-1, 6)
            columns = [pa.array(table[:, 0].astype(np.int32)), *(pa.array(np.ascontiguousarray(table[:, k])) for k in range(1, 6))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of, pa.int64())), *columns], ["key", *names])

    out = docs.select(key, "text").mapInArrow(cut, f"key {kind}, piece int, start long, length long, ids_crc32 long, _part long, _rank long")
    return out.withColumnRenamed("key", key)


def pack(docs: DataFrame, tokenizer: str, end: int = 0, capacity: int = CAPACITY, key: str = "doc_id") -> DataFrame:
    """key, piece, start, length, ids_crc32, sequence_id, offset of each piece of `docs`.

    A document is its whole text's ids and `end` (null and empty texts: `end` alone); longer ones
    are cut into pieces of `capacity`. Equal rows are documents of their own. The texts are
    read and encoded once; only the histogram of lengths, `capacity` numbers at most,
    reaches the driver, and the table of slots that goes back is bounded by the number of
    configurations. A piece's rank among those of its length is its rank within its
    partition and length plus the counts of the partitions before. No rows: no rows.
    """
    each = checkpoint(pieces(docs, tokenizer, end, capacity, key))
    sizes = each.groupBy("_part", "length").agg(F.count("*").alias("_n"))
    counts = np.zeros(capacity + 1, np.int64)
    for size, n in sizes.groupBy("length").agg(F.sum("_n")).collect():
        counts[size] = n
    keys, firsts, offsets = slots(configurations(counts, capacity))
    before = sizes.selectExpr(
        "_part", "length", "coalesce(sum(_n) over (partition by length order by _part rows between unbounded preceding and 1 preceding), 0L) as _before"
    )
    ranked = each.join(before, ["_part", "length"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    shared = docs.sparkSession.sparkContext.broadcast((keys, firsts, offsets))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, firsts, offsets = shared.value
        for b in batches:
            mine = (b.column(3).to_numpy() << 40) | b.column(5).to_numpy()
            at = np.searchsorted(keys, mine, "right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(firsts[at] + mine - keys[at]), pa.array(offsets[at])], [*b.schema.names[:5], "sequence_id", "offset"])

    kind = docs.schema[key].dataType.simpleString()
    slim = ranked.select(F.col(key).alias("key"), "piece", "start", "length", "ids_crc32", "_rank")
    out = slim.mapInArrow(place, f"key {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("key", key)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of `documents` in sequences of 2048 ids at most; end id 0."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))
