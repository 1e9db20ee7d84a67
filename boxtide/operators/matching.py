"""Boxes of one round against boxes of the round before: gated edges, assignment, status.

All of it is partitioned by image: the gated join's exchanges are the only ones, and the exact
one-to-one assignment runs on its sorted partitions in Arrow batches, by connected blocks of an
image's candidate graph and on their edges alone. What a task must hold is an image's edges.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import js_of_scores
from ..functions.geometry import iou
from ..schema import MatchingConfig
from .ordering import whole_groups

MATCHES = (
    "image_id string, box_id_t string, box_id_prev string, status string, iou double, js double,"
    " pred_class_t int, pred_class_prev int, confidence double, candidates int, cost_gap double"
)
MATCH_FIELDS = [field.split()[0] for field in MATCHES.split(",")]
EDGE_FIELDS = ["image_id", "box_id_t", "box_id_prev", "iou", "js", "pred_class_t", "pred_class_prev", "confidence", "cost"]


def image_alignment(images_t: DataFrame, images_prev: DataFrame) -> DataFrame:
    """image_id with in_t and in_prev for every image of either round."""
    a = images_t.select("image_id", F.lit(True).alias("in_t")).distinct()
    b = images_prev.select("image_id", F.lit(True).alias("in_prev")).distinct()
    joined = a.join(b, "image_id", "full_outer")
    return joined.select("image_id", F.coalesce("in_t", F.lit(False)).alias("in_t"), F.coalesce("in_prev", F.lit(False)).alias("in_prev"))


def _side(boxes: DataFrame, name: str, scores: Column, keep: Sequence[str] = ()) -> DataFrame:
    return boxes.select(
        "image_id",
        F.col("box_id").alias(f"box_id_{name}"),
        F.col("box").alias(f"box_{name}"),
        F.col("pred_class").alias(f"pred_class_{name}"),
        scores.alias(f"p_{name}"),
        *([F.col("confidence")] if name == "t" else []),
        *[F.col(c).alias(f"_kept_{c}") for c in keep],
    )


def _gated_pairs(t: DataFrame, p: DataFrame, config: MatchingConfig, how: str) -> DataFrame:
    """Pairs of two sides' boxes in an image with iou >= the gate, which is a residual of the join on the image."""
    gate = iou(F.col("box_t"), F.col("box_prev")) >= config.min_iou_gate
    pairs = t.alias("t").join(p.alias("p"), (F.col("t.image_id") == F.col("p.image_id")) & gate, how)
    return pairs.withColumn("iou", F.when(F.col("box_id_prev").isNotNull(), iou(F.col("box_t"), F.col("box_prev"))))


def candidate_edges(current: DataFrame, previous: DataFrame, config: MatchingConfig = MatchingConfig(), keep_lonely: bool = False) -> DataFrame:
    """Pairs of the same image with iou >= the gate, with iou, js and cost = 1 - iou + lambda * js.

    The gate is a residual of the join on the image, so that the divergence is computed for
    gated pairs only, an Arrow batch at a time. `keep_lonely` keeps current
    boxes without a candidate, their pair null.
    """
    scores, weight = F.col("class_scores").cast("array<double>"), config.lambda_cls
    pairs = _gated_pairs(_side(current, "t", scores), _side(previous, "prev", scores), config, "left" if keep_lonely else "inner")
    own = ["box_id_t", "box_id_prev", "iou", "p_t", "p_prev", "pred_class_t", "pred_class_prev", "confidence"]
    kinds = dict(current.dtypes) | {f"{c}_prev": kind for c, kind in previous.dtypes}
    names = {"image_id": "image_id", "box_id_t": "box_id", "box_id_prev": "box_id_prev", "pred_class_t": "pred_class", "pred_class_prev": "pred_class_prev", "confidence": "confidence"}
    schema = ", ".join(f"{c} {'double' if c in ('iou', 'js', 'cost') else kinds[names[c]]}" for c in EDGE_FIELDS)

    def priced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _with_costs(pa.Table.from_batches([b]), weight).select(EDGE_FIELDS).to_batches()

    return pairs.select(F.col("t.image_id").alias("image_id"), *own).mapInArrow(priced, schema)


def two_best_costs(edges: DataFrame) -> DataFrame:
    """image_id, box_id_t, candidates, best, second (null for a single candidate)."""
    costs = F.array_sort(F.collect_list("cost"))
    return edges.groupBy("image_id", "box_id_t").agg(
        F.count("*").cast("int").alias("candidates"), F.get(costs, F.lit(0)).alias("best"), F.get(costs, F.lit(1)).alias("second")
    )


def connected_blocks(row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """For each edge (row, col) the number of its block: edges that share a row or column are in one."""
    n = int(row.max()) + 1 if len(row) else 0
    root = np.arange(n + (int(col.max()) + 1 if len(col) else 0))
    while True:
        a, b = root[row], root[n + col]
        apart = a != b
        if not apart.any():
            return a
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (root[root] != root).any():
            root = root[root]


def least_cost_edges(row: np.ndarray, col: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Which edges pair as many rows with columns as can be, one to one, at least total cost; a NaN cost pairs nothing.

    Each connected block is solved by itself, with memory and work in its edges alone: no grid of
    its rows and columns is made.
    """
    taken = np.zeros(len(row), bool)
    real = np.flatnonzero(~np.isnan(cost))
    block = connected_blocks(row[real], col[real])
    order = real[np.argsort(block, kind="stable")]
    edge = np.flatnonzero(np.r_[True, np.diff(np.sort(block)) != 0, True]) if len(real) else np.zeros(1, int)
    rows, cols, costs, places = row[order].tolist(), col[order].tolist(), cost[order].tolist(), order.tolist()
    chosen: list[int] = []
    for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        r, n_rows = _ranks(rows[lo:hi])
        c, n_cols = _ranks(cols[lo:hi])
        if n_rows > n_cols:
            r, c = c, r
        chosen += [places[lo + k] for k in _solved_block(r, c, costs[lo:hi])]
    taken[chosen] = True
    return taken


def _ranks(values: list[int]) -> tuple[list[int], int]:
    """Each value's place among the different ones, and how many they are."""
    place = {v: k for k, v in enumerate(sorted(set(values)))}
    return [place[v] for v in values], len(place)


def _spread(n: int) -> list[int]:
    """0 to n - 1 in the order of a golden-section sequence."""
    return sorted(range(n), key=lambda i: i * 0.6180339887498949 % 1)


def _solved_block(row: list[int], col: list[int], cost: list[float]) -> list[int]:
    """Places of the chosen edges of one block with no more rows than columns.

    Each row in turn takes the shortest augmenting path, with potentials that keep reduced costs
    from falling below zero. Rows come spread over the block, by a golden-section sequence, so that all but the last ones
    meet short stretches of others: in the order of a chain each would walk through all before it. A row may stay alone at a price above what any set of others can save,
    so that the number of pairs comes first.
    """
    n = max(row) + 1
    low = min(cost)
    alone = (max(cost) - low) * (n + 1) + 1
    edges: list[list[tuple[int, float, int]]] = [[] for _ in range(n)]
    for k, (i, j, c) in enumerate(zip(row, col, cost, strict=True)):
        edges[i].append((j, c - low, k))
    for i in range(n):
        edges[i].append((-1 - i, alone, -1))
    of_row, of_column = [0.0] * n, {}
    holder: dict[int, int] = {}
    held: list[tuple[int, int]] = [(0, -1)] * n
    for i in _spread(n):
        least: dict[int, float] = {}
        back: dict[int, tuple[int, int]] = {}
        done: dict[int, float] = {}
        open_columns: list[tuple[float, int]] = []
        at, length = i, 0.0
        while True:
            for j, c, k in edges[at]:
                reached = length + max(c - of_row[at] - of_column.get(j, 0.0), 0.0)
                if j not in done and reached < least.get(j, np.inf):
                    least[j], back[j] = reached, (at, k)
                    heapq.heappush(open_columns, (reached, j))
            while True:
                length, end = heapq.heappop(open_columns)
                if end not in done and length == least[end]:
                    break
            if end not in holder:
                break
            done[end] = length
            at = holder[end]
        of_row[i] += length
        for j, reached in done.items():
            of_column[j] = of_column.get(j, 0.0) - (length - reached)
            of_row[holder[j]] += length - reached
        while True:
            at, k = back[end]
            before = held[at][0]
            holder[end], held[at] = at, (end, k)
            if at == i:
                break
            end = before
    return [k for _, k in held if k >= 0]


def least_cost_assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """The same for a grid of costs, where NaN marks what can't be paired: pairs (row, column)."""
    i, j = np.nonzero(~np.isnan(cost))
    taken = least_cost_edges(i, j, cost[i, j])
    return list(zip(i[taken].tolist(), j[taken].tolist(), strict=True))


def _codes(column: pa.Array) -> np.ndarray:
    encoded = pc.dictionary_encode(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)
    encoded = encoded.combine_chunks() if isinstance(encoded, pa.ChunkedArray) else encoded
    return pc.fill_null(encoded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)


def match_images(rows: pa.Table, epsilon: float, keep: Sequence[str] = ()) -> pa.Table:
    """Of whole images, sorted by image, current and previous box: a row a current box, with its columns `keep`."""
    image, t, p = _codes(rows["image_id"]), _codes(rows["box_id_t"]), _codes(rows["box_id_prev"])
    cost = rows["cost"].to_numpy()
    n = len(t)
    row = np.cumsum(np.r_[True, (image[1:] != image[:-1]) | (t[1:] != t[:-1])]) - 1
    real = p >= 0
    _, col = np.unique(image * (p.max(initial=0) + 2) + p + 1, return_inverse=True)
    degree_t, degree_p = np.bincount(row, real), np.bincount(col, real)
    taken = real & (degree_t[row] == 1) & (degree_p[col] == 1)
    hard = real & ~taken
    at = np.flatnonzero(hard)
    taken[at[least_cost_edges(row[at], col[at], cost[at])]] = True
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    order = np.lexsort((cost, row))
    second = np.where(degree_t > 1, first + 1, first)
    gap = cost[order][second] - cost[order][first]
    gap = np.where(degree_t > 1, gap, np.nan)
    chosen = first.copy()
    chosen[row[taken]] = np.flatnonzero(taken)
    has = np.zeros(len(first), bool)
    has[row[taken]] = True
    unclear = has & (degree_t > 1) & (gap < epsilon)
    status = np.where(unclear, "ambiguous", np.where(has, "matched", "unmatched"))
    out = rows.take(pa.array(chosen)) if n else rows
    lost = pa.array(status != "matched")
    null = lambda name: pc.if_else(lost, pa.scalar(None, out[name].type), out[name])
    return pa.table(
        {
            "image_id": out["image_id"],
            "box_id_t": out["box_id_t"],
            "box_id_prev": null("box_id_prev"),
            "status": pa.array(status.tolist(), pa.string()),
            "iou": null("iou"),
            "js": null("js"),
            "pred_class_t": out["pred_class_t"],
            "pred_class_prev": null("pred_class_prev"),
            "confidence": out["confidence"],
            "candidates": pa.array(degree_t.astype(np.int32)),
            "cost_gap": pa.array(gap, mask=np.isnan(gap)),
            **{c: out[c] for c in keep},
        }
    )


def _with_costs(rows: pa.Table, weight: float) -> pa.Table:
    """Rows of gated pairs with their divergence and cost, null without a previous box."""
    paired = rows["box_id_prev"].is_valid().to_numpy()
    js = np.full(rows.num_rows, np.nan)
    at = pa.array(np.flatnonzero(paired))
    js[paired] = js_of_scores(*(rows[c].combine_chunks().take(at) for c in ("p_t", "p_prev")))
    cost = 1 - rows["iou"].to_numpy() + weight * js
    rows = rows.drop_columns(["p_t", "p_prev"])
    return rows.append_column("js", pa.array(js, mask=~paired)).append_column("cost", pa.array(cost, mask=~paired))


def match(current: DataFrame, previous: DataFrame, config: MatchingConfig = MatchingConfig(), keep: Sequence[str] = ()) -> DataFrame:
    """Every current box once, as matched, ambiguous or unmatched (MATCHES), with the columns `keep` of `current`.

    Within an image as many gated pairs as possible are assigned one to one, at least total cost;
    ties between equal totals go by box ids. An assigned box is ambiguous if its two
    best candidates' costs differ by less than epsilon_match; the previous box is then left
    unmatched. Pairs whose two boxes have no other candidate are settled without the solver. The divergence of
    gated pairs is computed beside the assignment, an Arrow batch at a time.
    """
    scores = F.col("class_scores").cast("array<double>")
    pairs = _gated_pairs(_side(current, "t", scores, keep), _side(previous, "prev", scores), config, "left")
    own = ["box_id_t", "box_id_prev", "iou", "p_t", "p_prev", "pred_class_t", "pred_class_prev", "confidence"]
    kept = [f"_kept_{c}" for c in keep]
    edges = pairs.select(F.col("t.image_id").alias("image_id"), *own, *kept)
    # a place in the image asks for whole images in order, for which the join's own exchange will do where it has one
    place = F.row_number().over(Window.partitionBy("image_id").orderBy("box_id_t", "box_id_prev"))
    sorted_edges = edges.withColumn("_place", place)
    epsilon, weight = config.epsilon_match, config.lambda_cls

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for images in whole_groups(batches, "image_id"):
            yield from match_images(_with_costs(images, weight), epsilon, kept).to_batches()

    schema = ", ".join([MATCHES, *[f"{k} {current.schema[c].dataType.simpleString()}" for c, k in zip(keep, kept, strict=True)]])
    return sorted_edges.mapInArrow(assign, schema).withColumnsRenamed(dict(zip(kept, keep, strict=True)))


def nested_matches(matches: DataFrame, images: DataFrame) -> DataFrame:
    """One row an image, images without boxes too: matched_pairs, unmatched_current, ambiguous."""
    ids = lambda status: F.array_sort(F.collect_list(F.when(F.col("status") == status, F.col("box_id_t"))))
    pairs = F.array_sort(F.collect_list(F.when(F.col("status") == "matched", F.struct(F.col("box_id_t").alias("t"), F.col("box_id_prev").alias("prev")))))
    nested = matches.groupBy("image_id").agg(pairs.alias("matched_pairs"), ids("unmatched").alias("unmatched_current"), ids("ambiguous").alias("ambiguous"))
    empty = F.array().cast("array<string>")
    return images.select("image_id").distinct().join(nested, "image_id", "left").select(
        "image_id",
        F.coalesce("matched_pairs", F.array().cast("array<struct<t:string,prev:string>>")).alias("matched_pairs"),
        F.coalesce("unmatched_current", empty).alias("unmatched_current"),
        F.coalesce("ambiguous", empty).alias("ambiguous"),
    )
