"""What surrounds a detector: score vectors, anchors, batches, rows of a pool."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import chain
from math import lcm

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import argmax, softmax, total
from ..functions.geometry import centre_to_corners, letterbox
from ..functions.names import box_id
from ..schema import BOX
from ..session import checkpoint
from ..sources.archives import Reader
from ..sources.files import default_root
from .ordering import batches, numbered_by, whole_groups

Detector = Callable[[pd.DataFrame], "pd.DataFrame | list[pd.DataFrame] | dict[str, Sequence]"]
CORNERS = ("x1", "y1", "x2", "y2")
Decode = Callable[[bytes], np.ndarray | None]


def anchor_boxes(anchors: DataFrame) -> DataFrame:
    """anchors (image_id, anchor_id, cx, cy, w, h, logits) with corners and class distribution."""
    return anchors.select(
        "image_id", "anchor_id", centre_to_corners(F.col("cx"), F.col("cy"), F.col("w"), F.col("h")).alias("anchor_box"), softmax(F.col("logits")).alias("class_scores")
    )


def nearest_anchors(kept: DataFrame, anchors: DataFrame, size: int = 640) -> DataFrame:
    """For each kept box (image_id, det_index, box, width, height) its nearest anchor of the image and that one's scores.

    Distances are taken over the four corners in the letterboxed image; of equally near
    anchors the first counts. Boxes and anchors are dealt out once by image, without scores, and a grid
    over the upper left corners bounds what can be nearest, so pairs of an image are not joined; a task
    holds an image's corners. Scores are joined after the choice. A box with a corner that is null or not finite, or in an image
    whose anchors all have one, gets the image's first anchor at a null distance; images without anchors have
    no row. det_index and anchor_id are whole numbers.
    """
    boxes = kept.select("image_id", F.lit(True).alias("is_box"), F.col("det_index").cast("long").alias("place"), letterbox(F.col("box"), F.col("width"), F.col("height"), F.lit(float(size))).alias("b"))
    points = anchors.select("image_id", F.lit(False).alias("is_box"), F.col("anchor_id").cast("long").alias("place"), F.col("anchor_box").alias("b"))
    rows = boxes.unionByName(points).where(F.col("image_id").isNotNull()).select("image_id", "is_box", "place", *[F.col(f"b.{c}").cast("double").alias(c) for c in CORNERS])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for images in whole_groups(batches, "image_id"):
            yield from _nearest_of_images(images).to_batches()

    kinds = dict(kept.select("image_id", "det_index").dtypes) | dict(anchors.select("anchor_id").dtypes)
    best = rows.repartition("image_id").sortWithinPartitions("image_id").mapInArrow(choose, f"image_id {kinds['image_id']}, det_index long, anchor_id long, distance double")
    best = best.select("image_id", F.col("det_index").cast(kinds["det_index"]).alias("det_index"), F.col("anchor_id").cast(kinds["anchor_id"]).alias("anchor_id"), "distance")
    return best.join(anchors.select("image_id", "anchor_id", "class_scores"), ["image_id", "anchor_id"])


def _nearest_of_images(rows: pa.Table) -> pa.Table:
    """Of whole images (image_id, is_box, place, corners): a row a box with its nearest anchor."""
    ids = pc.dictionary_encode(rows["image_id"].combine_chunks())
    image, place = ids.indices.to_numpy().astype(np.int64), rows["place"].to_numpy()
    is_box = rows["is_box"].to_numpy()
    corners = np.stack([pc.fill_null(rows[c], np.nan).to_numpy() for c in CORNERS], axis=1)
    finite = np.isfinite(corners).all(1)
    box, anchor = np.flatnonzero(is_box), np.flatnonzero(~is_box)
    anchor = anchor[np.lexsort((place[anchor], image[anchor]))]
    first = np.full(len(ids.dictionary), -1, np.int64)
    first[image[anchor][::-1]] = anchor[::-1]
    chosen, distance = first[image[box]], np.full(len(box), np.nan)
    asked, given = np.flatnonzero(finite[box]), anchor[finite[anchor]]
    near, d2, _ = nearest_in_grid(image[box][asked], corners[box][asked], image[given], corners[given])
    hit = near >= 0
    chosen[asked[hit]], distance[asked[hit]] = given[near[hit]], np.sqrt(d2[hit])
    some = chosen >= 0
    box, chosen, distance = box[some], chosen[some], distance[some]
    return pa.table({"image_id": rows["image_id"].take(pa.array(box)), "det_index": pa.array(place[box]), "anchor_id": pa.array(place[chosen]), "distance": pa.array(distance, mask=np.isnan(distance))})


def nearest_in_grid(group: np.ndarray, boxes: np.ndarray, of_group: np.ndarray, anchors: np.ndarray, at_once: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row of `boxes` (n, 4) the place of the nearest of `anchors` (m, 4) in its group, the squared distance, and the pairs touched.

    Groups are numbers; -1 and infinity where a group has no anchor; of equally near anchors the first.
    Anchors lie in cells by their first two coordinates, some one a cell. A box looks at a window of cells round
    its own and is done once nothing beyond can be as near, or the window holds its whole group;
    else the window's radius doubles. Rows of cells lie together, so a window is one range a row. At most `at_once`
    pairs, or one box's, are held.
    """
    n, m = len(boxes), len(anchors)
    near, best, touched = np.full(n, -1, np.int64), np.full(n, np.inf), 0
    if not n or not m:
        return near, best, touched
    groups = int(max(group.max(), of_group.max())) + 1
    count = np.bincount(of_group, minlength=groups)
    low, high = np.full((groups, 2), np.inf), np.full((groups, 2), -np.inf)
    np.minimum.at(low, of_group, anchors[:, :2])
    np.maximum.at(high, of_group, anchors[:, :2])
    low, high = np.where(count[:, None] > 0, low, 0.0), np.where(count[:, None] > 0, high, 0.0)
    side = (high - low).max(1) / np.ceil(np.sqrt(np.maximum(count, 1)))
    side = np.where(side > 0, side, 1.0)
    last = ((high - low) / side[:, None]).astype(np.int64)
    wide = int(np.ceil(np.sqrt(count.max()))) + 2
    cell = np.minimum(((anchors[:, :2] - low[of_group]) / side[of_group, None]).astype(np.int64), wide - 1)
    key = (of_group * wide + cell[:, 1]) * wide + cell[:, 0]
    order = np.argsort(key, kind="stable")
    key = key[order]
    own = np.clip(np.floor((boxes[:, :2] - low[group]) / side[group, None]), -1, wide).astype(np.int64)
    left, radius = np.flatnonzero(count[group] > 0), 0
    while len(left):
        c, g = own[left], group[left]
        rows_from, rows_to = np.clip(c[:, 1] - radius, 0, wide), np.clip(c[:, 1] + radius + 1, 0, wide)
        per = np.maximum(rows_to - rows_from, 0)
        of = np.repeat(np.arange(len(left)), per)
        y = rows_from[of] + _counted(per)
        base = (g[of] * wide + y) * wide
        lo = np.searchsorted(key, base + np.clip(c[of, 0] - radius, 0, wide))
        hi = np.searchsorted(key, base + np.clip(c[of, 0] + radius + 1, 0, wide))
        width = np.maximum(hi - lo, 0)
        pairs = np.bincount(of, width, minlength=len(left)).astype(np.int64)
        touched += int(pairs.sum())
        ends = np.cumsum(pairs)
        start = 0
        while start < len(left):
            stop = max(int(np.searchsorted(ends, (ends[start - 1] if start else 0) + at_once, side="right")), start + 1)
            segment = slice(*np.searchsorted(of, [start, stop]))
            w = width[segment]
            b = left[np.repeat(of[segment], w)]
            a = order[np.repeat(lo[segment], w) + _counted(w)]
            d2 = ((boxes[b] - anchors[a]) ** 2).sum(1)
            ranked = np.lexsort((a, d2, b))
            head = ranked[np.flatnonzero(np.r_[True, np.diff(b[ranked]) != 0])] if len(b) else ranked
            near[b[head]], best[b[head]] = a[head], d2[head]
            start = stop
        edge = low[g] + (c - radius) * side[g, None]
        below = np.where(c - radius > 0, boxes[left, :2] - edge, np.inf)
        above = np.where(c + radius < last[g], edge + (2 * radius + 1) * side[g, None] - boxes[left, :2], np.inf)
        margin = np.maximum(np.minimum(below, above).min(1), 0)
        done = (best[left] < (margin * (1 - 1e-9)) ** 2) | (pairs == count[g])
        left, radius = left[~done], max(1, 2 * radius)
    return near, best, touched


def _counted(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each size in turn."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def nearest_vectors(queries: DataFrame, vectors: DataFrame, key: str = "vec_id", value: str = "embedding", queries_at_once: int = 4096) -> DataFrame:
    """(query, nearest, distance) over all `vectors` but the query itself; ties by key.

    The queries are a stated set: they go to the tasks in blocks of bounded size, each block in
    a pass of matrix products over the vectors; only each task's best reaches the shuffle.
    """
    def block(rows: list) -> DataFrame:
        ids = np.array([r[0] for r in rows], np.int64)
        q = np.array([r[1] for r in rows], float).reshape(len(rows), -1)
        shared = vectors.sparkSession.sparkContext.broadcast((ids, q))

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            near, far = np.full(len(ids), -1, np.int64), np.full(len(ids), np.inf)
            for b in parts:
                v, own = np.array(b.column(1).to_pylist(), float), b.column(0).to_numpy()
                for at in range(0, len(own), 1024):
                    d = ((q[:, None, :] - v[None, at : at + 1024]) ** 2).sum(2) if q.shape[0] * q.shape[1] < 1 << 16 else (q**2).sum(1)[:, None] + (v[at : at + 1024] ** 2).sum(1) - 2 * q @ v[at : at + 1024].T
                    d = np.where(ids[:, None] == own[at : at + 1024], np.inf, d)
                    order = np.lexsort((np.broadcast_to(own[at : at + 1024], d.shape), d), axis=1)[:, 0]
                    best, k = d[np.arange(len(ids)), order], own[at : at + 1024][order]
                    closer = (best < far) | ((best == far) & (k < near))
                    near, far = np.where(closer, k, near), np.where(closer, best, far)
            hit = np.isfinite(far)
            yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(near[hit]), pa.array(np.sqrt(np.maximum(far[hit], 0)))], ["query", "nearest", "distance"])

        found = vectors.select(key, value).mapInArrow(run, "query long, nearest long, distance double")
        return found.groupBy("query").agg(F.min(F.struct("distance", "nearest")).alias("m")).select("query", "m.nearest", "m.distance")

    held, parts = [], []
    for row in queries.select(key, value).toLocalIterator():
        held.append(row)
        if len(held) == queries_at_once:
            parts.append(block(held))
            held = []
    if held or not parts:
        parts.append(block(held))
    return reduce(DataFrame.unionByName, parts)


def with_det_index(boxes: DataFrame, *order: str) -> DataFrame:
    """det_index: the place of a box within its image, from 0."""
    return boxes.withColumn("det_index", F.row_number().over(Window.partitionBy("image_id").orderBy(*order)) - 1)


def score_report(detections: DataFrame, near_one: float = 1e-4, near_max: float = 1e-5) -> DataFrame:
    """One row: how many boxes there are and how many break each rule of the score vectors."""
    s = F.col("class_scores")
    return detections.agg(
        F.count("*").alias("n"),
        F.count_if(argmax(s) != F.col("pred_class")).alias("argmax_differs"),
        F.count_if(F.abs(total(s) - 1) > near_one).alias("sum_not_one"),
        F.count_if(F.abs(F.array_max(s) - F.col("confidence")) > near_max).alias("max_not_confidence"),
    )


def _found(detector: Detector, rows: pd.DataFrame) -> pd.DataFrame | dict[str, Sequence]:
    """What the detector finds in a batch; ValueError if it has not one result an image, or boxes of images that aren't in it."""
    out = detector(rows)
    if isinstance(out, list):
        if len(out) != len(rows):
            raise ValueError(f"the detector gave {len(out)} results for {len(rows)} images, from {rows.image_id.iloc[0]} on")
        out = pd.concat([x.assign(image_id=i) for x, i in zip(out, rows.image_id, strict=True)], ignore_index=True)
    if strange := sorted(set(out["image_id"]) - set(rows.image_id)):
        raise ValueError(f"the detector gave boxes of {strange[0]}, which is not in its batch")
    return out


RESULT = ("image_id", "det_index", "x1", "y1", "x2", "y2", "pred_class", "class_scores", "confidence")


def _boxed(found: list[pd.DataFrame | dict[str, Sequence]]) -> pd.DataFrame:
    """Rows of FOUND, of what the detector found in some batches."""
    if all(isinstance(x, dict) for x in found):
        out = pd.DataFrame({c: list(chain.from_iterable(x[c] for x in found)) for c in RESULT})
    else:
        out = pd.concat([pd.DataFrame(x) for x in found], ignore_index=True)
    sides = out[["x1", "y1", "x2", "y2"]].astype(float)
    return out.assign(box=sides.to_dict("records"))[["image_id", "det_index", "box", "pred_class", "class_scores", "confidence"]]


FOUND = f"image_id string, det_index int, box {BOX.simpleString()}, pred_class int, class_scores array<double>, confidence double"


def _pool(found: DataFrame, round_id: int) -> DataFrame:
    return found.select("image_id", box_id(F.col("image_id"), F.lit(round_id), F.col("det_index")).alias("box_id"), F.lit(round_id).alias("round_id"), "box", "pred_class", "class_scores", "confidence", "det_index")


def detect(images: DataFrame, detector: Detector, round_id: int, batch: int = 8) -> DataFrame:
    """Runs an injected detector over `images` (image_id, ...) in batches whose make-up depends on the ids only.

    detector(batch) returns image_id, det_index, x1, y1, x2, y2, pred_class, class_scores, confidence, as a frame or a dict of equally long columns, or a
    list of one such frame an image; ValueError if these are more or fewer. Images without boxes have no
    rows here; keep `images` beside the pool. Of rows with the same id any one counts, as
    relations have no order. Ids alone are numbered; then the rows are dealt out by batch. Where they hold pixels
    and lie in files, `detect_files` moves none of them.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return _boxed([_found(detector, rows.drop_duplicates("image_id").sort_values("place").reset_index(drop=True))])

    placed = batches(images.select("image_id").distinct(), batch)
    return _pool(images.join(placed, "image_id").groupBy("batch_id").applyInPandas(run, FOUND), round_id)


def detect_files(paths: DataFrame, decode: Decode, detector: Detector, round_id: int, batch: int = 8, run: int = 200, most_tasks: int = 1 << 15) -> DataFrame:
    """`detect` over image files (image_id, path), archived ones too: read, decoded and given to the detector in one task, batch by batch.

    Only ids and paths are shuffled: they are numbered in the order of the ids, and runs of `run` images go to
    a task each, or several to one beyond `most_tasks`. A task holds the pixels of one batch, or of several while they are small (4 MB), and the boxes of some.
    The batch's frame has image_id, path, width, height, pixels (an array as `decode` gives it) and
    place. Of several paths of an id the first counts. ValueError names an image that can't be read.
    """
    return _pool(_detected_files(paths, decode, detector, [batch], run, most_tasks), round_id)


def _detected_files(paths: DataFrame, decode: Decode, detector: Detector, sizes: Sequence[int], run: int, most_tasks: int = 1 << 15) -> DataFrame:
    """FOUND and `of`, the place in `sizes`: what the detector finds in batches of each of these sizes, of images that are read and decoded once."""
    spark, whole = paths.sparkSession, lcm(*sizes)
    each = paths.groupBy("image_id").agg(F.min("path").alias("path"))
    placed = numbered_by(each, "image_id")
    n = max(1, -(-placed.count() // run))
    in_run = F.expr(f"position div {whole * max(1, run // whole)}")
    dealt = placed.repartitionByRange(min(n, most_tasks), in_run).sortWithinPartitions("position")
    root = default_root(spark)

    def opened(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Images with their pixels; batches of all sizes end where one of these frames does."""
        reader, rows, held = Reader(root), [], 0
        for part in parts:
            for image, path, position in zip(part.image_id.tolist(), part.path.tolist(), part.position.tolist(), strict=True):
                if rows and position // whole != rows[-1][2] // whole and (held >= 1 << 22 or len(rows) >= 4096):
                    yield framed(rows)
                    rows, held = [], 0
                try:
                    pixels = decode(reader.read(path))
                except Exception as e:
                    raise ValueError(f"unreadable image {path}") from e
                if pixels is None:
                    raise ValueError(f"unreadable image {path}")
                rows.append((image, path, position, pixels))
                held += pixels.nbytes
        if rows:
            yield framed(rows)

    def framed(rows: list[tuple]) -> pd.DataFrame:
        ids, paths, positions, pixels = zip(*rows, strict=True)
        shapes = [x.shape for x in pixels]
        return pd.DataFrame({"image_id": ids, "path": paths, "position": positions, "width": [x[1] for x in shapes], "height": [x[0] for x in shapes], "pixels": pd.Series(pixels, dtype=object)})

    def detected(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for images in opened(parts):
            position = images.pop("position").to_numpy()
            for of, size in enumerate(sizes):
                rows, found, n = images.assign(batch_id=position // size, place=position % size), [], 0
                edge = np.flatnonzero(np.diff(position // size, prepend=-1, append=-1)).tolist()
                for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                    batch = rows.iloc[lo:hi]
                    batch.index = pd.RangeIndex(hi - lo)
                    found.append(_found(detector, batch))
                    n += len(found[-1]["image_id"])
                    if n >= 4096 or len(found) >= 512 or hi == len(rows):
                        if n:
                            yield _boxed(found).assign(of=of)
                        found, n = [], 0

    return dealt.select("image_id", "path", "position").mapInPandas(detected, f"{FOUND}, of int")


def _digest() -> list[F.Column]:
    """Aggregates n_boxes and _sum, the sum of a hash of each row, whose numbers count to eight decimals."""
    r = lambda x: F.round(x, 8) + 0.0
    row = F.xxhash64("image_id", "det_index", *[r(F.col(f"box.{c}")) for c in ("x1", "y1", "x2", "y2")], "pred_class", F.transform("class_scores", r), r(F.col("confidence")))
    return [F.count("*").alias("n_boxes"), F.sum(row.cast("decimal(38,0)")).alias("_sum")]


DIGEST = "cast(pmod(coalesce(_sum, 0), 18446744073709551616) as string)"


def run_digest(pool: DataFrame) -> DataFrame:
    """One row: n_boxes and a digest of a pool that is the same in whatever order and partitions its rows come.

    The sum, modulo 2^64, of a hash of each row, whose numbers count to eight decimals.
    """
    return pool.agg(*_digest()).select("n_boxes", F.expr(DIGEST).alias("digest"))


def _like_the_first(every: DataFrame) -> DataFrame:
    first = every.where("_k = 0").select(F.struct("n_boxes", "digest").alias("_first"))
    return every.join(F.broadcast(first)).select("run", "n_boxes", "digest", (F.struct("n_boxes", "digest") == F.col("_first")).alias("same"))


def compared_runs(runs: dict[str, DataFrame]) -> DataFrame:
    """run, n_boxes, digest, same: whether a run found what the first one found. Two of one kind tell of determinism, two batch sizes of independence of the batch."""
    parts = [run_digest(pool).select(F.lit(name).alias("run"), F.lit(k).alias("_k"), "n_boxes", "digest") for k, (name, pool) in enumerate(runs.items())]
    return _like_the_first(reduce(DataFrame.unionByName, parts))


def compared_files(paths: DataFrame, decode: Decode, detector: Detector, sizes: dict[str, int], run: int = 200) -> DataFrame:
    """`compared_runs` of a detector over image files, by name and batch size: it runs anew for each of them, while files are numbered, read and decoded once."""
    found = _detected_files(paths, decode, detector, list(sizes.values()), run).groupBy(F.col("of").alias("_k")).agg(*_digest())
    names = paths.sparkSession.createDataFrame(list(enumerate(sizes)), "_k int, run string")
    every = names.join(F.broadcast(found), "_k", "left").withColumns({"n_boxes": F.coalesce("n_boxes", F.lit(0)), "digest": F.expr(DIGEST)})
    return _like_the_first(checkpoint(every.select("run", "_k", "n_boxes", "digest")))


def nested_pool(images: DataFrame, detections: DataFrame) -> DataFrame:
    """A row an image with its boxes, empty for images without one."""
    fields = [c for c in detections.columns if c != "image_id"]
    boxes = detections.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("box_id", *[c for c in fields if c != "box_id"]))).alias("boxes"))
    kind = boxes.schema["boxes"].dataType.simpleString()
    return images.select("image_id").distinct().join(boxes, "image_id", "left").withColumn("boxes", F.coalesce("boxes", F.array().cast(kind)))


def flat_pool(nested: DataFrame) -> DataFrame:
    return nested.select("image_id", F.explode("boxes").alias("b")).select("image_id", "b.*")
