"""The three image transforms on pixels, as arrays of bytes (height, width, 3)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import BRIGHTNESS, REMAPS, SCALE_FACTOR, SHIFT, remap


#: Bytes of pixels that are transformed together, or one image of more.
AT_ONCE = 1 << 17


def _bilinear(img: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The image at real places; black beyond its border."""
    *many, h, w, c = img.shape
    padded = np.zeros((*many, h + 2, w + 2, c))
    padded[..., 1:-1, 1:-1, :] = img
    y, x = np.clip(y, -1, h) + 1, np.clip(x, -1, w) + 1
    y0, x0 = np.minimum(np.floor(y).astype(int), h), np.minimum(np.floor(x).astype(int), w)
    fy, fx = (y - y0)[:, None, None], (x - x0)[None, :, None]
    at = lambda down, right: padded.take(y0 + down, -3).take(x0 + right, -2)
    a, b = at(0, 0) * (1 - fx) + at(0, 1) * fx, at(1, 0) * (1 - fx) + at(1, 1) * fx
    return np.clip(np.rint(a * (1 - fy) + b * fy), 0, 255).astype(np.uint8)


def transform_pixels(img: np.ndarray, transform: str) -> np.ndarray:
    """The image, or images of one size along further axes in front, scaled about its centre, shifted right and down, or made brighter; of the same size."""
    h, w, _ = img.shape[-3:]
    if transform == "scale":
        return _bilinear(img, h / 2 + (np.arange(h) - h / 2) / SCALE_FACTOR, w / 2 + (np.arange(w) - w / 2) / SCALE_FACTOR)
    if transform == "translate":
        return _bilinear(img, np.arange(h) - SHIFT, np.arange(w) - SHIFT)
    if transform == "brightness":
        return np.clip(img.astype(np.float32) * BRIGHTNESS, 0, 255).astype(np.uint8)
    raise ValueError(f"unknown transform {transform!r}; known: {', '.join(REMAPS)}")


def _transformed(rows: pa.RecordBatch, transform: str) -> pa.RecordBatch:
    """Some images, those of one size together."""
    wide, high, raw = (rows.column(k).to_pylist() for k in (1, 2, 3))
    out: list[bytes | None] = [None] * len(raw)
    sizes: dict[tuple[int, int], list[int]] = {}
    for k, pixels in enumerate(raw):
        if pixels is not None:
            sizes.setdefault((high[k], wide[k]), []).append(k)
    for (h, w), own in sizes.items():
        images = np.stack([np.frombuffer(raw[k], np.uint8).reshape(h, w, 3) for k in own])
        for k, img in zip(own, transform_pixels(images, transform), strict=True):
            out[k] = img.tobytes()
    return pa.RecordBatch.from_arrays([*rows.columns[:3], pa.array(out, pa.binary())], ["image_id", "width", "height", "pixels"])


def transform_images(images: DataFrame, transform: str) -> DataFrame:
    """images (image_id, width, height, pixels BINARY of height * width * 3 bytes) with transformed pixels; null stays null."""
    if transform not in REMAPS:
        raise ValueError(f"unknown transform {transform!r}; known: {', '.join(REMAPS)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            size = pc.fill_null(pc.binary_length(whole.column(3)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            part = (np.cumsum(size) - size) // AT_ONCE
            edge = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else np.zeros(1, int)
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                yield _transformed(whole.slice(lo, hi - lo), transform)

    return images.select("image_id", F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), "pixels").mapInArrow(run, "image_id string, width int, height int, pixels binary")


def transform_boxes(boxes: DataFrame, transform: str) -> DataFrame:
    """boxes (…, box, width, height) with `box` as the same transform moves it."""
    return boxes.withColumn("box", remap(F.col("box"), F.col("width"), F.col("height"), transform))
