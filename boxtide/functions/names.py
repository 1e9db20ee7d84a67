"""Identifiers, file names and seeds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FOLD_STEP, INNER_VAL_STEP = 1000, 500  # fixed values


def image_id(number: Column, digits: int = 12) -> Column:
    """The number with zeros in front up to `digits`; a longer one stays whole."""
    text = number.cast("string")
    return F.when(F.length(text) >= digits, text).otherwise(F.lpad(text, digits, "0"))


def box_id(image: Column, round_id: Column, index: Column, digits: int = 4) -> Column:
    number = index.cast("string")
    padded = F.when(F.length(number) >= digits, number).otherwise(F.lpad(number, digits, "0"))
    return F.concat(image, F.lit("_r"), round_id.cast("string"), F.lit("_"), padded)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"(?<=.)(\.[^.]+)$", 1))


def label_path(image_path: Column) -> Column:
    """Where the labels of an image are expected: /labels/ for /images/, .txt for its suffix."""
    return F.regexp_replace(F.replace(image_path, F.lit("/images/"), F.lit("/labels/")), r"\.(?i:jpg|jpeg|png)$", ".txt")


def fold_seed(base: int, fold: int) -> int:
    return base + FOLD_STEP * fold


def inner_val_seed(base: int, fold: int) -> int:
    return fold_seed(base, fold) + INNER_VAL_STEP


def ratio_name(ratio: float) -> str:
    """0.01 is 1pct; a percentage that isn't whole in binary keeps a decimal, 7p0pct for 0.07."""
    pct = ratio * 100
    return f"{int(pct)}pct" if pct == int(pct) else f"{pct:.1f}pct".replace(".", "p")


def ratio_name_rounded(ratio: float) -> str:
    return f"{round(ratio * 100)}pct"


def checkpoint_hash(content: Column) -> Column:
    """16 hex digits of the SHA-256 of the first MiB."""
    return F.substring(F.sha2(F.substring(content, 1, 1 << 20), 256), 1, 16)
