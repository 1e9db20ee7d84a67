"""Seeded splits of image ids into labelled, inner validation and unlabelled parts."""

from __future__ import annotations

import random
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import fold_seed, inner_val_seed
from ..session import full_uri
from ..sources.files import located
from .ordering import numbered_by


def labelled_count(total: int, ratio: float) -> int:
    return max(1, round(total * ratio))  # half to even


def validation_count(labelled: int, fraction: float) -> int:
    if not 0.0 < fraction < 1.0:
        raise ValueError(f"val_fraction {fraction} does not lie between 0 and 1")
    if labelled < 10:
        raise ValueError(f"only {labelled} labelled ids; at least 10 are needed to split off a validation part")
    n = max(1, round(labelled * fraction))
    if labelled - n < 1:
        raise ValueError(f"no id would be left to train on ({labelled} labelled, val_fraction {fraction})")
    return n


def _first_of_shuffle(ids: list[int], n: int, seed: int) -> tuple[list[int], list[int]]:
    shuffled = sorted(ids)
    random.Random(seed).shuffle(shuffled)
    return sorted(shuffled[:n]), sorted(shuffled[n:])


#: Ids that a shuffle one by one on the driver may have; more need `split`.
MOST_EXACT = 5_000_000


@dataclass(frozen=True)
class Split:
    labelled_train: list[int]
    labelled_inner_val: list[int]
    unlabelled: list[int]
    seed: int
    inner_val_seed: int


def exact_split(ids: list[int], ratio: float, fold: int, base_seed: int, val_fraction: float = 0.10) -> Split:
    """The split that the standard library's generator gives for these seeds; on the driver, since ids are shuffled one by one.

    ValueError beyond MOST_EXACT ids, for which `split` does the same job in Spark.
    """
    if len(ids) > MOST_EXACT:
        raise ValueError(f"{len(ids)} ids; an exact shuffle takes {MOST_EXACT} at most, split() any number")
    labelled, rest = _first_of_shuffle(ids, labelled_count(len(ids), ratio), fold_seed(base_seed, fold))
    val, train = _first_of_shuffle(labelled, validation_count(len(labelled), val_fraction), inner_val_seed(base_seed, fold))
    return Split(train, val, rest, fold_seed(base_seed, fold), inner_val_seed(base_seed, fold))


def split(images: DataFrame, ratio: float, fold: int, base_seed: int, val_fraction: float = 0.10) -> DataFrame:
    """`id`, `part` (labeled_train, labeled_inner_val or unlabeled) of every image id, in Spark.

    Ids are ordered by the md5 of seed and id, so the split depends neither on their number
    of partitions nor on their order. The numbers of ids are those of `exact_split`.
    """
    ids = images.select("id").distinct()
    total = ids.count()
    n = labelled_count(total, ratio)
    n_val = validation_count(n, val_fraction)

    def order(seed: int):
        return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")))

    ranked = numbered_by(ids.withColumn("_h", order(fold_seed(base_seed, fold))), "_h", "id")
    labelled = ranked.where(F.col("position") < n).select("id")
    inner = numbered_by(labelled.withColumn("_h", order(inner_val_seed(base_seed, fold))), "_h", "id")
    part = F.when(F.col("position") < n_val, "labeled_inner_val").otherwise("labeled_train")
    rest = ranked.where(F.col("position") >= n).select("id", F.lit("unlabeled").alias("part"))
    return inner.select("id", part.alias("part")).union(rest)


def split_report(a: DataFrame, b: DataFrame, whole: DataFrame) -> DataFrame:
    """One row: how many ids both parts share, and how many of `whole` and the parts are not in the other."""
    both = a.select("id").intersect(b.select("id")).agg(F.count("*").alias("overlap"))
    union = a.select("id").union(b.select("id")).distinct()
    missing = whole.select("id").distinct().exceptAll(union).agg(F.count("*").alias("missing"))
    extra = union.exceptAll(whole.select("id").distinct()).agg(F.count("*").alias("extra"))
    return both.join(missing).join(extra)


def require_partition(a: DataFrame, b: DataFrame, whole: DataFrame) -> None:
    row = split_report(a, b, whole).first()
    if any(row):
        raise ValueError(f"parts share {row.overlap} ids; {row.missing} ids are in none and {row.extra} are unknown")


def split_grid(ratios: list[float], folds: list[int], base_seed: int) -> list[dict]:
    """A header for each ratio and fold."""
    return [{"ratio": r, "fold": f, "seed": fold_seed(base_seed, f), "inner_val_seed": inner_val_seed(base_seed, f)} for r in ratios for f in folds]


PARTS = ["labeled_train", "labeled_inner_val", "unlabeled"]  # fixed values: parts of a split, as its documents name them


def split_documents(rows: DataFrame, headers: DataFrame, val_ids: DataFrame | None = None) -> DataFrame:
    """name, value: a JSON document for each of `headers` (name, ratio, fold, ...), from `rows` (ratio, fold, id, part).

    A document holds its header, the sorted ids of each part, of both labelled parts together and of
    `val_ids` (id; none where it isn't given), their numbers, and created_at unless the header has one: what
    `documents.split_document` asks for. A split's ids so meet in one task, as they do in one file.
    """
    listed = lambda when: F.array_sort(F.collect_list(F.when(when, F.col("id"))))
    ids = rows.groupBy("ratio", "fold").agg(*[listed(F.col("part") == p).alias(f"{p}_ids") for p in PARTS], listed(F.col("part") != PARTS[-1]).alias("labeled_ids"))
    doc = headers.join(ids, ["ratio", "fold"], "left")
    names = [*PARTS, "labeled", "val"]
    if val_ids is None:
        doc = doc.withColumn("val_ids", F.array().cast("array<bigint>"))
    else:
        doc = doc.join(F.broadcast(val_ids.agg(F.array_sort(F.collect_set("id")).alias("val_ids"))))
    doc = doc.withColumns({f"{p}_ids": F.coalesce(f"{p}_ids", F.array().cast("array<bigint>")) for p in names})
    made = [] if "created_at" in headers.columns else [F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("created_at")]
    whole = F.struct(*[c for c in headers.columns if c != "name"], *[F.size(f"{p}_ids").alias(f"n_{p}") for p in names], *[f"{p}_ids" for p in names], *made)
    return doc.select("name", F.to_json(whole).alias("value"))


def write_split_documents(docs: DataFrame, folder: str) -> DataFrame:
    """Writes each document (name, value) to a file of its name in `folder`; the paths written. A file gets its name when it is whole."""
    whole = full_uri(docs.sparkSession, folder)

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = located(whole, "")
        fs.create_dir(root, recursive=True)
        for part in parts:
            for r in part.itertuples():
                own = f"{root}/.{uuid.uuid4().hex}"
                with fs.open_output_stream(own) as out:
                    out.write(r.value.encode())
                fs.move(own, f"{root}/{r.name}")
            yield pd.DataFrame({"path": root + "/" + part["name"]})

    return docs.select("name", "value").mapInPandas(write, "path string")


def sample_files(files: DataFrame, n: int, seed: int, key: str = "path") -> DataFrame:
    """n rows in the order of the md5 of seed and key: a sample that any number of partitions gives alike."""
    return files.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key))), key).limit(n)


def labelled_data(split_rows: DataFrame, val_ids: DataFrame) -> DataFrame:
    """filename, partition of all three parts, ids as 12 digits with the suffix .jpg, once each."""
    from ..functions.names import image_id

    names = F.concat(image_id(F.col("id")), F.lit(".jpg"))
    own = split_rows.select(names.alias("filename"), F.col("part").alias("partition"))
    return own.union(val_ids.select(names, F.lit("val"))).distinct()
