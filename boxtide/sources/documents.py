"""JSON documents and label text as relations."""

from __future__ import annotations

import json
import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import file_name, stem, suffix
from ..schema import ANNOTATION_DOCUMENT, EVAL_RESULT
from .archives import archived_contents, archived_files
from .ranges import array_runs

IMAGE_SUFFIXES = [".jpg", ".jpeg", ".png"]
# The fields that a split document has at least.
SPLIT_FIELDS = ["ratio", "fold", "seed", "n_labeled", "n_unlabeled", "labeled_ids", "unlabeled_ids", "val_ids", "created_at"]


def annotation_document(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, annotations with position, categories) of annotation documents."""
    doc = spark.read.schema(ANNOTATION_DOCUMENT).json(path, multiLine=True, mode="FAILFAST")
    images = doc.select(F.explode("images").alias("x")).select("x.*")
    annotations = doc.select(F.posexplode("annotations").alias("position", "x")).select("position", "x.*")
    categories = doc.select(F.explode("categories").alias("x")).select("x.*")
    return images, annotations, categories


def annotation_ranges(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """`annotation_document` for large documents: each is read in byte ranges, by as many tasks. `array_runs` tells how.

    Objects that follow each other are parsed together. A text that isn't as the schema has it is an error.
    """
    fields = {f.name: f.dataType.elementType for f in ANNOTATION_DOCUMENT.fields}
    runs = array_runs(spark, path)

    def of(key: str) -> DataFrame:
        text = F.concat(F.lit("["), F.array_join("json", ","), F.lit("]"))
        each = runs.where(F.col("key") == key).select("position", F.posexplode(F.from_json(text, T.ArrayType(fields[key]), {"mode": "FAILFAST"})).alias("k", "x"))
        return each.select((F.col("position") + F.col("k")).cast("int").alias("position"), "x")

    return of("images").select("x.*"), of("annotations").select("position", "x.*"), of("categories").select("x.*")


def image_ids(images: DataFrame) -> DataFrame:
    return images.select("id").orderBy("id")


def split_document(spark: SparkSession, text: str, required: list[str] = SPLIT_FIELDS) -> tuple[dict, DataFrame]:
    """(header, ids with their part) of a split document; ValueError names a missing field."""
    doc = json.loads(text)
    for name in required:
        if name not in doc:
            raise ValueError(f"split document has no field {name!r}")
    parts = {k.removesuffix("_ids"): v for k, v in doc.items() if k.endswith("_ids")}
    rows = [(int(i), part) for part, ids in parts.items() for i in ids]
    header = {k: v for k, v in doc.items() if not k.endswith("_ids")}
    return header, spark.createDataFrame(rows, "id long, part string")


def split_files(spark: SparkSession, path: str, required: list[str] = SPLIT_FIELDS) -> tuple[DataFrame, DataFrame]:
    """(headers, ids) of the split documents in a folder: name, ratio, fold, seed, numbers, created_at; and name, id, part.

    They are parsed by tasks, a document by one. ValueError names a file and the first field that it lacks.
    """
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.json").select(file_name(F.col("_metadata.file_path")).alias("name"), "value")
    lacking = files.select("name", F.array_except(F.array(*[F.lit(f) for f in required]), F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>"))).alias("x"))
    if first := lacking.where(F.size("x") > 0).orderBy("name").first():
        raise ValueError(f"split document {first.name} has no field {first.x[0]!r}")
    parts = F.from_json("value", "map<string,string>")
    header = F.from_json("value", "ratio double, fold int, seed long, n_labeled int, n_unlabeled int, created_at string")
    named = F.explode(F.map_filter(parts, lambda k, _: F.endswith(k, F.lit("_ids")))).alias("key", "ids")
    ids = files.select("name", named).select("name", F.regexp_replace("key", "_ids$", "").alias("part"), F.explode(F.from_json("ids", "array<bigint>")).alias("id"))
    return files.select("name", header.alias("h")).select("name", "h.*"), ids.select("name", "id", "part")


def is_filtered_split(header: dict) -> bool:
    return "class_names" in header and "image_dir_train" in header


def label_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line of every line of the text files that isn't blank."""
    lines = spark.read.text(path, pathGlobFilter="*.txt", recursiveFileLookup=True)
    return lines.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line")).where(F.length(F.trim(F.regexp_replace("line", r"\s+", " "))) > 0)


def archived_label_lines(spark: SparkSession, path: str) -> DataFrame:
    """`label_lines` of the text files in a folder's archives."""
    files = archived_contents(spark, path, [".txt"])
    lines = files.select("path", F.explode(F.split(F.col("content").cast("string"), "\r\n|\r|\n")).alias("line"))
    return lines.where(F.length(F.trim(F.regexp_replace("line", r"\s+", " "))) > 0)


def label_boxes(lines: DataFrame) -> DataFrame:
    """stem, class_id, cx, cy, w, h of label lines; null where a token isn't a number."""
    t = F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " ")
    n = [F.get(t, F.lit(k)).try_cast("double").alias(c) for k, c in enumerate(("cx", "cy", "w", "h"), 1)]
    return lines.select(stem(F.col("path")).alias("stem"), F.get(t, F.lit(0)).try_cast("int").alias("class_id"), *n)


def image_files(spark: SparkSession, path: str, suffixes: list[str] = IMAGE_SUFFIXES) -> DataFrame:
    """path, length, stem of image files, by suffix in any case; their content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return files.where(suffix(F.col("path")).isin(*suffixes)).withColumn("stem", stem(F.col("path")))


def archived_images(spark: SparkSession, path: str, suffixes: list[str] = IMAGE_SUFFIXES) -> DataFrame:
    """`image_files` of a folder's archives."""
    return archived_files(spark, path, suffixes).withColumn("stem", stem(F.col("path")))


def decoded_images(spark: SparkSession, path: str, decode: Callable[[bytes], np.ndarray | None], suffixes: list[str] = IMAGE_SUFFIXES, at_once: int = 1 << 26) -> DataFrame:
    """image_id, path, width, height, pixels of the image files below `path`, decoded where they are read.

    decode gives an array of rows, columns and colours, or None or an error for what it can't read;
    the first such file of a task ends the job with a ValueError that names it. Results are handed on whenever
    they pass `at_once` bytes, so a task holds an Arrow batch of files and that much of pixels.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return decoded(files.where(suffix(F.col("path")).isin(*suffixes)), decode, at_once)


def decoded(files: DataFrame, decode: Callable[[bytes], np.ndarray | None], at_once: int = 1 << 26) -> DataFrame:
    """`decoded_images` of rows (path, content), such as those of `archived_contents`."""
    files = files.select(stem(F.col("path")).alias("image_id"), "path", "content")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["image_id", "path", "width", "height", "pixels"]
        for part in parts:
            rows, held = [], 0
            for f in part.itertuples(index=False):
                try:
                    image = decode(f.content)
                except Exception as e:
                    raise ValueError(f"unreadable image {f.path}") from e
                if image is None:
                    raise ValueError(f"unreadable image {f.path}")
                rows.append((f.image_id, f.path, image.shape[1], image.shape[0], image.tobytes()))
                held += image.nbytes
                if held >= at_once:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    return files.mapInPandas(run, "image_id string, path string, width int, height int, pixels binary")


def eval_results(spark: SparkSession, path: str) -> DataFrame:
    """method (file stem), position and the results of JSON files, each a list or one object.

    Files that are no such JSON have no rows; a warning says how many they are and names the first.
    """
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.json")
    text = F.when(F.startswith(F.ltrim(F.regexp_replace("value", r"^\s+", "")), F.lit("[")), F.col("value")).otherwise(F.concat(F.lit("["), "value", F.lit("]")))
    rows = files.select(stem(F.col("_metadata.file_path")).alias("method"), F.from_json(text, "array<" + EVAL_RESULT.simpleString() + ">").alias("rows"))
    broken = rows.where(F.col("rows").isNull() | F.exists("rows", lambda x: x.isNull())).select("method").orderBy("method").limit(5)
    if names := [r[0] for r in broken.collect()]:
        warnings.warn(f"result files that cannot be read: {', '.join(names)}", stacklevel=2)
    return rows.select("method", F.posexplode("rows").alias("position", "x")).select("method", "position", "x.*")


def write_eval_results(results: DataFrame, path: str) -> None:
    results.coalesce(1).write.mode("overwrite").json(path)


def require_paths(wanted: DataFrame, listing: DataFrame) -> None:
    """FileNotFoundError names the first five of the wanted paths that the listing lacks."""
    lacking = wanted.select("path").join(listing.select("path"), "path", "left_anti")
    if first := [r[0] for r in lacking.orderBy("path").limit(5).collect()]:
        raise FileNotFoundError(f"{lacking.count()} paths are missing, such as {', '.join(first)}")
