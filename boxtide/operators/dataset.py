"""Training datasets: which images and label lines go where, checked before anything is written."""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import normalised_from_corners
from ..functions.names import stem, suffix
from ..functions.text import label_line
from ..session import full_uri
from ..sources.archives import write_archives
from ..sources.files import default_root, drop, exists, located, rename, write_text

PIECE = 1 << 14
SUFFIX_ORDER = [".jpg", ".jpeg", ".png"]


def resolved_images(wanted: DataFrame, labelled_dir: DataFrame, unlabelled_dir: DataFrame) -> DataFrame:
    """image_id, path: the file of each image; labelled folder first, then suffixes in order, then the path.

    FileNotFoundError names the first that has none.
    """
    files = labelled_dir.select("path", F.lit(0).alias("d")).unionByName(unlabelled_dir.select("path", F.lit(1).alias("d")))
    known = F.array_position(F.array(*[F.lit(s) for s in SUFFIX_ORDER]), suffix(F.col("path")))
    ranked = files.select(stem(F.col("path")).alias("image_id"), F.struct("d", F.when(known > 0, known).otherwise(99).alias("s"), "path").alias("r"))
    out = wanted.select("image_id").distinct().join(ranked.groupBy("image_id").agg(F.min("r").alias("r")), "image_id", "left")
    lacking = out.where("r is null").agg(F.min("image_id")).first()[0]
    if lacking is not None:
        raise FileNotFoundError(f"no image file for {lacking}")
    return out.select("image_id", F.col("r.path").alias("path"))


def require_disjoint(a: DataFrame, b: DataFrame, what: str, column: str = "stem") -> None:
    """ValueError names the first value that both hold."""
    shared = a.select(column).intersect(b.select(column)).agg(F.min(column)).first()[0]
    if shared is not None:
        raise ValueError(f"{what}: {shared}")


def validate(train: DataFrame, inner_val: DataFrame, labelled_files: DataFrame, unlabelled_files: DataFrame, pseudo: DataFrame, same_folder: bool, unlabelled: DataFrame | None = None) -> None:
    """The checks that come before any file is touched; all relations have `stem`.

    Within one folder the lists must be disjoint; of two folders the files must be.
    """
    require_disjoint(inner_val, train, "in inner validation and training")
    if unlabelled is not None:
        require_disjoint(inner_val, unlabelled, "in inner validation and unlabelled")
    if same_folder:
        if unlabelled is not None:
            require_disjoint(train, unlabelled, "labelled and unlabelled")
    else:
        require_disjoint(labelled_files, unlabelled_files, "in the labelled and the unlabelled folder")
    require_disjoint(pseudo, inner_val, "pseudo-label of an inner validation image")


def pseudo_label_lines(admitted: DataFrame, images: DataFrame, default_size: int = 640) -> DataFrame:
    """image_id, line of admitted boxes (line null without area); images of unknown size count as 640 x 640."""
    sizes = images.select("image_id", "width", "height")
    w, h = F.coalesce("width", F.lit(default_size)), F.coalesce("height", F.lit(default_size))
    joined = admitted.join(sizes, "image_id", "left")
    return joined.select("image_id", "box_id", label_line(F.col("pred_class"), normalised_from_corners(F.col("box"), w, h)).alias("line"))


def assemble(train: DataFrame, inner_val: DataFrame, labels: DataFrame, pseudo_lines: DataFrame) -> DataFrame:
    """partition (train or val), image_id, lines. An image whose boxes have no area stays, without lines.

    train and inner_val have image_id; labels and pseudo_lines image_id, line. Pseudo-label
    lines come after an image's own and go to train only.
    """
    own = labels.select("image_id", F.lit(0).alias("k"), "line")
    extra = pseudo_lines.select("image_id", F.lit(1).alias("k"), "line")
    members = train.select("image_id", F.lit("train").alias("partition")).union(inner_val.select("image_id", F.lit("val")))
    members = members.union(pseudo_lines.select("image_id", F.lit("train"))).distinct()
    lines = own.unionByName(extra).where("line is not null").groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("k", "line"))).alias("l"))
    return members.join(lines, "image_id", "left").select("partition", "image_id", F.coalesce(F.transform("l", lambda x: x["line"]), F.array().cast("array<string>")).alias("lines"))


def write_label_files(files: DataFrame, folder: str, skip_empty: bool = True) -> DataFrame:
    """Writes `<folder>/<partition>/<image_id>.txt` for each row of (partition, image_id, lines); the paths written.

    The folder must be one that all executors share. A file is written under another name and
    moved, so a task that runs again leaves whole files. Texts come to Python in pieces of 16 KB, so that a
    batch of rows is bounded however long they are.
    """
    rows = files.where(F.size("lines") > 0) if skip_empty else files
    whole = full_uri(files.sparkSession, folder)
    text = F.concat(F.array_join("lines", "\n"), F.when(F.size("lines") > 0, "\n").otherwise("")).cast("binary")
    last = F.expr(f"greatest(octet_length(text) - 1, 0) div {PIECE}").cast("int")
    rows = rows.select("partition", "image_id", text.alias("text")).withColumn("last", last)
    pieces = rows.select("partition", "image_id", "last", F.posexplode(F.transform(F.sequence(F.lit(0), "last"), lambda k: F.substring("text", k * PIECE + 1, F.lit(PIECE)))).alias("k", "piece"))

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = located(whole, "")
        made, out = set(), None
        for part in parts:
            paths = []
            for partition, image, last, k, piece in zip(*[c.to_pylist() for c in part.columns], strict=True):
                if k == 0:
                    if partition not in made:
                        fs.create_dir(f"{root}/{partition}", recursive=True)
                        made.add(partition)
                    own = f"{root}/{partition}/.{uuid.uuid4().hex}"
                    out = fs.open_output_stream(own)
                out.write(piece)
                if k == last:
                    out.close()
                    paths.append(f"{root}/{partition}/{image}.txt")
                    fs.move(own, paths[-1])
            yield pa.RecordBatch.from_pydict({"path": pa.array(paths, pa.string())})

    return pieces.select("partition", "image_id", "last", "k", "piece").mapInArrow(write, "path string")


def archive_label_files(files: DataFrame, folder: str, skip_empty: bool = True) -> DataFrame:
    """`write_label_files` into archives, as `<partition>/<image_id>.txt`, for so many images that a file each is too dear; the manifest."""
    rows = files.where(F.size("lines") > 0) if skip_empty else files
    text = F.concat(F.array_join("lines", "\n"), F.when(F.size("lines") > 0, "\n").otherwise(""))
    return write_archives(rows.select(F.concat_ws("/", "partition", F.concat("image_id", F.lit(".txt"))).alias("name"), text.alias("content")), folder)


def copy_files(pairs: DataFrame) -> DataFrame:
    """Copies each (source, target) in the task that holds it; source, target, outcome (copied, missing or kept) of each.

    Sources that don't exist are passed over and targets that do are kept. A copy gets its name when it is whole, so a task may run again.
    """

    default = default_root(pairs.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def there(fs, path: str) -> bool:
            return fs.get_file_info(path).type != pafs.FileType.NotFound

        def copy(source: str, target: str) -> str:
            (fs, a), (out, b) = located(source, default), located(target, default)
            if not there(fs, a):
                return "missing"
            if there(out, b):
                return "kept"
            folder = b.rpartition("/")[0]
            out.create_dir(folder, recursive=True)
            own = f"{folder}/.{uuid.uuid4().hex}"
            pafs.copy_files(a, own, source_filesystem=fs, destination_filesystem=out)
            out.move(own, b)
            return "copied"

        for part in parts:
            yield part.assign(outcome=[copy(r.source, r.target) for r in part.itertuples()])

    return pairs.select("source", "target").distinct().mapInPandas(run, "source string, target string, outcome string")


def write_dataset(files: DataFrame, images: DataFrame, folder: str, classes: int, names: list[str] | None = None, require_all: bool = False, **checked) -> str:
    """A training dataset in `folder`: images/<partition>, labels/<partition> and dataset.yaml; the path of the last.

    files are rows of `assemble`, images (image_id, path) of `resolved_images`; checked goes to
    `validate`, which runs before anything is written; a folder that is there and is no dataset is an error.
    The set is made in a folder beside, its copies are counted, dataset.yaml comes last, and
    two renames put it in the place of the one that was there. A run that ends in
    between leaves that one whole, at its place or, between the renames, as `<folder>.old`, from where
    the next run takes it back. Images without lines have no label file. Images without a path or a file
    are left out with a warning that counts them and names the first, or with `require_all` are an
    error.
    """
    spark = files.sparkSession
    validate(**checked)
    folder, made, old = folder.rstrip("/"), f"{folder.rstrip('/')}.{uuid.uuid4().hex}", f"{folder.rstrip('/')}.old"
    body = dataset_yaml(folder, classes, names, bool(files.where("partition = 'val'").limit(1).count()))
    if exists(spark, old) and not exists(spark, folder):
        rename(spark, old, folder)
    if exists(spark, folder) and not exists(spark, f"{folder}/dataset.yaml"):
        raise FileExistsError(f"{folder} holds no dataset.yaml, so it is not replaced")
    try:
        target = F.concat(F.lit(f"{made}/images/"), "partition", F.lit("/"), "image_id", suffix(F.col("path")))
        wanted = files.select("partition", "image_id").distinct().join(images.select("image_id", "path"), "image_id", "left")
        copied = copy_files(wanted.where("path is not null").select(F.col("path").alias("source"), target.alias("target")))
        lacking = wanted.where("path is null").select("image_id").union(copied.where("outcome = 'missing'").select("source"))
        summary = lacking.agg(F.count("*").alias("n"), F.min("image_id").alias("first")).first()
        if summary.n:
            said = f"{summary.n} images have no file, such as {summary.first}"
            if require_all:
                raise FileNotFoundError(said)
            warnings.warn(said, stacklevel=2)
        write_label_files(files, f"{made}/labels").count()
        write_text(spark, f"{made}/dataset.yaml", body)
    except BaseException:
        drop(spark, made)
        raise
    drop(spark, old)
    if exists(spark, folder):
        rename(spark, folder, old)
    rename(spark, made, folder)
    drop(spark, old)
    return f"{folder}/dataset.yaml"


def dataset_yaml(path: str, classes: int, names: list[str] | None = None, has_val: bool = True) -> str:
    """The text of dataset.yaml; names default to the numbers, val to train."""
    if names is not None and len(names) != classes:
        raise ValueError(f"{len(names)} class names for {classes} classes")
    names = names or [str(k) for k in range(classes)]
    body = {"path": path, "train": "images/train", "val": "images/val" if has_val else "images/train", "nc": classes, "names": names}
    return yaml.safe_dump(body, sort_keys=False)
