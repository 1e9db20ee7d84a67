"""Files outside of relations: made whole or not at all, on whatever file system Spark means."""

from __future__ import annotations

import re
import time
import uuid

import pyarrow.fs as pafs

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from ..session import full_uri


def _hadoop(spark: SparkSession, path: str) -> tuple:
    """(file system, path) of the JVM."""
    own = spark._jvm.org.apache.hadoop.fs.Path(full_uri(spark, path))
    return own.getFileSystem(spark._jsc.hadoopConfiguration()), own


def put_if_absent(spark: SparkSession, path: str, text: str) -> None:
    """A file that holds `text`, whole as soon as it is there; FileExistsError if there is one, also if another writer was faster.

    It is written under a hidden name and then linked (local) or renamed without overwriting, which the file
    system does for one writer only. Where renaming is a copy, as in object stores, it holds as far as theirs does.
    """
    jvm = spark._jvm
    fs, target = _hadoop(spark, path)
    own = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}")
    fs.mkdirs(target.getParent())
    out = fs.create(own, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if target.toUri().getScheme() == "file":
            place = jvm.java.nio.file.Paths.get
            jvm.java.nio.file.Files.createLink(place(target.toUri()), place(own.toUri()))
        else:
            none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(own, target, none)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            raise FileExistsError(path) from e
        raise
    finally:
        fs.delete(own, False)


def folders(spark: SparkSession, path: str) -> list[tuple[str, float]]:
    """(name, seconds since its last change) of each folder in `path`; none where there is no such path."""
    fs, own = _hadoop(spark, path)
    if not fs.exists(own):
        return []
    return [(s.getPath().getName(), time.time() - s.getModificationTime() / 1000) for s in fs.listStatus(own) if s.isDirectory()]


def drop(spark: SparkSession, path: str) -> None:
    fs, own = _hadoop(spark, path)
    fs.delete(own, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, own = _hadoop(spark, path)
    return fs.exists(own)


def rename(spark: SparkSession, source: str, target: str) -> None:
    """Moves a file or folder within its file system; OSError if it doesn't."""
    fs, own = _hadoop(spark, source)
    if not fs.rename(own, _hadoop(spark, target)[1]):
        raise OSError(f"{source} could not be moved to {target}")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A file of `text` and nothing beside it, where Hadoop's local file system would leave a checksum file."""
    fs, own = _hadoop(spark, path)
    fs = fs.getRawFileSystem() if own.toUri().getScheme() == "file" else fs
    out = fs.create(own, True)
    out.write(bytearray(text.encode()))
    out.close()


def default_root(spark: SparkSession) -> str:
    """What comes before an absolute path without a scheme, for tasks, which have no session."""
    return full_uri(spark, "/x").removesuffix("/x")


def located(path: str, root: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, and the path there; `root` is that of `default_root`."""
    whole = path if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path) else root + path
    return pafs.FileSystem.from_uri(re.sub("^file:/+", "file:///", whole))
