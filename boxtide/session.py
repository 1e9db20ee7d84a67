"""The session that tests and the benchmark use, and the package on the executors."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | None = None, app: str = "boxtide") -> SparkSession:
    """A session on this machine's cores; a cluster brings its own."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def full_uri(spark: SparkSession, path: str) -> str:
    """`path` with the scheme by which Spark would read it, so that other readers mean the same place.

    A path without one lies on the default file system, which need not be the local disk.
    """
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = own.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(own).toString()
    return re.sub("^file:/+", "file:///", whole.rstrip("/"))


def shared_dir(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`, which driver and executors share, with its scheme.

    Only where the session names none and master is local (tests on one machine) a temporary
    folder is made; executors on other machines would not share it, so there that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return full_uri(spark, named)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="boxtide-"))
    return full_uri(spark, sc.getCheckpointDir())


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage with files in the shared folder, which survive the loss of executors."""
    spark = df.sparkSession
    where = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return df.checkpoint()


def ship(spark: SparkSession) -> None:
    """Sends this package to the session's Python workers, once a context.

    They need no path of the driver's then, as with `--py-files`.
    """
    sc = spark.sparkContext
    if getattr(sc, "_boxtide_shipped", False):
        return
    root = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="boxtide-")) / "boxtide.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._boxtide_shipped = True
