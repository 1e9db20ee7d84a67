"""The append-only store of rounds: Parquet written by attempts, and a manifest for each round that names the one that counts."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import BANK_ROW, ROUND_METADATA
from .files import drop, folders, put_if_absent

_ROUND = T.StructField("round_id", T.IntegerType())
_IMAGES = T.StructType([T.StructField("image_id", T.StringType()), _ROUND])
_MANIFEST = T.StructType([*ROUND_METADATA.fields, T.StructField("attempt", T.StringType()), T.StructField("created_at", T.TimestampType())])
_MARK = "step string, round_id int, value string"


def by_image(boxes: DataFrame) -> DataFrame:
    """`boxes` dealt out by image, where they aren't yet: a window asks for that, and an exchange that is there will do."""
    place = F.row_number().over(Window.partitionBy("image_id").orderBy("box_id"))
    return boxes.withColumn("_place", place).where("_place > 0").drop("_place")


def write_buckets(rows: DataFrame, path: str) -> int:
    """Writes rows to a new folder in buckets by image, as many as spark.sql.shuffle.partitions says; their number.

    Give rows that are dealt out by image (`by_image`), else each task has a file for each bucket. The table that
    Spark writes buckets by is external and known to the session only for that time, as it is in `read_buckets`.
    """
    spark, table = rows.sparkSession, f"buckets_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.write.bucketBy(buckets, "image_id").option("path", path).saveAsTable(table, format="parquet")
    spark.sql(f"drop table {table}")
    return buckets


def read_buckets(spark: SparkSession, path: str, schema: T.StructType, buckets: int) -> DataFrame:
    """What `write_buckets` wrote; joins and groups by image need no exchange of it."""
    table, place = f"buckets_{uuid.uuid4().hex}", path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"create table {table} ({schema.toDDL()}) using parquet clustered by (image_id) into {buckets} buckets location '{place}'")
    rows = spark.table(table)
    spark.sql(f"drop table {table}")
    return rows


@contextmanager
def joined_in_buckets(spark: SparkSession) -> Iterator[None]:
    """While this holds, joins by image and box take what lies in buckets by image as it is."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class RoundStore:
    """Rounds below `path`: boxes and images in folders by round and attempt, a manifest a round in `commits`.

    Every write is an attempt of its own, so writers never touch each other's files. A round
    exists once its manifest does, which one writer alone can make; readers take the attempt that it
    names and no other. Attempts without one, left by runs that ended in between or were too late, are dropped
    by `drop_unfinished`. A committed round is never written again.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, what: str, schema: T.StructType | str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).json(f"{self.path}/{what}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def manifests(self) -> DataFrame:
        """Metadata of the committed rounds with attempt and created_at (UTC)."""
        return self._read("commits", _MANIFEST)

    def all_metadata(self) -> DataFrame:
        return self.manifests().select(*ROUND_METADATA.fieldNames()).orderBy("round_id")

    def metadata(self, round_id: int):
        """The round's row, or None."""
        return self.all_metadata().where(F.col("round_id") == round_id).first()

    def committed_rounds(self) -> list[int]:
        return [r[0] for r in self.all_metadata().select("round_id").collect()]

    def latest_round(self) -> int | None:
        return self.all_metadata().agg(F.max("round_id")).first()[0]

    def _attempt(self, round_id: int) -> str | None:
        row = self.manifests().where(F.col("round_id") == round_id).first()
        if row is None:
            raise FileNotFoundError(f"round {round_id} is not in {self.path}")
        return row.attempt

    def _rows(self, what: str, schema: T.StructType, round_id: int, attempt: str | None) -> DataFrame:
        """One attempt's files alone; none where a round was committed without any."""
        if attempt is None:
            return self.spark.createDataFrame([], schema)
        own = T.StructType([f for f in schema.fields if f is not _ROUND])
        where = f"{self.path}/{what}/round_id={round_id}/attempt={attempt}"
        if what == "bank" and "-" in attempt:
            rows = read_buckets(self.spark, where, own, int(attempt.rpartition("-")[2]))
        else:
            rows = self.spark.read.schema(own).parquet(where)
        return rows.withColumn("round_id", F.lit(round_id))

    def written_rows(self, round_id: int, attempt: str | None = None) -> DataFrame:
        """The boxes of an attempt, of the committed one unless it is named."""
        return self._rows("bank", T.StructType([*BANK_ROW.fields, _ROUND]), round_id, attempt or self._attempt(round_id))

    def pool(self, round_id: int) -> DataFrame:
        """The boxes of a committed round; FileNotFoundError if it isn't. Of repeated box ids any one counts."""
        return self.written_rows(round_id)

    def images(self, round_id: int) -> DataFrame:
        return self._rows("images", _IMAGES, round_id, self._attempt(round_id))

    def write(self, round_id: int, rows: DataFrame, images: DataFrame) -> str:
        """Writes a round's rows (BANK_ROW and round_id) and images as an attempt, not yet committed; its name.

        Boxes lie in buckets by image (`write_buckets`), whose number the attempt's name ends with.
        """
        if self.metadata(round_id) is not None:
            raise FileExistsError(f"round {round_id} is already in {self.path}")
        attempt = f"{uuid.uuid4().hex}-{self.spark.conf.get('spark.sql.shuffle.partitions')}"
        place = f"round_id={round_id}/attempt={attempt}"
        write_buckets(rows.select(*BANK_ROW.fieldNames()), f"{self.path}/bank/{place}")
        images.select("image_id").write.parquet(f"{self.path}/images/{place}")
        return attempt

    def commit(self, attempt: str | None = None, **meta) -> None:
        """Makes the round of the metadata visible, with the rows of `attempt`.

        FileExistsError if it is already; of several writers at once one succeeds.
        """
        row = {f: meta[f] for f in ROUND_METADATA.fieldNames()} | {"attempt": attempt, "created_at": datetime.now(timezone.utc).isoformat()}
        try:
            put_if_absent(self.spark, f"{self.path}/commits/round-{meta['round_id']:08d}.json", json.dumps(row))
        except FileExistsError:
            raise FileExistsError(f"round {meta['round_id']} is already in {self.path}") from None

    def append(self, rows: DataFrame, images: DataFrame, **meta) -> None:
        """write and commit; ValueError if the rows are not all of the metadata's round. Rows of an attempt that came too late are dropped."""
        odd = [r[0] for r in rows.select("round_id").where(F.col("round_id") != meta["round_id"]).distinct().limit(3).collect()]
        if odd:
            raise ValueError(f"rows of rounds {odd} in a commit of round {meta['round_id']}")
        attempt = self.write(meta["round_id"], rows, images)
        try:
            self.commit(attempt, **meta)
        except FileExistsError:
            self.drop(meta["round_id"], attempt)
            raise

    def drop(self, round_id: int, attempt: str) -> None:
        """Deletes the files of an attempt that no manifest names."""
        for what in ("bank", "images"):
            drop(self.spark, f"{self.path}/{what}/round_id={round_id}/attempt={attempt}")

    def unfinished(self, older_than: float = 0) -> list[tuple[int, str]]:
        """(round, attempt) of what no manifest names and nobody has touched for `older_than` seconds."""
        known = {(r.round_id, r.attempt) for r in self.manifests().select("round_id", "attempt").collect()}
        found = set()
        for what in ("bank", "images"):
            for name, _ in folders(self.spark, f"{self.path}/{what}"):
                for own, age in folders(self.spark, f"{self.path}/{what}/{name}"):
                    place = int(name.removeprefix("round_id=")), own.removeprefix("attempt=")
                    if place not in known and age >= older_than:
                        found.add(place)
        return sorted(found)

    def drop_unfinished(self, older_than: float = 86_400) -> list[tuple[int, str]]:
        """Deletes what `unfinished` lists; give an age that no writer at work reaches."""
        gone = self.unfinished(older_than)
        for round_id, attempt in gone:
            self.drop(round_id, attempt)
        return gone

    def mark(self, step: str, round_id: int, value: str = "") -> None:
        """Notes that a step after a round's commit is done; FileExistsError if it was."""
        text = json.dumps({"step": step, "round_id": round_id, "value": value})
        put_if_absent(self.spark, f"{self.path}/steps/{step}-{round_id:08d}.json", text)

    def marks(self) -> dict[tuple[str, int], str]:
        return {(r.step, r.round_id): r.value for r in self._read("steps", _MARK).collect()}

    def export_json(self, round_id: int) -> DataFrame:
        """Each row of a round as a JSON text."""
        rows = self.pool(round_id)
        return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))
