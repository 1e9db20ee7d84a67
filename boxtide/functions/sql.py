"""The functions in SQL: scalar ones, visible to Catalyst, and the assignment as a function of a table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import arrow_udtf, udtf

BOX = "STRUCT<x1: DOUBLE, y1: DOUBLE, x2: DOUBLE, y2: DOUBLE>"

FUNCTIONS = {
    "box_area": (f"b {BOX}", "DOUBLE", "greatest(b.x2 - b.x1, 0D) * greatest(b.y2 - b.y1, 0D)"),
    "box_overlap": (
        f"a {BOX}, b {BOX}",
        "DOUBLE",
        "greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0D) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0D)",
    ),
    "box_iou": (
        f"a {BOX}, b {BOX}",
        "DOUBLE",
        "CASE WHEN a IS NULL OR b IS NULL THEN NULL ELSE coalesce(try_divide(box_overlap(a, b), box_area(a) + box_area(b) - box_overlap(a, b)), 0D) END",
    ),
    "dist_total": ("v ARRAY<DOUBLE>", "DOUBLE", "aggregate(v, 0D, (s, x) -> s + x)"),
    "dist_normalize": (
        "v ARRAY<DOUBLE>",
        "ARRAY<DOUBLE>",
        "CASE WHEN dist_total(v) > 0 THEN transform(v, x -> x / dist_total(v)) ELSE transform(v, x -> 1D / size(v)) END",
    ),
    "js_divergence": (
        "p ARRAY<DOUBLE>, q ARRAY<DOUBLE>",
        "DOUBLE",
        """least(1D, greatest(0D, aggregate(zip_with(dist_normalize(p), dist_normalize(q), (a, b) ->
            CASE WHEN a > 0 THEN a * ln(2 * a / (a + b)) ELSE 0D END + CASE WHEN b > 0 THEN b * ln(2 * b / (a + b)) ELSE 0D END),
            0D, (s, x) -> s + x) / 2 / ln(2)))""",
    ),
}


EDGES = {
    "image_id": pa.string(),
    "box_id_t": pa.string(),
    "box_id_prev": pa.string(),
    "iou": pa.float64(),
    "js": pa.float64(),
    "pred_class_t": pa.int32(),
    "pred_class_prev": pa.int32(),
    "confidence": pa.float64(),
    "cost": pa.float64(),
}


class Assign:
    """`assign_rows`, which is `assign` (`AssignBatches`) a row at a time."""

    AT_ONCE = 1 << 14

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.epsilon = 0.05
        self.places: list[int] | None = None

    def eval(self, edge: Row, epsilon: float) -> Iterator[tuple]:
        if self.places is None:
            self.epsilon = float(epsilon)
            self.places = [edge.__fields__.index(name) for name in EDGES]
        row = tuple([edge[k] for k in self.places])
        if len(self.rows) >= self.AT_ONCE and row[0] != self.rows[-1][0]:
            yield from self.solved()
        self.rows.append(row)

    def solved(self) -> Iterator[tuple]:
        from ..operators.matching import MATCH_FIELDS, match_images

        columns = zip(*self.rows, strict=True)
        edges = pa.table([pa.array(c, kind) for c, kind in zip(columns, EDGES.values(), strict=True)], names=list(EDGES))
        self.rows = []
        matched = match_images(edges, self.epsilon)
        yield from zip(*(matched[name].to_pylist() for name in MATCH_FIELDS), strict=True)

    def terminate(self) -> Iterator[tuple]:
        if self.rows:
            yield from self.solved()


class AssignBatches:
    """`select * from assign(table(edges) partition by image_id order by (box_id_t, box_id_prev), 0.05)`.

    The table has the columns of `candidate_edges` with `keep_lonely`, in any order, others beside them are
    dropped; the number is epsilon_match. Rows are those of `match`. With some millions of small images, partition by
    a hash of the image and order by (image_id, box_id_t, box_id_prev): images of a partition are then solved together,
    some `AT_ONCE` edges at a time. Edges come and matches go as Arrow batches, no row is made a Python object.
    An instance holds that many edges, a batch and one image's.
    """

    AT_ONCE = 1 << 14

    def __init__(self) -> None:
        self.held: list[pa.RecordBatch] = []
        self.rows = 0
        self.epsilon = 0.05

    def eval(self, edges: pa.RecordBatch, epsilon: pa.Array) -> Iterator[pa.Table]:
        if not edges.num_rows:
            return
        self.epsilon = float(epsilon[0].as_py())
        edges = edges.select(list(EDGES))
        image = edges.column("image_id")
        # an image that goes on from the batch before is solved when another follows; its batches are joined only then
        if self.rows >= self.AT_ONCE and (image[0] != self.held[-1].column("image_id")[-1] or image[0] != image[-1]):
            mine = edges.num_rows - pc.sum(pc.equal(image, image[-1])).as_py() if image[-1].is_valid else 0
            yield from self.solved([*self.held, edges.slice(0, mine)])
            self.held, self.rows, edges = [], 0, edges.slice(mine)
        self.held.append(edges)
        self.rows += edges.num_rows

    def solved(self, edges: list[pa.RecordBatch]) -> Iterator[pa.Table]:
        from ..operators.matching import MATCH_FIELDS, match_images

        whole = pa.Table.from_batches(edges).cast(pa.schema(list(EDGES.items()))).combine_chunks()
        yield match_images(whole, self.epsilon).select(MATCH_FIELDS)

    def terminate(self) -> Iterator[pa.Table]:
        if self.rows:
            yield from self.solved(self.held)


def register(spark: SparkSession) -> list[str]:
    """Creates the temporary functions in the session; their names."""
    from ..operators.matching import MATCHES

    spark.udtf.register("assign", arrow_udtf(AssignBatches, returnType=MATCHES))
    spark.udtf.register("assign_rows", udtf(Assign, returnType=MATCHES))
    for name, (arguments, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    return [*FUNCTIONS, "assign", "assign_rows"]
