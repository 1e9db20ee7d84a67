"""Connected components of an edge relation, by rounds of joins and aggregations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, few


def roots_of(a: np.ndarray, b: np.ndarray, label: np.ndarray) -> None:
    """Unites label[a] with label[b], link by link, within a task; label[i] is then the least of i's class."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def _least_parent(edges: DataFrame, key: str) -> DataFrame:
    return edges.groupBy(F.col("child").alias(key)).agg(F.min("parent").alias("least"))


def _round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges whose child is above its parent."""
    top = _least_parent(edges, "parent")
    lifted = edges.join(top, "parent", "left").select("child", F.coalesce("least", "parent").alias("parent")).distinct()
    low = _least_parent(lifted, "child")
    hung = lifted.join(low, "child").select(
        F.explode(
            F.array(
                F.struct("child", F.col("least").alias("parent")),
                F.struct(F.col("parent").alias("child"), F.col("least").alias("parent")),
            )
        ).alias("e")
    )
    return hung.select("e.child", "e.parent").where("child <> parent").distinct()


def connected_components(links: DataFrame, left: str, right: str, most_rounds: int = 64) -> DataFrame:
    """(node, root) for every node of a link; root is the least node that it reaches.

    Links with a null end, and links of a node to itself, join nothing; a node that has no
    other link isn't returned. An empty relation gives an empty one. Nodes may be of any
    type that Spark orders. Each round aggregates with map-side combining and joins on a
    table with one row a node, so that AQE can split the other side of a hot node. The
    edges are checkpointed each round; only their count and checksum reach the driver.
    """
    ends = [F.col(left), F.col(right)]
    edges = (
        links.where(ends[0].isNotNull() & ends[1].isNotNull() & (ends[0] != ends[1]))
        .select(F.greatest(*ends).alias("child"), F.least(*ends).alias("parent"))
        .distinct()
    )
    edges, seen = checkpoint(edges), None
    for _ in range(most_rounds):
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("child", "parent").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == seen:
            break
        seen = state
        edges = checkpoint(_round(edges))
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = edges.select(F.col("parent").alias("node"), F.col("parent").alias("root")).distinct()
    return edges.select(F.col("child").alias("node"), F.col("parent").alias("root")).union(roots)


def named_components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, class, component_id) of every row of `nodes` (id, least): an id that all of its component share, and the least `least` in it.

    `links` (a, b) name nodes by id and are a table or checkpointed. Nulls are the least of none
    but each other. While the components run a node's name begins with its `least`, so the
    least name gives the component's id and no join or aggregation on it follows.
    """
    ends = checkpoint(links.select(F.col("a").alias("id")).union(links.select(F.col("b").alias("id"))).distinct())
    name = F.struct(F.col("least").isNull().alias("none"), "least", "id")
    named = checkpoint(nodes.join(few(ends), "id").select("id", name.alias("name")))
    named_links = links.join(named.toDF("a", "x"), "a").join(named.toDF("b", "y"), "b")
    roots = connected_components(named_links, "x", "y")
    roots = checkpoint(roots.select(F.col("node.id").alias("id"), F.col("root").alias("root")))
    out = nodes.join(few(roots), "id", "left")
    return out.select("id", F.coalesce("root.id", "id").alias("class"), F.coalesce("root.least", "least").alias("component_id"))
