"""Checks that relations of a round fit together: one census of who is where, and a report of what is wrong."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A check: its name, which members of the census are bad, and how many rows each counts for.
Check = tuple[str, Column, Column]


def problem(rows: DataFrame, check: str, ident: str, n_sample: int = 3) -> DataFrame:
    """(check, n_bad, sample): how many rows there are and the first few identifiers, whatever their number."""
    first = rows.select(F.col(ident).alias("_id")).orderBy("_id").limit(n_sample)
    sample = first.agg(F.array_sort(F.collect_list("_id")).alias("sample"))
    return rows.agg(F.count("*").alias("n_bad")).join(sample).select(F.lit(check).alias("check"), "n_bad", "sample")


def census(members: DataFrame, tags: list[str], *key: str) -> DataFrame:
    """A row for each key with n_<tag>, how many rows of `members` (key, tag) each tag has there.

    However many relations and checks there are, it is one exchange, with counts combined before it.
    """
    return members.groupBy(*key).agg(*[F.count_if(F.col("tag") == t).alias(f"n_{t}") for t in tags])


def found_in(counted: DataFrame, checks: list[Check], ident: str, n_sample: int = 3) -> DataFrame:
    """(check, n_bad, sample) of a census, a row for each check, in one pass; the first ids of each task, a few, meet in the end."""
    bad = F.array_compact(F.array(*[F.when(when & (weight > 0), F.struct(F.lit(k).alias("k"), weight.cast("long").alias("n"))) for k, (_, when, weight) in enumerate(checks)]))
    wrong = counted.where(F.size(bad) > 0).select(F.col(ident).cast("string").alias("id"), F.explode(bad).alias("x")).select("x.k", "x.n", "id")

    def summed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, first = {}, {}
        for part in parts:
            for k, rows in part.groupby("k"):
                n[k] = n.get(k, 0) + int(rows.n.sum())
                first[k] = heapq.nsmallest(n_sample, [*first.get(k, []), *rows.id])
        if n:
            yield pd.DataFrame({"k": list(n), "n": list(n.values()), "first": [first[k] for k in n]})

    parts = wrong.mapInPandas(summed, "k int, n long, first array<string>").groupBy("k").agg(F.sum("n").alias("n_bad"), F.flatten(F.collect_list("first")).alias("first"))
    names = counted.sparkSession.createDataFrame([(k, c[0]) for k, c in enumerate(checks)], "k int, check string")
    sample = F.slice(F.array_sort(F.coalesce("first", F.array().cast("array<string>"))), 1, n_sample)
    return names.join(F.broadcast(parts), "k", "left").select("check", F.coalesce("n_bad", F.lit(0)).alias("n_bad"), sample.alias("sample"))


def _is(*columns: str) -> Column:
    """Whether all counts are above 0."""
    return reduce(Column.__and__, [F.col(f"n_{c}") > 0 for c in columns])


def _tagged(rows: DataFrame, tag: str | Column, box: str | None = None) -> DataFrame:
    box = F.lit(None).cast("string") if box is None else F.col(box)
    return rows.select(F.col("image_id"), box.alias("box_id"), (F.lit(tag) if isinstance(tag, str) else tag).alias("tag"))


def _lacking(name: str, tag: str, other: str) -> Check:
    return name, _is(tag) & (F.col(f"n_{other}") == 0), F.col(f"n_{tag}")


MATCH_TAGS = ["match_image", "pool_image", "matched", "unmatched", "ambiguous", "named", "current", "previous"]


def _match_checks() -> list[Check]:
    return [
        ("image without match", _is("pool_image") & (F.col("n_match_image") == 0), F.lit(1)),
        *[_lacking(f"{s} box not in current pool", s, "current") for s in ("matched", "unmatched", "ambiguous")],
        _lacking("matched box not in previous pool", "named", "previous"),
    ]


def _match_members(matches: DataFrame, current: DataFrame, previous: DataFrame) -> DataFrame:
    """A match's own box and the previous one that it names, in one pass over the matches; and both pools."""
    own = F.struct(F.col("box_id_t").alias("box_id"), F.col("status").alias("tag"))
    named = F.when((F.col("status") == "matched") & F.col("box_id_prev").isNotNull(), F.struct(F.col("box_id_prev").alias("box_id"), F.lit("named").alias("tag")))
    each = matches.select("image_id", F.explode(F.array_compact(F.array(own, named))).alias("x")).select("image_id", "x.box_id", "x.tag").where("box_id is not null")
    return each.unionByName(_tagged(current, "current", "box_id")).unionByName(_tagged(previous, "previous", "box_id"))


def _dealt(members: DataFrame, saved: DataFrame) -> DataFrame:
    """Members of a census by image, so many parts that one holds some 2^20 boxes of the saved relation and no task's counts grow with the tables.

    Nearly every box is a key of its own, so counting before the exchange would only hold them once more.
    """
    least = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return members.repartition(max(least, saved.count() >> 20), "image_id")


def match_report(matches: DataFrame, current: DataFrame, previous: DataFrame, match_images: DataFrame, pool_images: DataFrame) -> DataFrame:
    """Images without a match result, and ids in matches that are in no pool. The matches are read three times: give saved ones."""
    members = _match_members(matches, current, previous).unionByName(_tagged(match_images, "match_image")).unionByName(_tagged(pool_images, "pool_image"))
    counted = census(_dealt(members, matches), MATCH_TAGS, "image_id", "box_id")
    return found_in(counted.withColumn("_id", F.coalesce("box_id", "image_id")), _match_checks(), "_id")


def _lined_up(rows: DataFrame, others: DataFrame, how: str) -> DataFrame:
    """Counts of two relations side by side, 0 where one has no row; both have image_id and box_id or image_id alone as key."""
    keys = [k for k in ("image_id", "box_id") if k in rows.columns]
    joined = rows.join(others, keys, how)
    return joined.fillna(0, [c for c in joined.columns if c not in keys])


def round_report(matches: DataFrame, current: DataFrame, previous: DataFrame, scored: DataFrame) -> DataFrame:
    """All that must hold of a round before it counts, of relations with image_id and box ids.

    Every image of the pool has a match result, ids in matches are in their pools, no box is in the pool
    or admitted twice, all have a score and none is scored or admitted that the pool lacks. Relations are
    counted by box and joined in pairs, which moves no row of those that lie in buckets by image.
    """
    key = ("image_id", "box_id")
    pool = census(_tagged(current, "current", "box_id"), ["current"], *key)
    statuses = ["matched", "unmatched", "ambiguous"]
    own = census(_tagged(matches, F.col("status"), "box_id_t").where("box_id is not null"), statuses, *key)
    named = census(_tagged(matches.where("status = 'matched' and box_id_prev is not null"), "named", "box_id_prev"), ["named"], *key)
    result = scored.groupBy("image_id", F.col("box_id_t").alias("box_id")).agg(F.count("*").alias("n_scored"), F.count_if("admitted").alias("n_admitted"))
    images = [census(_tagged(rows, tag), [tag], "image_id") for rows, tag in ((current, "pool_image"), (matches, "match_image"))]
    no_match, *lost, unknown = _match_checks()
    parts = [
        (_lined_up(pool, own, "full_outer"), [("box more than once in the pool", F.col("n_current") > 1, F.lit(1)), *lost], "box_id"),
        (_lined_up(*images, "left"), [no_match], "image_id"),
        (_lined_up(named, census(_tagged(previous, "previous", "box_id"), ["previous"], *key), "left"), [unknown], "box_id"),
        (
            _lined_up(pool, result, "full_outer"),
            [
                _lacking("admitted box not in current pool", "admitted", "current"),
                ("admitted box more than once", F.col("n_admitted") > 1, F.lit(1)),
                _lacking("box without a score", "current", "scored"),
            ],
            "box_id",
        ),
    ]
    return reduce(DataFrame.unionByName, [found_in(*part) for part in parts])


def _by_box(**relations: DataFrame) -> DataFrame:
    """A census by box id alone."""
    return census(reduce(DataFrame.unionByName, [r.select("box_id", F.lit(t).alias("tag")) for t, r in relations.items()]), list(relations), "box_id")


def admitted_report(admitted: DataFrame, current: DataFrame) -> DataFrame:
    """Admitted ids that the pool lacks, and those that are there more than once."""
    checks = [_lacking("admitted box not in current pool", "admitted", "current"), ("admitted box more than once", F.col("n_admitted") > 1, F.lit(1))]
    return found_in(_by_box(admitted=admitted, current=current), checks, "box_id")


def unscored_report(current: DataFrame, scored: DataFrame) -> DataFrame:
    own = scored.select(F.col("box_id_t").alias("box_id"))
    return found_in(_by_box(current=current, scored=own), [_lacking("box without a score", "current", "scored")], "box_id")


def repeated_report(current: DataFrame) -> DataFrame:
    counted = census(_tagged(current, "current", "box_id"), ["current"], "image_id", "box_id")
    return found_in(counted, [("box more than once in the pool", F.col("n_current") > 1, F.lit(1))], "box_id")


def require_clean(report: DataFrame) -> None:
    """Raises ValueError that names the check and its first ids."""
    for row in report.where("n_bad > 0").collect():
        raise ValueError(f"{row['check']}: {row['n_bad']}, such as {', '.join(map(str, row['sample']))}")
