"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered

SHARDS = 40
SEED = 42


def interleave(rows: DataFrame, shards: int, stratum: str = "source", seed: int = SEED, key: str = "doc_id") -> DataFrame:
    """`rows` with `shard` (0 to shards - 1) and `slot` (from 0, gapless within its shard).

    Within each value of `stratum` the rows are ranked in an order shuffled by the seed; all
    rows are then sorted by (rank + 1/2) / rows of the stratum and cut into runs whose
    lengths differ by one at most. Each run so holds every stratum in its share of the
    whole, up to a row. Give slim rows: all columns are shuffled twice.

    The shuffled order is the md5 of seed, key and the row's other columns, then these
    columns: rows that are equal in all of them are interchangeable. A null stratum is a
    stratum of its own. No rows: no rows. Columns
    of the operator's own names (shard, slot, position and some that begin with _) go. Both sorts are dealt by range over all order
    columns, so that a hot stratum is spread over many tasks.
    """
    rows = rows.drop("shard", "slot", "position", "_salt", "_share", "_at", "_part", "_mid", "_before", "_stratum", "_first", "_of")
    rest = [c for c in rows.columns if c not in (stratum, key)]
    salt = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    ranked = numbered(rows.withColumn("_salt", salt), stratum, "_salt", key, *rest).withColumnRenamed("position", "_at")
    strata = ranked.groupBy(F.col(stratum).alias("_stratum")).agg(F.min("_at").alias("_first"), F.count("*").alias("_of"))
    placed = ranked.join(strata, F.col(stratum).eqNullSafe(F.col("_stratum"))).withColumn(
        "_share", (2 * (F.col("_at") - F.col("_first")) + 1) / (2 * F.col("_of"))
    )
    placed = placed.drop("_stratum", "_first", "_of", "_at")
    n = max(1, rows.count())
    ordered = numbered(placed, "_share", stratum, "_salt", key, *rest)
    shard = F.expr(f"(position * {shards}L) div {n}L")
    first = F.expr(f"(shard * {n}L + {shards - 1}L) div {shards}L")
    return (
        ordered.withColumn("shard", shard.cast("int"))
        .withColumn("slot", F.col("position") - first)
        .drop("_share", "_salt", "position")
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards under the law `rows`: counts of shards differ by one at most.

    Columns: doc_id, size (UTF-8 bytes, none for a null text, plus 16), text_crc32 (of a null
    text 0), law, shard, slot, grown_shard (null: the law isn't `key`), source.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    slim = docs.select(
        "doc_id",
        "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    out = interleave(slim, SHARDS)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source"
    )


#: crc32 is reckoned byte by byte with the table of its polynomial.
OP8_SQL = r"""
with poly as (
    select list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)), b)) as step),
docs as (
    select doc_id, source, coalesce(octet_length(encode(text)), 0) + 16 as size,
        list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: cast('0x' || x as bigint)) as bytes
    from documents),
slim as (
    select doc_id, source, size, xor(4294967295, list_reduce(bytes, lambda c, b: xor(c >> 8, step[xor(c & 255, b) + 1]), 4294967295)) as text_crc32,
        md5(concat_ws('|', '42', doc_id)) as salt
    from docs, poly),
ranked as (
    select *, (2 * (row_number() over (partition by source order by salt, doc_id nulls first, size, text_crc32) - 1) + 1)::double
        / (2 * count(*) over (partition by source)) as share
    from slim),
placed as (
    select *, row_number() over (order by share, source nulls first, salt, doc_id nulls first, size, text_crc32) - 1 as position,
        count(*) over () as n
    from ranked),
cut as (select *, (position * 40) // n as shard from placed)
select doc_id, size::bigint as size, text_crc32, 'rows' as law, shard::integer as shard,
    position - (shard * n + 39) // 40 as slot, null::integer as grown_shard, source
from cut
"""
