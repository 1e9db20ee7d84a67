"""Removal of repeated runs of three lines, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LINES = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def repeated_lines(docs: DataFrame, width: int = LINES) -> DataFrame:
    """(_row, covered): the positions (from 0) to remove from each row of `docs`, which has _row.

    Lines count without blanks at their ends. A run occurs first at the least (doc_id, _row,
    position), null ids last; every later one, in the same document too, covers its lines.
    """
    n = F.size("lines") - (width - 1)
    shifted = [F.slice("lines", k + 1, n).alias(f"l{k}") for k in range(width)]
    cut = docs.select("_row", "doc_id", _lines(F.col("text")).alias("lines")).where(n > 0)
    runs = cut.select("_row", "doc_id", F.posexplode(F.arrays_zip(*shifted)).alias("pos", "run"))
    bare = [F.trim(F.col(f"run.l{k}"), F.lit(" \t\r\x0b\f")) for k in range(width)]
    whole = F.concat_ws("\n", *bare)
    each = runs.where(F.length(F.concat(*bare)) > 0).select(
        "_row", F.col("doc_id").isNull().alias("_no"), "doc_id", "pos", F.unhex(F.md5(whole)).alias("h")
    )
    place = F.struct("_no", "doc_id", "_row", "pos")
    first = each.groupBy("h").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("h", "first")
    later = each.join(first, "h").where(~place.eqNullSafe(F.col("first")))
    covered = F.array_distinct(F.flatten(F.collect_list(F.sequence("pos", F.col("pos") + (width - 1)))))
    return later.groupBy("_row").agg(covered.alias("covered"))


def dedup_lines(docs: DataFrame, width: int = LINES) -> DataFrame:
    """`docs` with the lines of repeated runs removed from `text`, and with n_lines, n_removed.

    Runs of `width` consecutive lines that overlap are hashed; of equal runs anywhere in the
    table the first stays (by doc_id, nulls last, then row and position) and the lines of
    the others go, overlapping runs merged by position. Texts of fewer lines, empty texts
    and null texts (n_lines null) stay as they are; runs of blank lines alone count for
    nothing. Equal rows are told apart, so one of them stays whole. No rows: no rows.

    The frequent runs are counted with map-side combining; the side of the join that they
    heat is one that AQE can split. The work is linear in a text's lines. `docs` is read twice and its rows are known by
    partition and place: give a table or a checkpointed frame. Columns of its own names
    (_row, covered, n_lines, n_removed) are replaced; all others stay.
    """
    docs = docs.drop("_row", "covered", "n_lines", "n_removed")
    named = docs.withColumn("_row", F.monotonically_increasing_id())
    gone = repeated_lines(named.select("_row", "doc_id", "text"), width)
    lines = _lines(F.col("text"))
    out = named.join(gone, "_row", "left")
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "covered")
    # Both arrays are made once a text: a lambda that held their expressions would make them for each line.
    both = F.transform(F.array(F.struct(lines.alias("l"), places.alias("p"))), lambda x: F.transform(x["p"], lambda i: F.get(x["l"], i)))
    keep = F.get(both, F.lit(0))
    return out.select(
        *docs.columns[: docs.columns.index("text")],
        F.when(F.col("covered").isNull(), F.col("text")).otherwise(F.array_join(keep, "\n")).alias("text"),
        *docs.columns[docs.columns.index("text") + 1 :],
        F.when(F.col("text").isNotNull(), F.size(lines).cast("long")).alias("n_lines"),
        F.coalesce(F.size("covered"), F.lit(0)).cast("long").alias("n_removed"),
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of `documents`: doc_id, text without repeated runs of lines, n_lines, n_removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs)


OP5_SQL = r"""
with docs as (select doc_id, text, string_split(text, chr(10)) as ls from documents),
lines as (
    select doc_id, ls, unnest(ls) as line, generate_subscripts(ls, 1) as i from docs where text is not null),
bare as (select doc_id, i, line, trim(line, concat(' ', chr(9), chr(13), chr(11), chr(12))) as b from lines),
runs as (
    select doc_id, i, concat_ws(chr(10), b, b2, b3) as run from (
        select doc_id, i, b, lead(b) over w as b2, lead(b, 2) over w as b3 from bare
        window w as (partition by doc_id order by i))
    where b3 is not null and length(b || b2 || b3) > 0),
later as (
    select doc_id, i from (
        select doc_id, i, row_number() over (partition by run order by doc_id, i) as k from runs)
    where k > 1),
covered as (select distinct doc_id, i + d as i from later, (values (0), (1), (2)) as t(d)),
kept as (
    select b.doc_id, string_agg(b.line, chr(10) order by b.i) filter (where c.i is null) as text,
        count(*) as n_lines, count(c.i) as n_removed
    from bare b left join covered c on c.doc_id = b.doc_id and c.i = b.i group by b.doc_id)
select d.doc_id, case when d.text is null then null else coalesce(k.text, '') end as text, k.n_lines,
    coalesce(k.n_removed, 0) as n_removed
from docs d left join kept k on k.doc_id = d.doc_id
"""
