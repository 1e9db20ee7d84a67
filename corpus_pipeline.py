"""The corpus pipeline: each stage is given all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxtide.llm.common import new_folder
from boxtide.llm.decontamination import drop_contaminated
from boxtide.llm.language_id import NONE, predict, train
from boxtide.llm.line_dedup import dedup_lines
from boxtide.llm.packing import pack
from boxtide.llm.simhash import simhash_groups
from boxtide.session import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Under this probability of its likeliest language a document is rejected.
LEAST_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, null and empty ones too, and those of no language that the model tells from the others.

    Each row is judged by its text alone: rows with null or tied ids, labels or sources are kept like others, repeated rows alike, and
    a very long text counts whole. Rows without a `lang` teach nothing; without any labelled row nothing can be told, so
    nothing is kept but of an empty table. Columns beside those of documents are dropped.
    """
    labelled = predict(docs.select(*COLUMNS), train(docs))
    return labelled.where((F.col("lang_pred") != NONE) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of runs of three lines leave the texts; documents of which nothing else is left go.

    The first occurrence is that of the least doc_id, null ids last, of tied ids that of the first row: of repeated rows one
    stays whole. Texts that lose nothing stay as they are, null, empty and very long ones too, with their own n_chars.
    """
    out = dedup_lines(docs.select(*COLUMNS))
    kept = out.where(F.col("n_removed").eqNullSafe(0) | (F.length(F.trim(F.col("text"))) > 0))
    text = F.col("text")
    return kept.select("doc_id", "text", "lang", "source", F.when(F.col("n_removed") > 0, F.length(text).cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, similarity 0.8) the first row stays.

    The first is that of the table's order, whatever its id: null and tied ids make no difference. Repeated rows are one group, as are all
    texts without a word, null and empty ones. Texts are compared whole.
    """
    named = docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id())
    groups = simhash_groups(named.select("_row", "text"), key="_row")
    return named.join(groups.where(F.col("_row") == F.col("component_id")).select("_row"), "_row").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of `benchmark` go.

    Each row is judged by its whole text: of repeated rows all go or none, null and empty texts hold nothing and stay,
    as do rows with null or tied ids. Without items all stay.
    """
    return drop_contaminated(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens.

    Null and empty texts are a piece of the end token alone; longer texts are cut into as many pieces as they need. Rows with null or tied ids
    and repeated rows have pieces of their own.
    """
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash", simhash),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: A classifier trained here, near-duplicate search and subword ids are not to be had in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again as the next one's."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        folder = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
