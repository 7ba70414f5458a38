"""The training-data pipeline: five stages over ``documents``, each written as Parquet and read by the next.

All stages take an empty table (and give one), very long texts, rows that repeat, null ids and further columns of any name;
all but the last return the columns that they got.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.llm import decontaminate, line_dedup, ngram_join, packing, quality_cnn
from foliograph.llm.common import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the convolutional network accepts. Null and empty texts have a score like any other and go or stay by it;
    equal texts share their fate; null ids are judged but never learned from."""
    return quality_cnn.accepted(docs, quality_cnn.fit(docs, table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that many documents share, but for one holder each.

    Null and empty texts stay as they are; a text that loses all its lines stays, empty. Rows that share an id count as one
    document, rows with a null id for nothing, and both stay. ``n_chars``, if there is one, follows the text.
    """
    cleaned = line_dedup.apply(docs)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return cleaned.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts linked by at least 80 % of their five-word shingles: that of the smallest id.

    Texts without words are alone in their class and stay; of rows that share an id the smallest stays; rows with a null id
    cannot stand for a class and stay.
    """
    return ngram_join.one_of_each(docs, percent=80, words=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found. Null and empty texts hold nothing and stay, as do null ids and repeated
    rows; null and empty items are not looked for."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, by bucket. Null and empty texts give the piece of the end id; rows are packed one by one,
    whatever their ids."""
    return packing.pack(docs, sparing=True)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", pack)]

#: The first stage's verdicts come from a trained network and the last needs a tokenizer: SQL cannot express the run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
