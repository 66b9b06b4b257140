"""A corpus from documents: toxic ones go, boilerplate lines go, one of each group of near copies
stays, contaminated ones go, and what is left is encoded as SentencePiece ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namewright.llm import decontaminate, linededup, sentencepieces, similar, toxicity
from namewright.llm.common import scratch, table
from namewright.plans.session import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject_toxic(docs, table(ship(spark), sf_dir, "labels")).select(COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = linededup.strip_boilerplate(docs)
    changed = F.col("n_removed") > 0
    return cut.withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Groups are linked at a similarity of 0.8 of 5-word shingles; one row of each group stays, that of
    its smallest id (a null id only where no other is there)."""
    ship(spark)
    return similar.one_of_each(docs).select(COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, table(ship(spark), sf_dir, "benchmark")).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return sentencepieces.encode_documents(docs).withColumnRenamed("id", "doc_id")


STAGES = [("toxicity", toxic), ("line dedup", lines), ("SimHash near-dedup", near_copies), ("benchmark decontamination", benchmark), ("SentencePiece encoding", encode)]

#: A classifier, sketches and merges by rank are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents table, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
