"""A corpus pipeline: quality, near-duplicates, mixture, packing. Each stage is one operator of the llm subpackage.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next stage's docs.
All stages but the last return the columns of documents.

Defined results of every stage. Null and empty texts: documents like others (one empty line to the classifier, all of them copies of
each other, no tokens to the mixture, one sequence position each in the packing). Very long texts: whole, as one row until the packing
cuts them. Rows with equal doc_id: told apart by their texts. Repeated rows: scored alike; one of them is left by near_duplicates.
Ties: to the smaller doc_id, nulls last. Null doc_id, source, lang: allowed. Empty table: no rows. Extra columns, whatever their
names: left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import mixing, packing, quality, simhash
from tallyspark.llm.common import bounded, fresh_path, written
from tallyspark.llm.queries import tokenizer_path
from tallyspark.plans.staging import intermediates

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier does not reject. It learns from all documents' labels that are not held out."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs.select(*COLUMNS), model).where(F.col("quality_score") >= quality.THRESHOLD).select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies (five-word shingles, likeness 0.8) one row: that of the smallest doc_id, ids that are null last.

    Rows go by id and text: of two texts with one doc_id only the copy goes, and of a row that repeats one stays.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(*COLUMNS, F.xxhash64(text).alias("copy"), F.octet_length(text).cast("long").alias("length"))
    classes = written(simhash.near_copies(docs).groupBy("doc_id", "copy", "length").agg(F.max("kept").alias("kept"), F.count("*").alias("n")), "classes")
    gone = written(classes.where("not kept").select(F.col("doc_id").alias("_id"), F.col("copy").alias("_copy")), "gone")
    again = written(classes.where("kept and n > 1").select(F.col("doc_id").alias("_id"), F.col("copy").alias("_copy")), "again")
    on = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("copy") == F.col("_copy"))
    left = rows.join(bounded(gone.unionByName(again)), on, "left_anti")
    once = rows.join(bounded(again), on, "left_semi").dropDuplicates(["doc_id", "copy", "length"])
    return left.unionByName(once).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture passes them: once at least, and rarer sources repeatedly."""
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' tokens in sequences of at most 2048."""
    return packing.pack(docs, tokenizer_path()).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", good_quality), ("near_duplicates", one_of_each), ("mixture", mixture), ("packing", packed)]

#: A chain of a learned model, hashed fingerprints and a tokenizer: no SQL. The tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, one after another."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        with intermediates():  # what a stage writes on its way goes when its result is written
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
