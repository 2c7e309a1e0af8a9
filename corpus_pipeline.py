"""Quality filter, near and substring deduplication, mixing and packing of a corpus.

Each stage takes (spark, docs, sf_dir), where docs has the columns of documents, and its result is written as Parquet
and read again as the docs of the next. All stages but the last return those columns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.deploy import prepared
from chunkloom.llm import mixing, near_copies, packing, quality_classifier, substring_dedup
from chunkloom.llm.common import crc_bucket, read, shared_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
KEEP_FROM = 0.7


@prepared
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier scores below KEEP_FROM."""
    labels = read(spark, sf_dir, "labels").where(crc_bucket("doc_id", 4) != 2)
    model = quality_classifier.learn(docs, labels)
    return quality_classifier.score(docs.select(*COLUMNS), model).where(F.col("quality_score") >= KEEP_FROM).select(*COLUMNS)


@prepared
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id."""
    return near_copies.keep_one(docs.select(*COLUMNS))


@prepared
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier place has; documents of which nothing is left go."""
    cut = substring_dedup.remove_repeats(docs.select(*COLUMNS)).where("n_removed = 0 or n_removed < n_words")
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@prepared
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.emit(mixing.mix_sources(docs.select(*COLUMNS))).select(*COLUMNS)


@prepared
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.packed(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixture", mixture),
    ("packing", packed),
]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


@prepared
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}-{name}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs
