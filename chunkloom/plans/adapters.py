"""The driver's tables as artifacts, chunks, tensors and stores (text stands for the bytes of artifacts)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkloom.functions.ranges import chunk_bodies, chunk_tensors

CHUNK, CONTAINER_CHUNK, TENSOR_CHUNK = 256, 512, 64


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def doc_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, artifact_id: the artifact that each document's bytes are."""
    docs = read(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("artifact_id"))


def doc_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """artifact_id, last_doc, body: documents with equal bytes are one artifact."""
    docs = read(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.encode("text", "UTF-8").alias("body"))
    return docs.groupBy(F.sha2("body", 256).alias("artifact_id")).agg(F.max("doc_id").alias("last_doc"), F.first("body").alias("body"))


def artifacts(bodies: DataFrame) -> DataFrame:
    return bodies.select("artifact_id", F.lit("raw").alias("format"), F.col("last_doc").cast("string").alias("source_name"), F.octet_length("body").cast("long").alias("logical_size"), F.lit(CHUNK).cast("long").alias("chunk_size"))


def doc_chunks(bodies: DataFrame, keep_data: bool = False) -> DataFrame:
    return chunk_bodies(bodies, CHUNK, keep_data=keep_data)


def doc_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair, left_id, right_id: documents 2k and 2k + 1."""
    ids = doc_ids(spark, sf_dir).select((F.col("doc_id") / 2).cast("long").alias("pair"), (F.col("doc_id") % 2).alias("side"), "artifact_id")
    left, right = (ids.where(F.col("side") == s).select("pair", F.col("artifact_id").alias(n)) for s, n in ((0, "left_id"), (1, "right_id")))
    return left.join(right, "pair")


def conv_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """artifact_id, tensor_ix, name, payload, start: one container per conversation, one tensor per turn."""
    rows = read(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null")
    rows = rows.select(F.concat(F.lit("conv-"), "conv_id").alias("artifact_id"), "conv_id", "turn", F.concat_ws(".", "role", "turn").alias("name"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("payload"))
    order = Window.partitionBy("artifact_id").orderBy("turn", "name")
    start = F.coalesce(F.sum(F.octet_length("payload")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("start", start.cast("long")).withColumn("tensor_ix", F.row_number().over(order).cast("long") - 1)


def conv_tensors(parts: DataFrame) -> DataFrame:
    size = F.octet_length("payload").cast("long")
    return parts.select("artifact_id", "tensor_ix", "name", F.lit("U8").alias("dtype"), F.array(size).alias("shape"), F.col("start").alias("data_offset"), size.alias("data_size"))


def conv_chunks(parts: DataFrame) -> DataFrame:
    return chunk_tensors(parts, TENSOR_CHUNK)


def conv_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k and 2k + 1."""
    ids = read(spark, sf_dir, "conversations").select("conv_id").distinct().select((F.col("conv_id") / 2).cast("long").alias("pair"), (F.col("conv_id") % 2).alias("side"), F.concat(F.lit("conv-"), "conv_id").alias("id"))
    left, right = (ids.where(F.col("side") == s).select("pair", F.col("id").alias(n)) for s, n in ((0, "left_id"), (1, "right_id")))
    return left.join(right, "pair")


def piece_ranges(size):
    from chunkloom.functions.ranges import ranges

    return ranges(size, TENSOR_CHUNK)


def container_chunks(parts: DataFrame) -> DataFrame:
    """Chunks of whole containers that pay no heed to tensors (their object is their place)."""
    size = parts.groupBy("artifact_id").agg(F.sum(F.octet_length("payload")).cast("long").alias("n"))
    from chunkloom.functions.ranges import ranges

    each = size.select("artifact_id", F.posexplode(ranges(F.col("n"), CONTAINER_CHUNK)).alias("ix", "r"))
    return each.select("artifact_id", F.concat_ws("#", "artifact_id", F.col("ix")).alias("object"), F.col("ix").cast("long").alias("chunk_ix"), F.col("r.offset").alias("offset"), F.col("r.len").alias("size"))


def kept_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts of labelled documents: the manifests that a store has kept."""
    return doc_ids(spark, sf_dir).join(read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select("artifact_id").distinct()


def representations(chunks: DataFrame) -> DataFrame:
    """Stored forms by a rule on an object's first digits: 0-b loose, 8-f packed; of the loose ones, those with a second
    digit below 8 compressed to three quarters; f0 to f3 also as deltas on the least object before them in an artifact."""
    objects = chunks.groupBy("object").agg(F.min("size").alias("logical_size"))
    first, second = F.substring("object", 1, 1), F.substring("object", 2, 1)
    small = F.col("logical_size") - (F.col("logical_size") / 4).cast("long")
    none = F.lit(None).cast("string")
    zero = F.lit(0).cast("long")
    a = objects.where(first < "c").select("object", F.lit("loose").alias("kind"), F.when(second < "8", "zstd").otherwise("raw").alias("encoding"), F.when(second < "8", small).otherwise(F.col("logical_size")).alias("stored_size"), "logical_size", none.alias("base"), zero.alias("depth"))
    b = objects.where(first >= "8").select("object", F.lit("pack").alias("kind"), F.lit("raw").alias("encoding"), F.col("logical_size").alias("stored_size"), "logical_size", none.alias("base"), zero.alias("depth"))
    pairs = chunks.select("artifact_id", F.col("chunk_ix"), F.col("object").alias("base"))
    before = chunks.select("artifact_id", (F.col("chunk_ix") - 1).alias("chunk_ix"), "object").where((first == "f") & (second < "4")).join(pairs, ["artifact_id", "chunk_ix"]).where("base <> object")
    before = before.groupBy("object").agg(F.min("base").alias("base"))
    c = objects.join(before, "object").select("object", F.lit("delta").alias("kind"), F.lit("delta").alias("encoding"), (F.lit(77) + (F.col("logical_size") / 8).cast("long")).alias("stored_size"), "logical_size", "base", F.lit(1).cast("long").alias("depth"))
    return a.unionByName(b).unionByName(c)


def damaged(chunks: DataFrame) -> DataFrame:
    """object, data of a store that lost the objects 00.. and has other bytes for 01.. (``chunks`` with data)."""
    objects = chunks.where(~F.col("object").startswith("00")).groupBy("object").agg(F.first("data").alias("data"))
    return objects.withColumn("data", F.when(F.col("object").startswith("01"), F.concat("data", F.unhex(F.lit("00")))).otherwise(F.col("data")))


def lineage_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document n descends from document n div 2, by its language; operations repeat along the way."""
    docs = read(spark, sf_dir, "documents").where("doc_id > 0")
    return docs.select(F.col("doc_id").cast("string").alias("child_id"), (F.col("doc_id") / 2).cast("long").cast("string").alias("parent_id"), F.col("lang").alias("operation"), F.lit(None).cast("string").alias("note"))
