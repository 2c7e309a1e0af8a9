"""From bytes to artifacts, chunks and objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunkloom.functions.ranges import chunk_bodies, chunk_tensors, digest
from chunkloom.model import total


def raw(files: DataFrame, size: int, hash: str = "sha256") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(source_name, body) -> artifacts, chunks, objects. Files with equal bytes are one artifact, named by the last of them."""
    named = files.select(digest(F.col("body"), hash).alias("artifact_id"), "source_name", "body")
    once = named.groupBy("artifact_id").agg(F.max("source_name").alias("source_name"), F.first("body").alias("body"))
    arts = once.select("artifact_id", F.lit("raw").alias("format"), "source_name", F.octet_length("body").cast("long").alias("logical_size"), F.lit(size).cast("long").alias("chunk_size"))
    rows = chunk_bodies(once, size, hash, keep_data=True)
    return arts, rows.drop("data"), _objects(rows)


def containers(files: DataFrame, size: int, hash: str = "sha256") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Parsed containers (sources.containers.inspect) -> artifacts, chunks, tensors, objects. The header is a region of its own."""
    sound = files.withColumn("source_name", F.when(F.col("error").isNotNull(), F.raise_error(F.concat("source_name", F.lit(": "), "error"))).otherwise(F.col("source_name")))
    named = sound.withColumn("artifact_id", digest(F.col("body"), hash)).groupBy("artifact_id").agg(F.max(F.struct("source_name", "payload_start", "tensors", "body")).alias("f")).select("artifact_id", "f.*")
    arts = named.select("artifact_id", F.lit("safetensors").alias("format"), "source_name", F.octet_length("body").cast("long").alias("logical_size"), F.lit(size).cast("long").alias("chunk_size"))
    each = named.select("artifact_id", "body", F.posexplode("tensors").alias("ix", "t"))
    tensors = each.select("artifact_id", F.col("ix").cast("long").alias("tensor_ix"), "t.name", "t.dtype", "t.shape", "t.data_offset", "t.data_size")
    slice_ = lambda lo, n: F.substring(F.col("body"), lo.cast("int") + 1, n.cast("int"))
    header = named.select("artifact_id", F.lit(None).cast("string").alias("name"), F.lit(0).cast("long").alias("start"), slice_(F.lit(0), F.col("payload_start")).alias("payload"))
    parts = each.select("artifact_id", "t.name", F.col("t.data_offset").alias("start"), slice_(F.col("t.data_offset"), F.col("t.data_size")).alias("payload"))
    rows = chunk_tensors(header.unionByName(parts), size, hash, keep_data=True)
    return arts, rows.drop("data"), tensors, _objects(rows)


def _objects(rows: DataFrame) -> DataFrame:
    return rows.groupBy("object").agg(F.first("data").alias("data"), F.min("size").alias("size"))


def manifests(artifacts: DataFrame, chunks: DataFrame, tensors: DataFrame | None = None) -> DataFrame:
    """Nested manifests, chunks and tensors in order. Provenance and lineage are empty, as for any newly added artifact."""
    from chunkloom.model import LINEAGE, PROVENANCE

    listed = lambda t, by, names, to: t.groupBy("artifact_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(by, *names))), lambda x: F.struct(*(x[n].alias(n) for n in names))).alias(to))
    out = artifacts.join(listed(chunks, "chunk_ix", ("object", "offset", "size", "tensor"), "chunks"), "artifact_id", "left")
    if tensors is not None:
        out = out.join(listed(tensors, "tensor_ix", ("name", "dtype", "shape", "data_offset", "data_size"), "tensors"), "artifact_id", "left")
    else:
        out = out.withColumn("tensors", F.lit(None).cast("array<struct<name: string, dtype: string, shape: array<long>, data_offset: long, data_size: long>>"))
    none = F.lit(None).cast
    return out.select(F.lit(1).alias("version"), "artifact_id", "format", "source_name", "logical_size", "chunk_size", none(PROVENANCE).alias("provenance"), none(LINEAGE).alias("lineage"), F.coalesce("chunks", F.array().cast("array<struct<object: string, offset: long, size: long, tensor: string>>")).alias("chunks"), "tensors")


def first_occurrences(chunks: DataFrame, order: list[str]) -> DataFrame:
    """``chunks`` with new: whether no chunk before it, in this order of all artifacts, has its object."""
    return chunks.withColumn("new", F.row_number().over(Window.partitionBy("object").orderBy(*order)) == 1)


def ingest_totals(chunks: DataFrame, order: list[str]) -> DataFrame:
    """One row: bytes that were new and bytes reused when all chunks are put in order.

    Each object's first chunk is new, so sizes per object suffice and no order needs to be established.
    """
    per = chunks.groupBy("object").agg(F.min_by("size", F.struct(*order)).alias("first"), F.sum("size").alias("all"))
    return per.agg(total("first").alias("new_bytes"), total(F.col("all") - F.col("first")).alias("reused_bytes"), F.count("*").alias("new_objects"))
