"""Fixed-size and tensor-bounded chunk ranges of byte columns, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ranges(total: Column, size: int) -> Column:
    """array<struct<offset, len>> that covers ``total`` bytes; empty for none."""
    if size <= 0:
        raise ValueError("chunk size must be > 0")
    n, step = total.cast("long"), F.lit(size).cast("long")
    starts = F.sequence(F.lit(0).cast("long"), n - 1, step)
    some = F.transform(starts, lambda o: F.struct(o.alias("offset"), F.least(step, n - o).alias("len")))
    return F.when(n > 0, some).otherwise(F.slice(F.array(F.struct(F.lit(0).cast("long").alias("offset"), F.lit(0).cast("long").alias("len"))), 1, 0))


def digest(data: Column, hash: str = "sha256") -> Column:
    """The lower-case hex id of bytes."""
    if hash == "sha256":
        return F.sha2(data, 256)
    from chunkloom.functions.hashing import blake3_hex

    return blake3_hex(data)


def chunk_bodies(bodies: DataFrame, size: int, hash: str = "sha256", keep_data: bool = False) -> DataFrame:
    """(artifact_id, body binary) -> chunks, in parts of ``size`` bytes from the start. Empty bodies have no chunks."""
    each = bodies.select("artifact_id", "body", F.posexplode(ranges(F.octet_length("body"), size)).alias("ix", "r"))
    data = F.substring(F.col("body"), F.col("r.offset").cast("int") + 1, F.col("r.len").cast("int"))
    out = each.select("artifact_id", F.col("ix").cast("long").alias("chunk_ix"), F.col("r.offset").alias("offset"), F.col("r.len").alias("size"), F.lit(None).cast("string").alias("tensor"), data.alias("data"))
    out = out.withColumn("object", digest(F.col("data"), hash))
    return out if keep_data else out.drop("data")


def chunk_tensors(parts: DataFrame, size: int, hash: str = "sha256", keep_data: bool = False) -> DataFrame:
    """(artifact_id, name, start, payload) -> chunks that never cross a tensor's end; chunk_ix follows the offsets."""
    from pyspark.sql import Window

    each = parts.select("artifact_id", F.col("name").alias("tensor"), "start", "payload", F.explode(ranges(F.octet_length("payload"), size)).alias("r"))
    data = F.substring(F.col("payload"), F.col("r.offset").cast("int") + 1, F.col("r.len").cast("int"))
    out = each.select("artifact_id", (F.col("start") + F.col("r.offset")).alias("offset"), F.col("r.len").alias("size"), "tensor", data.alias("data"))
    out = out.withColumn("object", digest(F.col("data"), hash))
    out = out if keep_data else out.drop("data")
    return out.withColumn("chunk_ix", F.row_number().over(Window.partitionBy("artifact_id").orderBy("offset")).cast("long") - 1)
