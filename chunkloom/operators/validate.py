"""Structural checks of manifests and pointers: one row per violation, so that one bad record does not stop a scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunkloom.functions.scalars import is_object_id

MAX_OPERATION, MAX_NOTE = 64, 1024
U64_MAX = 2**64 - 1
_BIG = "decimal(38,0)"


def coverage(chunks: DataFrame, by: str = "artifact_id") -> DataFrame:
    """``chunks`` with expected_offset: the sum of the sizes before them in manifest order."""
    before = Window.partitionBy(by).orderBy("chunk_ix").rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn("expected_offset", F.coalesce(F.sum(F.col("size").cast(_BIG)).over(before), F.lit(0)).cast(_BIG))


def manifest_violations(manifests: DataFrame, key: str = "artifact_id") -> DataFrame:
    """(key, rule, detail) of manifests in their nested form; sizes may be decimals, so that overflow is a violation too."""
    rule = lambda name, bad, detail: F.when(bad, F.struct(F.lit(name).alias("rule"), detail.cast("string").alias("detail")))
    head = [
        rule("version", ~F.col("version").eqNullSafe(1), F.col("version")),
        rule("artifact_id", ~is_object_id(F.col("artifact_id")), F.col("artifact_id")),
        rule("chunk_size", F.coalesce(F.col("chunk_size") <= 0, F.lit(True)), F.col("chunk_size")),
    ]
    heads = manifests.select(F.col(key).alias("key"), F.explode(F.array_compact(F.array(*head))).alias("v")).select("key", "v.*")
    edges = manifests.select(F.col(key).alias("key"), "artifact_id", F.explode("lineage").alias("e"))
    checks = [
        rule("lineage_parent", ~is_object_id(F.col("e.parent_artifact_id")), F.col("e.parent_artifact_id")),
        rule("lineage_self", F.lower("e.parent_artifact_id") == F.lower("artifact_id"), F.col("e.parent_artifact_id")),
        rule("lineage_operation", F.coalesce(F.octet_length(F.trim("e.operation")), F.lit(0)).between(1, MAX_OPERATION) == F.lit(False), F.col("e.operation")),
        rule("lineage_note", F.octet_length("e.note") > MAX_NOTE, F.octet_length("e.note")),
    ]
    edges = edges.select("key", F.explode(F.array_compact(F.array(*checks))).alias("v")).select("key", "v.*")
    flat = manifests.select(F.col(key).alias("key"), F.posexplode("chunks").alias("chunk_ix", "c")).select("key", "chunk_ix", "c.*")
    flat = coverage(flat, "key")
    checks = [
        rule("chunk_size_zero", F.coalesce(F.col("size") <= 0, F.lit(True)), F.col("chunk_ix")),
        rule("chunk_object", ~is_object_id(F.col("object")), F.col("object")),
        rule("chunk_offset", ~F.col("offset").cast(_BIG).eqNullSafe(F.col("expected_offset")), F.col("chunk_ix")),
        rule("chunk_overflow", F.col("expected_offset") + F.col("size").cast(_BIG) > F.lit(str(U64_MAX)).cast(_BIG), F.col("chunk_ix")),
    ]
    parts = flat.select("key", F.explode(F.array_compact(F.array(*checks))).alias("v")).select("key", "v.*")
    total = F.aggregate(F.coalesce("chunks", F.array()), F.lit(0).cast(_BIG), lambda a, c: (a + F.coalesce(c["size"], F.lit(0)).cast(_BIG)).cast(_BIG))
    sums = manifests.select(F.col(key).alias("key"), rule("logical_size", ~F.col("logical_size").cast(_BIG).eqNullSafe(total), F.col("logical_size")).alias("v")).where("v is not null").select("key", "v.*")
    tensors = manifests.select(F.col(key).alias("key"), "logical_size", F.explode("tensors").alias("t"))
    over = F.col("t.data_offset").cast(_BIG) + F.col("t.data_size").cast(_BIG) > F.col("logical_size").cast(_BIG)
    tensors = tensors.select("key", rule("tensor_range", F.coalesce(over, F.lit(True)), F.col("t.name")).alias("v")).where("v is not null").select("key", "v.*")
    return heads.unionByName(edges).unionByName(parts).unionByName(sums).unionByName(tensors).withColumnRenamed("key", key)


def pointer_violations(pointers: DataFrame, manifests: DataFrame, folder: str = ".modelstore/manifests") -> DataFrame:
    """(pointer, rule) for pointers that do not agree with their manifest. ``pointers`` has a column ``pointer`` that names each.

    The manifest reference must be ``folder``/<artifact id>.json exactly, which rules out paths that lead elsewhere.
    Provenance and lineage are compared only where the pointer has them.
    """
    m = manifests.select(F.lower("artifact_id").alias("_id"), F.struct("format", "source_name", "logical_size", "provenance", "lineage").alias("m"))
    joined = pointers.join(m, F.lower("artifact_id") == F.col("_id"), "left")
    rules = {
        "version": ~F.col("version").eqNullSafe(1),
        "artifact_id": ~is_object_id(F.col("artifact_id")),
        "manifest_path": ~F.col("manifest").eqNullSafe(F.concat(F.lit(f"{folder}/"), F.lower("artifact_id"), F.lit(".json"))),
        "missing_manifest": F.col("m").isNull(),
        **{c: F.col("m").isNotNull() & ~F.col(c).eqNullSafe(F.col(f"m.{c}")) for c in ("logical_size", "format", "source_name")},
        "provenance": F.col("m").isNotNull() & F.col("provenance").isNotNull() & ~F.to_json("provenance").eqNullSafe(F.to_json("m.provenance")),
        "lineage": F.col("m").isNotNull() & (F.size(F.coalesce("lineage", F.array())) > 0) & ~F.to_json("lineage").eqNullSafe(F.to_json("m.lineage")),
    }
    return joined.select("pointer", F.explode(F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in rules.items())))).alias("rule"))
