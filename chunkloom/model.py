"""Record types and the flat frames that the operators work on.

=============== ======================================================================================
artifacts       artifact_id, format, source_name, logical_size, chunk_size
chunks          artifact_id, chunk_ix, object, offset, size, tensor (chunk_ix: position in the manifest)
tensors         artifact_id, tensor_ix, name, dtype, shape, data_offset, data_size
lineage_edges   child_id, parent_id, operation, note
objects         object, data, size
representations object, kind (loose, delta, pack), encoding, stored_size, logical_size, base, depth, location
=============== ======================================================================================
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEX64 = "^[0-9a-fA-F]{64}$"
HASHES = ("blake3", "sha256")

PROVENANCE = T.StructType([T.StructField(n, T.StringType()) for n in ("provider", "namespace", "repository", "model_name", "requested_revision", "resolved_revision", "filename", "source_uri")])
LINEAGE = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("parent_artifact_id", "operation", "note")]))
#: Sizes are unsigned 64-bit numbers in the files; they are read as decimals and become longs once validated.
U64 = T.DecimalType(20, 0)


def _fields(spec: list[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in spec])


def manifest_schema(number: T.DataType = U64) -> T.StructType:
    chunk = _fields([("object", T.StringType()), ("offset", number), ("size", number), ("tensor", T.StringType())])
    tensor = _fields([("name", T.StringType()), ("dtype", T.StringType()), ("shape", T.ArrayType(T.LongType())), ("data_offset", number), ("data_size", number)])
    return _fields([
        ("version", T.IntegerType()), ("artifact_id", T.StringType()), ("format", T.StringType()), ("source_name", T.StringType()), ("logical_size", number),
        ("chunk_size", number), ("provenance", PROVENANCE), ("lineage", LINEAGE), ("chunks", T.ArrayType(chunk)), ("tensors", T.ArrayType(tensor)),
    ])


MANIFEST = manifest_schema()
POINTER = _fields([
    ("version", T.IntegerType()), ("artifact_id", T.StringType()), ("format", T.StringType()), ("logical_size", U64), ("manifest", T.StringType()),
    ("source_name", T.StringType()), ("provenance", PROVENANCE), ("lineage", LINEAGE),
])
_ENTRY = _fields([("id", T.StringType()), ("offset", T.LongType()), ("size", T.LongType()), ("stored_size", T.LongType()), ("encoding", T.StringType())])
PACK_INDEX = _fields([("version", T.IntegerType()), ("pack_file", T.StringType()), ("objects", T.ArrayType(_ENTRY))])


@dataclass(frozen=True)
class Policy:
    """How a store encodes new objects."""

    loose_compression: str = "none"
    zstd_level: int = 3
    delta_min_savings_pct: int = 20
    max_delta_depth: int = 2
    pack_format_version: int = 2
    object_hash: str = "blake3"
    version: int = 1

    def __post_init__(self) -> None:
        if self.version != 1 or self.object_hash not in HASHES or self.pack_format_version not in (1, 2):
            raise ValueError("unsupported store version")
        if self.loose_compression not in ("none", "zstd") or not -7 <= self.zstd_level <= 22:
            raise ValueError("unsupported compression")
        if not 0 <= self.delta_min_savings_pct <= 100 or not 1 <= self.max_delta_depth <= 255:
            raise ValueError("invalid delta policy")


def artifacts(manifests: DataFrame) -> DataFrame:
    return manifests.select(F.lower("artifact_id").alias("artifact_id"), "format", "source_name", F.col("logical_size").cast("long").alias("logical_size"), F.col("chunk_size").cast("long").alias("chunk_size"))


def chunks(manifests: DataFrame) -> DataFrame:
    each = manifests.select(F.lower("artifact_id").alias("artifact_id"), F.posexplode("chunks").alias("ix", "c"))
    return each.select("artifact_id", F.col("ix").cast("long").alias("chunk_ix"), F.lower("c.object").alias("object"), F.col("c.offset").cast("long").alias("offset"), F.col("c.size").cast("long").alias("size"), "c.tensor")


def tensors(manifests: DataFrame) -> DataFrame:
    each = manifests.select(F.lower("artifact_id").alias("artifact_id"), F.posexplode("tensors").alias("ix", "t"))
    return each.select("artifact_id", F.col("ix").cast("long").alias("tensor_ix"), "t.name", "t.dtype", "t.shape", F.col("t.data_offset").cast("long").alias("data_offset"), F.col("t.data_size").cast("long").alias("data_size"))


def lineage_edges(manifests: DataFrame) -> DataFrame:
    each = manifests.select(F.lower("artifact_id").alias("child_id"), F.explode("lineage").alias("e"))
    return each.select("child_id", F.lower("e.parent_artifact_id").alias("parent_id"), "e.operation", "e.note")


def pct(part: Column, whole: Column) -> Column:
    """Share in percent; 0 where the whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / whole.cast("double") * 100.0)


def saturating_sub(a: Column, b: Column) -> Column:
    return F.greatest(a - b, F.lit(0).cast("long"))


def total(column: Column | str) -> Column:
    """A sum that is 0 over no rows, as a long."""
    return F.coalesce(F.sum(column), F.lit(0)).cast("long")


def count_where(condition: Column) -> Column:
    return total(F.when(condition, 1).otherwise(0))
