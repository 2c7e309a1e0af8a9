"""A content-addressed store's files as tables: loose objects, deltas and packs, and writers for them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkloom.functions import codec
from chunkloom.functions.ranges import digest
from chunkloom.functions.scalars import little_endian
from chunkloom.model import HEX64, PACK_INDEX
from chunkloom.operators import delta, packs
from chunkloom.operators.lineage import cut
from chunkloom.sources.files import write_files

_HEX = "[0-9a-fA-F]"


def _files(spark: SparkSession, root: str, folder: str, pattern: str) -> DataFrame:
    """path, length, content below a folder; none if it is not there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{folder}")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(f"{root}/{folder}")


@F.pandas_udf(T.StructType([T.StructField("data", T.BinaryType()), T.StructField("encoding", T.StringType())]))
def _decode_loose(stored: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    def one(v: bytes) -> tuple:
        kind = "zstd" if bytes(v[:4]) == codec.LOOSE_MAGIC else "raw"
        try:
            return codec.decode_loose(bytes(v)), kind
        except Exception:  # noqa: BLE001  any damage makes the object unreadable
            return None, kind

    for part in stored:
        yield pd.DataFrame([one(v) for v in part], columns=["data", "encoding"])


def loose(spark: SparkSession, root: str) -> DataFrame:
    """object, stored, stored_size, data (null: damaged), encoding. Other names are ignored."""
    rows = _files(spark, root, "objects", "*").withColumn("object", F.regexp_extract("path", f"/objects/({_HEX}{{2}}/{_HEX}{{62}})$", 1)).where("object <> ''")
    rows = rows.select(F.lower(F.replace("object", F.lit("/"), F.lit(""))).alias("object"), F.col("content").alias("stored"), F.col("length").alias("stored_size"), _decode_loose("content").alias("d"))
    return rows.select("object", "stored", "stored_size", "d.data", "d.encoding")


def loose_sizes(spark: SparkSession, root: str) -> DataFrame:
    """object, encoding, stored_size, size: what the names and the first bytes of loose objects tell, nothing decoded."""
    rows = _files(spark, root, "objects", "*").withColumn("object", F.regexp_extract("path", f"/objects/({_HEX}{{2}}/{_HEX}{{62}})$", 1)).where("object <> ''")
    packed = F.substring(F.col("content"), 1, 4) == F.lit(codec.LOOSE_MAGIC)
    size = F.when(~packed, F.col("length")).when(F.col("length") >= 12, little_endian(F.substring(F.col("content"), 5, 8)).cast("long"))
    return rows.select(F.lower(F.replace("object", F.lit("/"), F.lit(""))).alias("object"), F.when(packed, "zstd").otherwise("raw").alias("encoding"), F.col("length").alias("stored_size"), size.alias("size"))


def delta_header(record: F.Column) -> F.Column:
    """base, depth and size of a delta record; null fields where it is malformed."""
    base = F.lower(F.substring(record, 5, 64).cast("string"))
    depth = F.conv(F.hex(F.substring(record, 69, 1)), 16, 10).cast("long")
    sound = (F.octet_length(record) >= codec.DELTA_HEADER) & (F.substring(record, 1, 4) == F.lit(codec.DELTA_MAGIC)) & base.rlike(HEX64) & (depth > 0)
    size = little_endian(F.substring(record, 70, 8)).cast("long")
    return F.struct(F.when(sound, base).alias("base"), F.when(sound, depth).alias("depth"), F.when(sound, size).alias("size"))


def deltas(spark: SparkSession, root: str) -> DataFrame:
    """object, record, stored_size, base, depth, size; null fields where the header is malformed."""
    rows = _files(spark, root, "deltas", "*.mvdelta").withColumn("object", F.regexp_extract("path", f"/deltas/({_HEX}{{2}}/{_HEX}{{62}})\\.mvdelta$", 1)).where("object <> ''")
    rows = rows.select(F.lower(F.replace("object", F.lit("/"), F.lit(""))).alias("object"), F.col("content").alias("record"), F.col("length").alias("stored_size"), delta_header(F.col("content")).alias("h"))
    return rows.select("object", "record", "stored_size", "h.*")


def pack_indexes(spark: SparkSession, root: str) -> DataFrame:
    rows = _files(spark, root, "packs", "*.idx.json")
    return rows.select(F.from_json(F.col("content").cast("string"), PACK_INDEX).alias("i"), "length").select("i.*", F.col("length").alias("index_size"))


def pack_bodies(spark: SparkSession, root: str) -> DataFrame:
    return _files(spark, root, "packs", "*.mvpack").select(F.element_at(F.split("path", "/"), -1).alias("pack_file"), F.col("content").alias("body"))


def representations(spark: SparkSession, root: str) -> DataFrame:
    """Every stored form of every object (see model), and the sizes of the other files by kind."""
    a = loose_sizes(spark, root).select("object", F.lit("loose").alias("kind"), "encoding", "stored_size", F.col("size").alias("logical_size"), F.lit(None).cast("string").alias("base"), F.lit(0).cast("long").alias("depth"))
    b = deltas(spark, root).select("object", F.lit("delta").alias("kind"), F.lit("delta").alias("encoding"), "stored_size", F.col("size").alias("logical_size"), "base", "depth")
    e = packs.entries(pack_indexes(spark, root)).where("error is null")
    c = e.select("object", F.lit("pack").alias("kind"), "encoding", "stored_size", F.col("size").alias("logical_size"), F.lit(None).cast("string").alias("base"), F.lit(0).cast("long").alias("depth"))
    other = None
    for kind, folder, pattern in (("pack_index", "packs", "*.idx.json"), ("manifest", "manifests", "*.json"), ("metadata", "", "repository.json")):
        rows = _files(spark, root, folder, pattern).select(F.lit(None).cast("string").alias("object"), F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("encoding"), F.col("length").alias("stored_size"), F.lit(None).cast("long").alias("logical_size"), F.lit(None).cast("string").alias("base"), F.lit(0).cast("long").alias("depth"))
        other = rows if other is None else other.unionByName(rows)
    return a.unionByName(b).unionByName(c).unionByName(other)


def objects(spark: SparkSession, root: str, hash: str = "blake3") -> DataFrame:
    """object, data: each object once, from its loose form, else its delta, else a pack (null data: unreadable)."""
    a = loose(spark, root).select("object", "data", F.lit(0).alias("order"))
    c = packs.read(pack_indexes(spark, root), pack_bodies(spark, root)).select("object", "data", F.lit(2).alias("order"))
    full = a.unionByName(c)
    base = full.where("data is not null").groupBy("object").agg(F.min_by("data", "order").alias("data"))
    b = delta.reconstruct(base, deltas(spark, root), hash).select("object", F.when(F.col("ok"), F.col("data")).alias("data"), F.lit(1).alias("order"))
    return full.unionByName(b).groupBy("object").agg(F.min_by("data", "order").alias("data"))


def put_if_absent(new: DataFrame, table: str, hash: str = "sha256") -> DataFrame:
    """Add the objects (object, data) that the Parquet table does not have soundly; returns object and size of what was written.

    The table is cut by the ids' first two digits. Only rows of the incoming ids are read and hashed again; where one is
    damaged, its part of the table is written anew without it. Incoming objects whose bytes do not have their id raise.
    """
    spark = new.sparkSession
    checked = F.when(digest(F.col("data"), hash).eqNullSafe(F.col("object")), F.col("data")).otherwise(F.raise_error(F.concat(F.lit("wrong bytes for object "), "object")))
    distinct = new.select("object", checked.alias("data")).groupBy("object").agg(F.first("data").alias("data")).withColumn("bucket", F.substring("object", 1, 2))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        fresh = cut(distinct)
        fresh.write.partitionBy("bucket").parquet(table)
        return fresh.select("object", F.octet_length("data").alias("size"))
    there = spark.read.schema("object string, data binary, bucket string").parquet(table)
    ids = distinct.select("object", "bucket")
    met = there.join(ids, ["object", "bucket"], "left_semi").select("object", "bucket", digest(F.col("data"), hash).eqNullSafe(F.col("object")).alias("sound"))
    state = cut(met.groupBy("object", "bucket").agg(F.max("sound").alias("sound"), F.min("sound").alias("clean")))
    fresh = cut(distinct.join(state.where("sound"), "object", "left_anti"))
    damaged = state.where("not clean").select("bucket").distinct()
    columns = ["object", "data", "bucket"]
    if not damaged.isEmpty():
        rows = there.join(damaged, "bucket", "left_semi").join(state.where("not clean").select("object", F.lit(True).alias("hit")), "object", "left")
        sound = rows.where(F.col("hit").isNull() | digest(F.col("data"), hash).eqNullSafe(F.col("object"))).select(*columns)
        anew = cut(sound.unionByName(fresh.join(damaged, "bucket", "left_semi").select(*columns)))
        anew.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(table)
    fresh.join(damaged, "bucket", "left_anti").select(*columns).write.mode("append").partitionBy("bucket").parquet(table)
    return fresh.select("object", F.octet_length("data").alias("size"))


def export_loose(objects_: DataFrame, root: str, compression: str = "none", level: int = codec.LEVEL) -> int:
    """Write objects as loose files."""

    @F.pandas_udf(T.BinaryType())
    def encode(values: pd.Series) -> pd.Series:
        return values.map(lambda v: codec.encode_loose(bytes(v), compression, level))

    from chunkloom.functions.scalars import object_path

    return write_files(objects_.select(object_path(F.col("object")), encode("data")), root)


def export_deltas(verdicts: DataFrame, root: str) -> int:
    """Write the accepted deltas of operators.delta.optimize() as files; their loose forms may go once these verify."""
    from chunkloom.functions.scalars import delta_path

    return write_files(verdicts.where("stored").select(delta_path(F.col("target")), "record"), root)


def export_packs(built: DataFrame, root: str) -> int:
    """Write packs of operators.packs.build(): the body first, then the index that makes it count."""
    body = built.select(F.concat(F.lit("packs/"), "pack_file"), "body")
    index = built.select(F.concat(F.lit("packs/"), F.regexp_replace("pack_file", r"\.mvpack$", ".idx.json")), F.col("index").cast("binary"))
    return write_files(body, root) + write_files(index, root)
