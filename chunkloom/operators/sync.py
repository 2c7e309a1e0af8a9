"""Transfer of an artifact's objects to another store: what to copy, what is there already, and the totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunkloom.functions.ranges import digest
from chunkloom.model import total


def unique_tasks(chunks: DataFrame) -> DataFrame:
    """artifact_id, object, size, instances: each object once; an object with two sizes raises."""
    per = chunks.groupBy("artifact_id", "object").agg(F.min("size").alias("size"), F.max("size").alias("most"), F.count("*").alias("instances"))
    size = F.when(F.col("size") != F.col("most"), F.raise_error(F.concat(F.lit("sizes differ for object "), "object"))).otherwise(F.col("size"))
    return per.select("artifact_id", "object", size.alias("size"), "instances")


def sound(objects: DataFrame, hash: str = "sha256") -> DataFrame:
    """Ids of the objects (object, data) whose bytes have that id."""
    return objects.where(digest(F.col("data"), hash) == F.col("object")).select("object").distinct()


def plan(chunks: DataFrame, source: DataFrame, destination: DataFrame) -> DataFrame:
    """Per artifact and object: reuse it (sound at the destination), copy it, or fail (missing at the source too).

    source, destination: object, ids of sound objects there.
    """
    there = destination.select("object").distinct().withColumn("there", F.lit(True))
    here = source.select("object").distinct().withColumn("here", F.lit(True))
    joined = unique_tasks(chunks).join(there, "object", "left").join(here, "object", "left")
    action = F.when(F.col("there"), "reuse").when(F.col("here"), "copy").otherwise("missing")
    return joined.select("artifact_id", "object", "size", "instances", action.alias("action"))


def run_plan(planned: DataFrame) -> DataFrame:
    """``planned`` as a run of transfers in the order of artifact ids: what one copies is there for those after it."""
    order = Window.partitionBy("object").orderBy("artifact_id")
    again = (F.col("action") == "copy") & (F.row_number().over(order) > 1)
    return planned.withColumn("action", F.when(again, "reuse").otherwise(F.col("action")))


def totals(planned: DataFrame) -> DataFrame:
    """Per artifact: copied bytes count each object once, reused bytes every chunk that holds a reused object."""
    of = lambda action, value: total(F.when(F.col("action") == action, value).otherwise(0))
    again = F.col("size") * F.col("instances")
    return planned.groupBy("artifact_id").agg(
        of("copy", F.lit(1)).alias("objects_copied"), of("copy", F.col("size")).alias("bytes_copied"), of("reuse", F.lit(1)).alias("objects_reused"),
        of("reuse", again).alias("bytes_reused"), of("missing", F.lit(1)).alias("objects_missing"),
    )
