"""Connected components of an edge list, by alternating star contraction (no vertex or edge list leaves the cluster)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.llm.common import staged


def _least_neighbour(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours on the least one: the larger neighbours of every vertex, or the smaller ones and the vertex itself."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    around = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else down
    least = _least_neighbour(around)
    hung = around.join(least, "u")
    if large:
        out = hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = hung.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u long, v long) -> (node, root): every vertex of the edges with the least vertex that it reaches."""
    now = staged(edges.select("u", "v").where("u <> v"), "edges")
    seen = None
    while True:
        now = staged(_star(_star(now, large=True), large=False), "stars")
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select("v", "v").toDF("node", "root")).distinct()
