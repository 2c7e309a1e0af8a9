"""Ancestry of artifacts: a graph of child -> parent edges, walked level by level.

Every walk is a loop of joins with the frontier; the paths or pairs found so far never leave the cluster. Levels are
written to the checkpoint folder, so that plans stay short and a lost executor costs one level at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.deploy import shared_dir

MAX_DEPTH, MAX_NODES, MAX_OPERATION, MAX_NOTE = 256, 100_000, 64, 1024


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder."""
    import uuid

    spark: SparkSession = df.sparkSession
    path = f"{shared_dir(spark)}/walk-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ancestry(edges: DataFrame, roots: DataFrame, known: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """The ancestry tree of every root: one row for each edge reached on a path.

    edges: child_id, parent_id, operation, note. roots: root_id. known: artifact_id, those with a manifest.
    Rows: root_id, depth, path (root first), node_id, operation, note, missing, cycle. Diamonds appear once per path;
    a node met again on its own path is a cycle and ends it; a missing node ends its path; edges below ``max_depth``
    are left out and mark their child truncated.
    """
    here = known.select(F.col("artifact_id").alias("node_id")).distinct().withColumn("there", F.lit(True))
    start = roots.select("root_id", F.lit(0).cast("long").alias("depth"), F.array("root_id").alias("path"), F.col("root_id").alias("node_id"))
    level = start.withColumn("operation", F.lit(None).cast("string")).withColumn("note", F.lit(None).cast("string")).withColumn("missing", F.lit(False)).withColumn("cycle", F.lit(False))
    levels = [cut(level)]
    edges = cut(edges.select("child_id", "parent_id", "operation", "note"))
    outgoing = edges.select(F.col("child_id").alias("node_id"), F.col("parent_id").alias("next_id"), F.col("operation").alias("next_operation"), F.col("note").alias("next_note"))
    while True:
        open_ = levels[-1].where("not missing and not cycle").select("root_id", "depth", "path", "node_id")
        step = open_.where(F.col("depth") < max_depth).join(outgoing, "node_id")
        step = step.select(
            "root_id", (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("next_id")).alias("path"), F.col("next_id").alias("node_id"),
            F.col("next_operation").alias("operation"), F.col("next_note").alias("note"), F.array_contains("path", F.col("next_id")).alias("cycle"),
        )
        step = cut(step.join(here, "node_id", "left").withColumn("missing", F.col("there").isNull()).select(*levels[0].columns))
        if step.isEmpty():
            break
        levels.append(step)
    out = levels[0]
    for step in levels[1:]:
        out = out.unionByName(step)
    more = edges.select(F.col("child_id").alias("node_id")).distinct().withColumn("more", F.lit(True))
    truncated = (F.col("depth") >= max_depth) & F.coalesce("more", F.lit(False)) & ~F.col("missing") & ~F.col("cycle")
    return out.join(more, "node_id", "left").withColumn("truncated", truncated).select(*levels[0].columns, "truncated")


def closure(edges: DataFrame, start: DataFrame, max_nodes: int | None = None) -> DataFrame:
    """(root_id, node_id): all ancestors of each root, each once (the root itself included), whatever the number of paths."""
    seen = cut(start.select("root_id", F.col("root_id").alias("node_id")).distinct())
    frontier = seen
    outgoing = cut(edges.select(F.col("child_id").alias("node_id"), "parent_id").distinct())
    while True:
        step = frontier.join(outgoing, "node_id").select("root_id", F.col("parent_id").alias("node_id")).distinct()
        frontier = cut(step.join(seen, ["root_id", "node_id"], "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
        if max_nodes is not None and not seen.groupBy("root_id").count().where(F.col("count") > max_nodes).isEmpty():
            raise ValueError(f"lineage exceeds {max_nodes} nodes")


def would_cycle(edges: DataFrame, proposed: DataFrame, max_nodes: int | None = MAX_NODES) -> DataFrame:
    """``proposed`` (child_id, parent_id, ..) with cycle: whether the child is the parent or one of its ancestors."""
    above = closure(edges, proposed.select(F.col("parent_id").alias("root_id")).distinct(), max_nodes)
    hit = above.select(F.col("root_id").alias("parent_id"), F.col("node_id").alias("child_id")).withColumn("cycle", F.lit(True))
    return proposed.join(hit, ["child_id", "parent_id"], "left").withColumn("cycle", F.coalesce("cycle", F.lit(False)))


def insert_edges(edges: DataFrame, proposed: DataFrame) -> DataFrame:
    """The edges of ``proposed`` that are new: trimmed, lower-cased parents, and not there already with the same note.

    Invalid operations or notes raise; cycles are checked by would_cycle() before.
    """
    operation = F.trim("operation")
    bad = F.coalesce(F.octet_length(operation), F.lit(0)).between(1, MAX_OPERATION) == F.lit(False)
    checked = F.when(bad, F.raise_error(F.lit("operation must have 1 to 64 bytes"))).otherwise(operation)
    note = F.when(F.octet_length("note") > MAX_NOTE, F.raise_error(F.lit("note exceeds 1024 bytes"))).otherwise(F.col("note"))
    clean = proposed.select("child_id", F.lower("parent_id").alias("parent_id"), checked.alias("operation"), note.cast("string").alias("note")).distinct()
    same = [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in ("child_id", "parent_id", "operation", "note")]
    return clean.alias("n").join(edges.alias("o"), same, "left_anti")


def tree_lines(tree: DataFrame) -> DataFrame:
    """root_id, path and whether a node is the last of its siblings, as a printer of the tree needs it."""
    from pyspark.sql import Window

    siblings = Window.partitionBy("root_id", F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(1)))).orderBy("operation", "node_id")
    return tree.where("depth > 0").withColumn("last", F.lead("node_id").over(siblings).isNull())
