"""Comparisons of artifacts, for any number of pairs (pair, left_id, right_id) at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunkloom.model import pct, total


def sided(pairs: DataFrame, rows: DataFrame, side: str) -> DataFrame:
    """``rows`` of the pairs' left or right artifacts, with their pair."""
    return pairs.select("pair", F.col(f"{side}_id").alias("artifact_id")).join(rows, "artifact_id")


def sequences(rows: DataFrame) -> DataFrame:
    """pair, name, and a digest of the tensor's (object, size) sequence: a sum over positions, so no list is collected."""
    place = F.row_number().over(Window.partitionBy("pair", "name").orderBy("chunk_ix"))
    placed = rows.where("tensor is not null").withColumnRenamed("tensor", "name").withColumn("place", place)
    mark = lambda seed: F.sum(F.xxhash64(F.lit(seed), "place", "object", "size").cast("decimal(38,0)"))
    return placed.groupBy("pair", "name").agg(F.struct(F.count("*"), mark(1), mark(2)).alias("sequence"))


def tensor_diff(pairs: DataFrame, tensors: DataFrame, chunks: DataFrame) -> DataFrame:
    """pair, name, status, left_bytes, right_bytes, shared_bytes of every tensor of either side.

    An unchanged tensor (same type, shape and chunk sequence) shares all its bytes; a changed one shares the right
    chunks whose object the tensor of that name has on the left; chunks outside of tensors take no part.
    """
    sides = {}
    for side in ("left", "right"):
        own = sided(pairs, chunks, side)
        t = sided(pairs, tensors, side).join(sequences(own), ["pair", "name"], "left")
        sides[side] = t.select("pair", "name", F.struct("dtype", "shape", "sequence").alias(f"{side}_form"), F.col("data_size").alias(f"{side}_size"))
    left_objects = sided(pairs, chunks, "left").where("tensor is not null").select("pair", "tensor", "object").distinct()
    common = sided(pairs, chunks, "right").join(left_objects, ["pair", "tensor", "object"], "left_semi")
    common = common.groupBy("pair", F.col("tensor").alias("name")).agg(F.sum("size").alias("common"))
    joined = sides["left"].join(sides["right"], ["pair", "name"], "full_outer").join(common, ["pair", "name"], "left")
    status = (
        F.when(F.col("left_form").isNull(), "added").when(F.col("right_form").isNull(), "removed")
        .when(F.col("left_form").eqNullSafe(F.col("right_form")), "unchanged").otherwise("changed")
    )
    out = joined.withColumn("status", status)
    shared = F.when(F.col("status") == "unchanged", F.col("right_size")).when(F.col("status") == "changed", F.coalesce("common", F.lit(0))).otherwise(0)
    right = F.when(F.col("status") == "removed", 0).otherwise(F.col("right_size"))
    return out.select("pair", "name", "status", F.coalesce("left_size", F.lit(0)).cast("long").alias("left_bytes"), right.cast("long").alias("right_bytes"), shared.cast("long").alias("shared_bytes"))


def diff_totals(diff: DataFrame) -> DataFrame:
    """Added, removed, changed and reused bytes and the tensors of each status, per pair."""
    of = lambda status, value: total(F.when(F.col("status") == status, value).otherwise(0))
    return diff.groupBy("pair").agg(
        *(of(s, F.lit(1)).alias(f"{s}_tensors") for s in ("added", "removed", "changed", "unchanged")),
        of("added", F.col("right_bytes")).alias("added_bytes"), of("removed", F.col("left_bytes")).alias("removed_bytes"),
        of("changed", F.col("right_bytes") - F.col("shared_bytes")).alias("changed_bytes"), total("shared_bytes").alias("reused_bytes"),
    )


def reuse(pairs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per pair: right chunks and bytes whose object the left side has (every instance counts), right-only bytes, reuse in percent."""
    left = sided(pairs, chunks, "left").select("pair", "object").distinct().withColumn("hit", F.lit(True))
    right = sided(pairs, chunks, "right").join(left, ["pair", "object"], "left")
    sums = right.groupBy("pair").agg(
        total(F.when(F.col("hit"), 1).otherwise(0)).alias("shared_chunks"), total(F.when(F.col("hit"), F.col("size")).otherwise(0)).alias("shared_bytes"), total("size").alias("right_bytes"),
    )
    full = pairs.select("pair").join(sums, "pair", "left").na.fill(0)
    return full.withColumn("right_only_bytes", F.col("right_bytes") - F.col("shared_bytes")).withColumn("reuse_pct", pct(F.col("shared_bytes"), F.col("right_bytes")))


def shared_objects(pairs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per pair: distinct objects on either side and on both, and the bytes of the common ones."""
    size = lambda side: sided(pairs, chunks, side).groupBy("pair", "object").agg(F.min("size").alias(f"{side}_size"))
    both = size("left").join(size("right"), ["pair", "object"], "full_outer")
    common = F.col("left_size").isNotNull() & F.col("right_size").isNotNull()
    return both.groupBy("pair").agg(
        F.count("left_size").alias("left_objects"), F.count("right_size").alias("right_objects"),
        total(F.when(common, 1).otherwise(0)).alias("shared_objects"), total(F.when(common, F.col("left_size")).otherwise(0)).alias("shared_bytes"),
    )


def aligned(pairs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Right chunks with the object of the left chunk of the same offset and size (null: none). A left range met twice counts last."""
    last = Window.partitionBy("pair", "offset", "size").orderBy(F.desc("chunk_ix"))
    left = sided(pairs, chunks, "left").withColumn("n", F.row_number().over(last)).where("n = 1").select("pair", "offset", "size", F.col("object").alias("left_object"))
    return sided(pairs, chunks, "right").join(left, ["pair", "offset", "size"], "left")


def alignment(pairs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per pair: right chunks, changed ones, comparable ones and incomparable bytes. Every changed instance counts."""
    rows = aligned(pairs, chunks)
    changed = F.col("left_object").isNotNull() & (F.col("left_object") != F.col("object"))
    sums = rows.groupBy("pair").agg(F.count("*").alias("right_chunks"), total(F.when(changed, 1).otherwise(0)).alias("changed_chunks"), total(F.when(F.col("left_object").isNull(), F.col("size")).otherwise(0)).alias("incomparable_bytes"))
    return pairs.select("pair").join(sums, "pair", "left").na.fill(0)


def delta_candidates(pairs: DataFrame, chunks: DataFrame) -> DataFrame:
    """pair, chunk_ix, target, base: changed right chunks, each target object once, at its first place."""
    rows = aligned(pairs, chunks).where("left_object is not null and left_object <> object")
    first = Window.partitionBy("pair", "object").orderBy("chunk_ix")
    return rows.withColumn("n", F.row_number().over(first)).where("n = 1").select("pair", "chunk_ix", F.col("object").alias("target"), F.col("left_object").alias("base"), "size")


def compare_snapshots(left: DataFrame, right: DataFrame) -> DataFrame:
    """Right minus left of two one-row snapshots' totals."""
    names = ("manifests", "objects", "logical_bytes", "unique_logical_bytes", "actual_physical_bytes", "net_physical_savings_bytes")
    l, r = (t.select(*(F.col(n).cast("decimal(38,0)").alias(f"{s}_{n}") for n in names), F.lit(1).alias("one")) for t, s in ((left, "l"), (right, "r")))  # noqa: E741
    return l.join(r, "one").select(*((F.col(f"r_{n}") - F.col(f"l_{n}")).cast("long").alias(f"{n}_delta") for n in names))


def positional(pairs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Right chunks with the object of the left chunk of the same place in the manifest and the same length (null: none)."""
    left = sided(pairs, chunks, "left").select("pair", "chunk_ix", "size", F.col("object").alias("left_object"))
    return sided(pairs, chunks, "right").join(left, ["pair", "chunk_ix", "size"], "left")


def markdown(pairs: DataFrame, artifacts: DataFrame, diff: DataFrame, everything: bool = False) -> DataFrame:
    """pair, part, name, line: the lines of a report for each pair, in the order of part and name.

    artifacts: artifact_id, source_name, logical_size, edges, provider. Parts 1 and 2 are the sides, 3 to 10 the totals,
    11 the tensors, without the unchanged ones unless ``everything``.
    """
    row = lambda side: F.format_string("| %s | `%s` | %s | %d | %d | %s |", F.lit(side.capitalize()), F.col("artifact_id"), F.col("source_name"), F.col("logical_size"), F.col("edges"), F.coalesce("provider", F.lit("none")))
    empty = F.lit("")
    out = None
    for part, side in ((1, "left"), (2, "right")):
        lines = sided(pairs, artifacts, side).select("pair", F.lit(part).alias("part"), empty.alias("name"), row(side).alias("line"))
        out = lines if out is None else out.unionByName(lines)
    named = (
        ("Unchanged", "unchanged_tensors"), ("Changed", "changed_tensors"), ("Added", "added_tensors"), ("Removed", "removed_tensors"),
        ("Reused right bytes", "reused_bytes"), ("Added bytes", "added_bytes"), ("Removed bytes", "removed_bytes"), ("Changed right bytes", "changed_bytes"),
    )
    each = F.array(*(F.struct(F.lit(3 + k).alias("part"), F.format_string(f"- {label}: %d", F.col(c)).alias("line")) for k, (label, c) in enumerate(named)))
    sums = diff_totals(diff).select("pair", F.explode(each).alias("x")).select("pair", "x.part", empty.alias("name"), "x.line")
    shown = diff if everything else diff.where("status <> 'unchanged'")
    share = F.bround(pct(F.col("shared_bytes"), F.col("right_bytes")), 2)
    line = F.format_string("| %s | %s | %d | %.2f%% |", F.col("name"), F.col("status"), F.col("right_bytes"), share)
    return out.unionByName(sums).unionByName(shown.select("pair", F.lit(11).alias("part"), "name", line.alias("line")))
