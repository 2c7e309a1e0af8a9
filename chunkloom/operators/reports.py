"""Storage, sharing and integrity reports over artifacts, chunks, objects and representations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.functions.codec import LEVEL, zstd_size
from chunkloom.functions.ranges import digest
from chunkloom.model import pct, saturating_sub, total

KINDS = ("loose_raw", "loose_compressed", "delta", "pack_data", "pack_index", "manifest", "metadata")


def dedup_totals(artifacts: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: artifacts, chunks, distinct objects, logical and unique bytes, and what deduplication saves."""
    objects = chunks.groupBy("object").agg(F.min("size").alias("size"), F.count("*").alias("n"))
    a = artifacts.agg(F.count("*").alias("artifacts"), total("logical_size").alias("logical_bytes"), F.lit(1).alias("one"))
    o = objects.agg(total("n").alias("chunks"), F.count("*").alias("objects"), total("size").alias("unique_logical_bytes"), F.lit(1).alias("one"))
    saved = saturating_sub(F.col("logical_bytes"), F.col("unique_logical_bytes"))
    return a.join(o, "one").drop("one").withColumn("dedup_savings_bytes", saved).withColumn("dedup_savings_pct", pct(F.col("dedup_savings_bytes"), F.col("logical_bytes")))


def full_sizes(objects: DataFrame, level: int = LEVEL) -> DataFrame:
    """object, size, full_size: the smaller of the raw and the compressed form of each object, made once for all reports."""
    return objects.select("object", "size", F.least(zstd_size(level, sized=False)("data"), F.col("size")).alias("full_size"))


def primary_sizes(full: DataFrame, representations: DataFrame) -> DataFrame:
    """``full`` with primary_size: the delta's size where an object has a smaller one."""
    delta = representations.where("kind = 'delta'").groupBy("object").agg(F.min("stored_size").alias("delta_size"))
    return full.join(delta, "object", "left").withColumn("primary_size", F.least("full_size", "delta_size")).drop("delta_size")


def efficiency(artifacts: DataFrame, chunks: DataFrame, sizes: DataFrame, reachable: DataFrame, storage: DataFrame) -> DataFrame:
    """One row: how deduplication, compression and deltas reduce the logical bytes to the physical ones.

    ``sizes``: object, size, full_size, primary_size. ``reachable``: object, including bases of deltas that no manifest
    names; these count in the primary bytes. ``storage``: storage_report().
    """
    refs = chunks.select("object").distinct().withColumn("named", F.lit(True))
    known = sizes.join(reachable.select("object").distinct(), "object").join(refs, "object", "left")
    named = F.coalesce("named", F.lit(False))
    sums = known.agg(*(total(F.when(named, F.col(c)).otherwise(0)).alias(n) for c, n in (("full_size", "full_encoded_bytes"),)), total("primary_size").alias("primary_encoded_bytes"), F.lit(1).alias("one"))
    s = storage.select("duplicate_representation_bytes", (F.col("pack_index_bytes") + F.col("manifest_bytes") + F.col("metadata_bytes")).alias("metadata_overhead_bytes"), F.col("physical_bytes").alias("actual_physical_bytes"), F.lit(1).alias("one"))
    out = dedup_totals(artifacts, chunks).withColumn("one", F.lit(1)).join(sums, "one").join(s, "one").drop("one")
    for name, a, b in (("compression_savings", "unique_logical_bytes", "full_encoded_bytes"), ("delta_savings", "full_encoded_bytes", "primary_encoded_bytes")):
        out = out.withColumn(f"{name}_bytes", saturating_sub(F.col(a), F.col(b))).withColumn(f"{name}_pct", pct(F.col(f"{name}_bytes"), F.col(a)))
    return out.withColumn("net_physical_savings_bytes", F.col("logical_bytes") - F.col("actual_physical_bytes")).withColumn("net_physical_savings_pct", pct(F.col("net_physical_savings_bytes"), F.col("logical_bytes")))


def attribution(artifacts: DataFrame, chunks: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per artifact: bytes only it has, bytes it shares with other artifacts (chunk instances), and its part of the physical bytes.

    ``sizes``: object, primary_size. An object that repeats inside one artifact only is exclusive.
    """
    held = chunks.groupBy("artifact_id", "object").agg(F.sum("size").alias("bytes"))
    refs = held.groupBy("object").agg(F.count("*").alias("refs"))
    weighed = held.join(refs, "object").join(sizes.select("object", "primary_size"), "object", "left")
    by_refs = weighed.groupBy("artifact_id", "refs").agg(F.sum("bytes").alias("bytes"), F.sum("primary_size").alias("physical"))
    sums = by_refs.groupBy("artifact_id").agg(
        total(F.when(F.col("refs") > 1, F.col("bytes")).otherwise(0)).alias("shared_bytes"), total(F.when(F.col("refs") == 1, F.col("bytes")).otherwise(0)).alias("exclusive_bytes"),
        F.round(F.sum(F.col("physical") / F.col("refs"))).cast("long").alias("attributed_physical_bytes"),
    )
    out = artifacts.select("artifact_id", "source_name", "logical_size").join(sums, "artifact_id", "left").na.fill(0)
    return out.withColumn("shared_pct", pct(F.col("shared_bytes"), F.col("logical_size")))


def analytics(artifacts: DataFrame, efficiency_row: DataFrame) -> DataFrame:
    """One row: the totals that go with attribution()."""
    out = efficiency_row.withColumnRenamed("logical_bytes", "total_logical_bytes").withColumnRenamed("actual_physical_bytes", "physical_bytes")
    return out.select("total_logical_bytes", F.col("unique_logical_bytes").alias("unique_logical_object_bytes"), "physical_bytes", "dedup_savings_bytes", "dedup_savings_pct", pct(F.col("physical_bytes"), F.col("total_logical_bytes")).alias("physical_ratio"))


def chunk_stats(artifacts: DataFrame, chunks: DataFrame, full: DataFrame | None = None) -> DataFrame:
    """Per artifact: number, sum, least, largest, mean and exact median of chunk sizes, repeats inside it, and, given ``full``
    (object, size, full_size), what compression saves on its distinct objects."""
    size = chunks.groupBy("artifact_id").agg(
        F.count("*").alias("chunks"), total("size").alias("logical_bytes"), F.min("size").alias("min_bytes"), F.max("size").alias("max_bytes"),
        F.avg("size").alias("average_bytes"), F.percentile("size", 0.5).alias("median_bytes"),
    )
    per = chunks.groupBy("artifact_id", "object").agg(F.count("*").alias("n"), F.min("size").alias("size"))
    repeats = [total(F.col("n") - 1).alias("exact_duplicate_chunks"), total((F.col("n") - 1) * F.col("size")).alias("exact_duplicate_bytes")]
    if full is not None:
        per = per.join(full.select("object", "full_size"), "object")
        smaller = F.col("full_size") < F.col("size")
        repeats += [
            total(F.when(smaller, 1).otherwise(0)).alias("compressed_smaller_chunks"), total(F.when(smaller, 0).otherwise(1)).alias("raw_preferred_chunks"),
            total("full_size").alias("full_encoded_bytes"), pct(saturating_sub(F.sum("size"), F.sum("full_size")), F.sum("size")).alias("compression_savings_pct"),
        ]
    return artifacts.select("artifact_id", "source_name").join(size, "artifact_id", "left").join(per.groupBy("artifact_id").agg(*repeats), "artifact_id", "left").na.fill(0)


def breakdown(representations: DataFrame) -> DataFrame:
    """One row: stored bytes by kind of file. Files that are not objects have the kinds pack_index, manifest and metadata."""
    kind = F.when(F.col("kind") == "loose", F.when(F.col("encoding") == "zstd", "loose_compressed").otherwise("loose_raw")).when(F.col("kind") == "pack", "pack_data").otherwise(F.col("kind"))
    named = representations.withColumn("_kind", kind)
    sums = named.agg(*(total(F.when(F.col("_kind") == k, F.col("stored_size")).otherwise(0)).alias(f"{k}_bytes") for k in KINDS))
    return sums.withColumn("physical_bytes", sum((F.col(f"{k}_bytes") for k in KINDS[1:]), F.col(f"{KINDS[0]}_bytes")))


def logical_objects(representations: DataFrame) -> DataFrame:
    """object, size: every stored object once; loose forms say more than deltas, and deltas more than pack entries."""
    order = F.when(F.col("kind") == "loose", 0).when(F.col("kind") == "delta", 1).otherwise(2)
    known = representations.where(F.col("kind").isin("loose", "delta", "pack"))
    return known.groupBy("object").agg(F.min_by("logical_size", order).alias("size"))


def orphans(representations: DataFrame, reachable: DataFrame) -> DataFrame:
    """object, size of stored objects that nothing reaches."""
    return logical_objects(representations).join(reachable.select("object").distinct(), "object", "left_anti")


def missing(representations: DataFrame, reachable: DataFrame) -> DataFrame:
    """Reachable objects that are not stored."""
    return reachable.select("object").distinct().join(logical_objects(representations), "object", "left_anti")


def gc_report(representations: DataFrame, reachable: DataFrame) -> DataFrame:
    """One row: orphans with their logical bytes, and those of them that a prune may remove (packed objects stay)."""
    packed = representations.where("kind = 'pack'").select("object").distinct().withColumn("packed", F.lit(True))
    rows = orphans(representations, reachable).join(packed, "object", "left")
    free = F.col("packed").isNull()
    return rows.agg(
        F.count("*").alias("orphan_objects"), total("size").alias("orphan_bytes"),
        total(F.when(free, 1).otherwise(0)).alias("removable_objects"), total(F.when(free, F.col("size")).otherwise(0)).alias("removable_bytes"),
    )


def storage_report(artifacts: DataFrame, representations: DataFrame, reachable: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row: what is stored, reached, orphaned (all its representations) and stored more than once.

    ``sizes``: object, size of reachable objects, named by a manifest or not.
    """
    reach = reachable.select("object").distinct().withColumn("reached", F.lit(True))
    per = representations.where(F.col("kind").isin("loose", "delta", "pack")).groupBy("object").agg(F.sum("stored_size").alias("stored"), F.min("stored_size").alias("least"))
    both = per.join(reach, "object", "full_outer").join(sizes.groupBy("object").agg(F.min("size").alias("size")), "object", "left")
    reached, stored = F.coalesce("reached", F.lit(False)), F.col("stored").isNotNull()
    pick = lambda when, value: total(F.when(when, value).otherwise(0))
    sums = both.agg(
        F.count("stored").alias("object_count"), pick(reached & stored, 1).alias("reachable_objects"), pick(reached, F.col("size")).alias("reachable_bytes"),
        pick(stored & ~reached, 1).alias("orphan_objects"), pick(stored & ~reached, F.col("stored")).alias("orphan_bytes"),
        pick(stored & reached, F.col("stored") - F.col("least")).alias("duplicate_representation_bytes"), F.lit(1).alias("one"),
    )
    a = artifacts.agg(F.count("*").alias("manifests"), total("logical_size").alias("logical_bytes"), F.lit(1).alias("one"))
    return a.join(sums, "one").join(breakdown(representations).withColumn("one", F.lit(1)), "one").drop("one")


def integrity(violations: DataFrame, manifests: DataFrame, reachable: DataFrame, representations: DataFrame, objects: DataFrame | None = None, hash: str = "sha256", key: str = "artifact_id") -> DataFrame:
    """One row: manifests scanned and sound, referenced, missing, corrupt and orphaned objects, and whether all is well.

    With ``objects`` (object, data; null data: unreadable) every reachable object is hashed again. Orphans do no harm.
    """
    bad = violations.select(key).distinct()
    scanned = manifests.agg(F.count("*").alias("manifests_scanned"), F.lit(1).alias("one"))
    errors = bad.agg(F.count("*").alias("manifests_bad"), F.lit(1).alias("one"))
    refs = reachable.select("object").distinct()
    out = scanned.join(errors, "one").withColumn("manifests_ok", F.col("manifests_scanned") - F.col("manifests_bad")).drop("manifests_bad")
    out = out.join(refs.agg(F.count("*").alias("referenced_objects"), F.lit(1).alias("one")), "one")
    out = out.join(missing(representations, refs).agg(F.count("*").alias("missing_objects"), F.lit(1).alias("one")), "one")
    if objects is None:
        out = out.withColumn("corrupt_objects", F.lit(0).cast("long"))
    else:
        corrupt = objects.join(refs, "object", "left_semi").where(~digest(F.col("data"), hash).eqNullSafe(F.col("object")))
        out = out.join(corrupt.select("object").distinct().agg(F.count("*").alias("corrupt_objects"), F.lit(1).alias("one")), "one")
    out = out.join(orphans(representations, refs).agg(F.count("*").alias("orphan_objects"), F.lit(1).alias("one")), "one").drop("one")
    return out.withColumn("ok", (F.col("manifests_ok") == F.col("manifests_scanned")) & (F.col("missing_objects") == 0) & (F.col("corrupt_objects") == 0))


def snapshot(efficiency_row: DataFrame) -> DataFrame:
    """A one-row summary that compare_snapshots() and a JSON file take."""
    return efficiency_row.select(F.lit(1).alias("format_version"), F.col("artifacts").alias("manifests"), *(c for c in efficiency_row.columns if c != "artifacts"))
