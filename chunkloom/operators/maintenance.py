"""Changes to a store's files: packing, compaction, the choice of representations, recompression and pruning.

Each writes its new files first, reads them back and checks them, and only then deletes what they replace; an interrupted
run leaves more files than needed, never fewer. ``root`` is the store's folder, ``hash`` the function that names objects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.functions import codec
from chunkloom.functions.scalars import canonical_key_id, delta_path, object_path
from chunkloom.model import PACK_INDEX, total
from chunkloom.operators import packs
from chunkloom.operators.lineage import cut
from chunkloom.sources import store
from chunkloom.sources.files import delete_files, write_files


def _readable(found: DataFrame) -> DataFrame:
    """``found`` (object, data), where an unreadable object is an error."""
    data = F.when(F.col("data").isNull(), F.raise_error(F.concat(F.lit("unreadable object "), "object"))).otherwise(F.col("data"))
    return found.select("object", data.alias("data"))


def _store_packs(built: DataFrame, root: str, hash: str) -> list[str]:
    """Write packs and check every entry from the files; returns their names."""
    built = cut(built)
    names = [r.pack_file for r in built.select("pack_file").collect()]
    store.export_packs(built, root)
    spark = built.sparkSession
    indexes = store.pack_indexes(spark, root).where(F.col("pack_file").isin(names))
    bad = packs.verify(indexes, store.pack_bodies(spark, root).where(F.col("pack_file").isin(names)), hash).where("error is not null").limit(1).collect()
    if bad:
        raise ValueError(f"pack {bad[0].pack_file}: {bad[0].object}: {bad[0].error}")
    return names


def _totals(rows: list[tuple], spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple(v for _, v in rows)], ", ".join(f"{k} long" for k, _ in rows))


def repack(spark: SparkSession, root: str, prune_loose: bool = False, hash: str = "blake3", pack_bytes: int = packs.PACK_BYTES) -> DataFrame:
    """Put the loose objects that no pack has into packs; with ``prune_loose`` their loose files go once the packs verify."""
    reps = cut(store.representations(spark, root))
    candidates = cut(packs.repack_candidates(reps))
    n = candidates.count()
    if n == 0:
        return _totals([("objects", 0), ("packs", 0), ("pruned", 0)], spark)
    mine = _readable(store.loose(spark, root).join(candidates, "object", "left_semi"))
    names = _store_packs(packs.build(packs.encoded(mine), pack_bytes=pack_bytes), root, hash)
    pruned = delete_files(candidates.select(object_path(F.col("object"))), root) if prune_loose else 0
    return _totals([("objects", n), ("packs", len(names)), ("pruned", pruned)], spark)


def compact(spark: SparkSession, root: str, prune_old: bool = False, prune_loose: bool = False, hash: str = "blake3", pack_bytes: int = packs.PACK_BYTES) -> DataFrame:
    """Put all objects, those of deltas included, into new packs; old packs, loose files and deltas go on demand."""
    objects = cut(_readable(store.objects(spark, root, hash)))
    reps = cut(store.representations(spark, root))
    old = [r.pack_file for r in store.pack_indexes(spark, root).select("pack_file").collect()]
    if objects.isEmpty():
        return _totals([("objects", 0), ("packs", 0), ("pruned_packs", 0), ("pruned_files", 0)], spark)
    names = _store_packs(packs.build(packs.encoded(objects), salt="compact-v1", pack_bytes=pack_bytes), root, hash)
    gone = [n for n in old if n not in names] if prune_old else []
    paths = [(f"packs/{x}",) for n in gone for x in (n.removesuffix(".mvpack") + ".idx.json", n)]
    pruned = delete_files(spark.createDataFrame(paths, "path string").coalesce(1), root) if paths else 0
    files = 0
    if prune_loose:
        files = delete_files(reps.where("kind = 'loose'").select(object_path(F.col("object"))), root) + delete_files(reps.where("kind = 'delta'").select(delta_path(F.col("object"))), root)
    return _totals([("objects", objects.count()), ("packs", len(names)), ("pruned_packs", pruned // 2), ("pruned_files", files)], spark)


def optimize(spark: SparkSession, root: str, dry_run: bool = True, hash: str = "blake3", level: int = codec.LEVEL) -> DataFrame:
    """Keep one form of each object: its delta where that is smaller than its pack entry, else a pack entry.

    Bases that a kept delta needs keep a full form. Without ``dry_run`` the packs are written and checked, and the other
    forms deleted.
    """
    objects = cut(_readable(store.objects(spark, root, hash)))
    reps = cut(store.representations(spark, root))
    packed = cut(packs.encoded(objects, level))
    choice = cut(packs.choose(reps, packed))
    report = packs.choose_totals(choice)
    if dry_run:
        return report
    old = [r.pack_file for r in store.pack_indexes(spark, root).select("pack_file").collect()]
    wanted = packed.join(choice.where("choice = 'pack'").select("object"), "object", "left_semi")
    names = _store_packs(packs.build(wanted, salt="optimize-v1"), root, hash) if not wanted.isEmpty() else []
    keep_delta = choice.where("choice = 'delta'").select("object")
    checked = store.objects(spark, root, hash).join(keep_delta, "object", "left_semi").where("data is null").limit(1).collect()
    if checked:
        raise ValueError(f"unreadable delta {checked[0].object}")
    delete_files(reps.where("kind = 'loose'").select(object_path(F.col("object"))), root)
    delete_files(reps.where("kind = 'delta'").join(keep_delta, "object", "left_anti").select(delta_path(F.col("object"))), root)
    gone = [(f"packs/{x}",) for n in old if n not in names for x in (n.removesuffix(".mvpack") + ".idx.json", n)]
    if gone:
        delete_files(spark.createDataFrame(gone, "path string").coalesce(1), root)
    return report


def recompress(spark: SparkSession, root: str, mode: str, level: int = codec.LEVEL, hash: str = "blake3") -> DataFrame:
    """Rewrite loose objects in another encoding; damaged ones stay as they are and are counted."""
    rows = cut(packs.recompress(store.loose(spark, root).select("object", "stored"), mode, level, hash))
    sound = rows.where("stored is not null")
    write_files(sound.select(object_path(F.col("object")), "stored"), root)
    return rows.agg(F.count("stored").alias("rewritten"), (F.count("*") - F.count("stored")).alias("damaged"), total("before").alias("before_bytes"), total(F.octet_length("stored")).alias("after_bytes"))


def collect_garbage(spark: SparkSession, root: str, reachable: DataFrame, prune: bool = False) -> DataFrame:
    """Orphans of a store with their logical bytes; with ``prune`` their loose files and deltas are deleted (packs stay)."""
    from chunkloom.operators import reports

    reps = cut(store.representations(spark, root))
    report = cut(reports.gc_report(reps, reachable))
    if prune:
        lost = cut(reports.orphans(reps, reachable).select("object"))
        for kind, path in (("loose", object_path), ("delta", delta_path)):
            delete_files(reps.where(F.col("kind") == kind).join(lost, "object", "left_semi").select(path(F.col("object"))), root)
    return report


def audit(listing: DataFrame, manifests: DataFrame, hash: str = "blake3", max_keys: int = 100_000, deep: bool = True) -> DataFrame:
    """Check a remote's objects against its manifests: one row.

    listing: key, size and, for a deep audit, data. Keys below objects/ that are not canonical are bad; a listing of more
    than ``max_keys`` keys is an error, never cut short.
    """
    from chunkloom.functions.ranges import digest
    from chunkloom.model import chunks

    n = listing.select("key").limit(max_keys + 1).count()
    if n > max_keys:
        raise ValueError(f"more than {max_keys} keys")
    named = listing.withColumn("object", canonical_key_id(F.col("key")))
    there = named.where("object is not null")
    refs = chunks(manifests).groupBy("object").agg(F.min("size").alias("wanted"))
    both = there.join(refs.withColumn("named", F.lit(True)), "object", "full_outer")
    stored, needed = F.col("key").isNotNull(), F.coalesce("named", F.lit(False))
    wrong = F.col("size") != F.col("wanted") if not deep else ~digest(F.col("data"), hash).eqNullSafe(F.col("object"))
    count = lambda c: total(F.when(c, 1).otherwise(0))
    sums = both.agg(
        count(stored).alias("objects"), count(needed).alias("referenced_objects"), count(needed & ~stored).alias("missing_objects"), count(needed & stored & wrong).alias("corrupt_objects"),
        count(stored & ~needed).alias("orphan_objects"), total(F.when(stored & ~needed, F.col("size")).otherwise(0)).alias("orphan_bytes"), F.lit(1).alias("one"),
    )
    bad = named.where(F.col("object").isNull() & F.col("key").contains("objects/")).agg(F.count("*").alias("bad_keys"), F.lit(1).alias("one"))
    out = sums.join(bad, "one").drop("one")
    return out.withColumn("ok", (F.col("missing_objects") == 0) & (F.col("corrupt_objects") == 0) & (F.col("bad_keys") == 0))
