import pytest
from pyspark.sql import functions as F

from chunkloom.functions.hashing import blake3_many
from chunkloom.functions.scalars import artifact_format, target_path
from chunkloom.model import Policy
from chunkloom.operators import delta, ingest, maintenance, packs, reports
from chunkloom.sources import manifests, store
from tests.helpers import files


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / "store")


def versions(spark, n=4, size=65536):
    """Artifacts of one chunk each, every one two bytes away from the one before."""
    body, bodies = bytearray(b"1" * size), {}
    for k in range(n):
        body[100 + k], body[size // 2 + k] = 50 + k, 60 + k
        bodies[f"v{k}"] = bytes(body)
    arts, chunks, objects = ingest.raw(files(spark, bodies), size, "blake3")
    return dict(zip(bodies, blake3_many(list(bodies.values())), strict=True)), arts, chunks, objects


def test_a_chain_of_versions_in_one_call_stops_at_the_depth(spark):
    ids, _, chunks, objects = versions(spark)
    pairs = spark.createDataFrame([(k, ids[f"v{k}"], ids[f"v{k + 1}"]) for k in range(3)], "pair long, left_id string, right_id string")
    reps = objects.select("object", F.lit("loose").alias("kind"), F.col("size").alias("stored_size"), F.lit(None).cast("string").alias("base"), F.lit(0).cast("long").alias("depth"))
    got = [(r.pair, r.stored, r.depth, r.reason) for r in delta.optimize(pairs, chunks, objects, reps, Policy()).orderBy("pair").collect()]
    assert got == [(0, True, 1, None), (1, True, 2, None), (2, False, 3, "depth")]
    back = spark.createDataFrame([(0, ids["v0"], ids["v1"]), (1, ids["v1"], ids["v0"])], "pair long, left_id string, right_id string")
    verdicts = delta.optimize(back, chunks, objects, reps, Policy()).orderBy("pair").collect()
    assert [(r.stored, r.reason) for r in verdicts] == [(True, None), (False, "cycle")]
    made = delta.optimize(pairs, chunks, objects, reps, Policy()).where("stored").select(F.col("target").alias("object"), "base", "depth", "record")
    rebuilt = delta.reconstruct(objects.where(F.col("object") == ids["v0"]).select("object", "data"), made, "blake3")
    assert rebuilt.count() == 2 and rebuilt.where("not ok").isEmpty()


def test_optimize_keeps_the_smaller_form_and_loses_nothing(spark, root):
    ids, _, chunks, objects = versions(spark, 2)
    store.export_loose(objects, root)
    pairs = spark.createDataFrame([(0, ids["v0"], ids["v1"])], "pair long, left_id string, right_id string")
    store.export_deltas(delta.optimize(pairs, chunks, objects, store.representations(spark, root), Policy()), root)
    dry = maintenance.optimize(spark, root).first()
    assert store.representations(spark, root).count() == 3
    assert maintenance.optimize(spark, root, dry_run=False).first() == dry
    kinds = sorted(r.kind for r in store.representations(spark, root).where("object is not null").collect())
    assert len(kinds) == 2 and "loose" not in kinds
    assert {r.object for r in store.objects(spark, root).where("data is not null").collect()} == set(ids.values())


def test_recompress_and_repack_report(spark, root):
    _, _, objects = ingest.raw(files(spark, {"a": b"A" * 9000}), 4096, "blake3")
    store.export_loose(objects, root)
    r = maintenance.recompress(spark, root, "zstd").first()
    assert (r.rewritten, r.damaged, r.before_bytes) == (2, 0, 4096 + 808) and r.after_bytes < 200
    assert {x.encoding for x in store.representations(spark, root).collect()} == {"zstd"}
    assert maintenance.repack(spark, root, prune_loose=True).first().pruned == 2
    assert maintenance.repack(spark, root, prune_loose=True).first().objects == 0
    assert maintenance.compact(spark, root, prune_old=True).first().pruned_packs == 1


def test_packs_end_by_size(spark):
    rows = spark.createDataFrame([(f"00{k:062x}", 40) for k in range(10)], "object string, stored_size long")
    got = {r.object[-1]: (r.pack, r.offset) for r in packs.layout(rows, pack_bytes=100).collect()}
    assert [got[f"{k:x}"] for k in range(6)] == [("00", 0), ("00", 40), ("00", 80), ("00-1", 0), ("00-1", 40), ("00-2", 0)]


def test_derive_refuses_cycles_and_saves(spark, root):
    arts, chunks, _ = ingest.raw(files(spark, {c: c.encode() * 9 for c in "abc"}), 4, "sha256")
    m = ingest.manifests(arts, chunks)
    ids = {r.source_name: r.artifact_id for r in arts.collect()}
    edge = lambda *e: spark.createDataFrame([(ids[a], ids[b], op, None) for a, b, op in e], "child_id string, parent_id string, operation string, note string")
    manifests.save(m, root)
    changed = manifests.derive(m, edge(("b", "a", " fine-tune "), ("c", "b", "quantize")), root, root)
    assert {r.source_name: [e.operation for e in r.lineage] for r in changed.collect()} == {"b": ["fine-tune"], "c": ["quantize"]}
    now = manifests.scan(spark, root)
    assert now.count() == 3 and manifests.pointers(spark, root).count() == 2
    with pytest.raises(ValueError, match="cycle"):
        manifests.derive(now, edge(("a", "c", "merge")), root)
    with pytest.raises(ValueError, match="cycle"):
        manifests.derive(m, edge(("a", "b", "x"), ("b", "a", "y")), root)


def test_audit_does_not_cut_a_listing_short(spark):
    listing = spark.createDataFrame([(f"objects/{k:02x}/{'0' * 62}", 1, b"x") for k in range(5)], "key string, size long, data binary")
    arts, chunks, _ = ingest.raw(files(spark, {"a": b"abc"}), 4)
    m = ingest.manifests(arts, chunks)
    assert maintenance.audit(listing, m, "sha256").first().orphan_objects == 5
    with pytest.raises(ValueError, match="keys"):
        maintenance.audit(listing, m, "sha256", max_keys=4)


def test_measured_sizes_are_those_of_the_codec(spark):
    import zstandard

    bodies = {"a": b"A" * 5000, "b": bytes(range(256)) * 4, "c": b"A" * 4096 + b"tail"}
    arts, chunks, objects = ingest.raw(files(spark, bodies), 4096)
    got = {r.object: r.full_size for r in reports.full_sizes(objects).collect()}
    want = {r.object: min(len(r.data), len(zstandard.ZstdCompressor(level=3, write_content_size=False).compress(bytes(r.data)))) for r in objects.collect()}
    assert got == want
    stats = {r.source_name: r for r in reports.chunk_stats(arts, chunks, reports.full_sizes(objects)).collect()}
    sizes = {r.object: r.size for r in objects.collect()}
    mine = [r.object for r in chunks.join(arts.where("source_name = 'a'"), "artifact_id").collect()]
    assert stats["a"].full_encoded_bytes == sum(want[o] for o in set(mine))
    assert stats["a"].compression_savings_pct == pytest.approx((sum(sizes[o] for o in set(mine)) - sum(want[o] for o in set(mine))) / sum(sizes[o] for o in set(mine)) * 100)


def test_paths_and_formats(spark):
    rows = spark.createDataFrame([("a/b", "x/M.SafeTensors", None), ("../b", "x.safetensors/y", "auto"), ("/r/../b", "m.bin", "safetensors"), ("/r/a/../b", "safetensors", None), ("", "a.safetensors", "raw")], "p string, n string, w string")
    got = [tuple(r) for r in rows.select(target_path("/r", F.col("p")), artifact_format(F.col("n"), F.col("w"))).collect()]
    assert got == [("/r/a/b", "safetensors"), (None, "raw"), (None, "safetensors"), ("/r/b", "raw"), (None, "raw")]
