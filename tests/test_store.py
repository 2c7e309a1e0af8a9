import json

import pytest
from pyspark.sql import functions as F

from chunkloom.functions.hashing import blake3_many
from chunkloom.model import Policy
from chunkloom.operators import delta, ingest, packs, reports
from chunkloom.sources import containers, manifests, store
from chunkloom.streaming.sync import sync_stream
from tests.helpers import files


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / "store")


def test_store_files_round_trip(spark, root):
    bodies = {f"v{k}": b"A" * 3000 + bytes([k]) * 3 for k in range(3)}
    arts, chunks, objects = ingest.raw(files(spark, bodies), 4096, "blake3")
    ids = dict(zip(bodies, blake3_many(list(bodies.values())), strict=True))
    assert store.export_loose(objects, root, "zstd") == 3
    pairs = spark.createDataFrame([(0, ids["v0"], ids["v1"])], "pair long, left_id string, right_id string")
    reps = store.representations(spark, root)
    assert reps.where("kind = 'loose' and encoding = 'zstd'").count() == 3
    verdicts = delta.optimize(pairs, chunks, objects, reps.withColumn("stored_size", F.lit(3000).cast("long")), Policy())
    assert store.export_deltas(verdicts, root) == 1
    assert store.export_packs(packs.build(packs.encoded(objects.where(F.col("object") == ids["v2"]))), root) == 2
    kinds = {r.kind: r.n for r in store.representations(spark, root).groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert kinds == {"loose": 3, "delta": 1, "pack": 1, "pack_index": 1}
    got = {r.object: bytes(r.data) for r in store.objects(spark, root).collect()}
    assert got == {ids[n]: b for n, b in bodies.items()}
    again = packs.recompress(store.loose(spark, root).select("object", "stored"), "none")
    assert {len(r.stored) for r in again.collect()} == {3003}
    assert reports.breakdown(store.representations(spark, root)).first().loose_raw_bytes == 0


def test_manifests_are_saved_scanned_and_checked(spark, root, tmp_path):
    arts, chunks, _ = ingest.raw(files(spark, {"a": b"x" * 5000}), 4096)
    m = ingest.manifests(arts, chunks)
    row = json.loads(m.toJSON().first())
    (tmp_path / "store" / "manifests").mkdir(parents=True)
    (tmp_path / "store" / "manifests" / "good.JSON").write_text(json.dumps(row))
    assert manifests.scan(spark, root).count() == 1
    row["chunks"][1]["offset"] += 1
    (tmp_path / "store" / "manifests" / "bad.json").write_text(json.dumps(row))
    (tmp_path / "store" / "manifests" / "broken.json").write_text("{")
    sound, found = manifests.scan_tolerant(spark, root)
    assert sound.count() == 1 and {r.rule for r in found.collect()} == {"chunk_offset", "json"}
    with pytest.raises(Exception):  # noqa: B017
        manifests.scan(spark, root).collect()
    out = str(tmp_path / "saved")
    arts, chunks, _ = ingest.raw(files(spark, {f"f{k}": bytes([k]) * (k + 1) for k in range(9)}), 4)
    many = ingest.manifests(arts, chunks).coalesce(1)
    assert manifests.save(many, out) == 9
    assert manifests.save(many.limit(3).withColumn("source_name", F.lit("new")), out) == 3
    got = manifests.scan(spark, out)
    assert got.count() == 9 and got.where("source_name = 'new'").count() == 3
    assert "lineage" not in json.loads(spark.read.text(f"{out}/manifests").first()[0])
    with pytest.raises(ValueError, match="version"):
        manifests.save(many.withColumn("version", F.lit(2)), out)


def test_pointers(spark, tmp_path):
    root = tmp_path / ".hid"
    root.mkdir()
    for name in ("b/two.MVPTR", "one.mvptr", ".git/hidden.mvptr"):
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text(json.dumps({"version": 1, "artifact_id": "a" * 64, "logical_size": 3}))
    found = manifests.pointers(spark, str(root))
    assert [r.pointer for r in found.collect()] == ["b/two.MVPTR", "one.mvptr"]
    assert [r.more for r in manifests.advice(found, 1).collect()] == [1]
    with pytest.raises(ValueError):
        manifests.pointers(spark, str(root), 1)


def test_raw_files_and_hub_cache(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")
    assert [(r.source_name, bytes(r.body)) for r in containers.raw_files(spark, str(tmp_path)).collect()] == [("x.bin", b"abc")]
    base = "/c/models--org--m"
    rows = spark.createDataFrame([(f"{base}/snapshots/r1/f.bin", 1, None), (f"{base}/snapshots/r2/f.bin", 2, None), (f"{base}/refs/dev", 1, bytearray(b"r1\n"))], "path string, modified long, content binary")
    at = lambda revision=None: [r.snapshot for r in containers.hub_file(rows, "org/m", "f.bin", revision).collect()]
    assert (at(), at("r1"), at("dev"), at("nope")) == (["r2"], ["r1"], ["r1"], [])


def test_objects_are_put_once_and_streams_resume(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "objects")
    _, _, objects = ingest.raw(files(spark, {"a": b"1" * 10 + b"2" * 10}), 10)
    assert store.put_if_absent(objects.select("object", "data"), table).count() == 2
    assert store.put_if_absent(objects.select("object", "data"), table).count() == 0
    _, _, more = ingest.raw(files(spark, {"b": b"2" * 10 + b"3" * 10}), 10)
    more.select("object", "data").write.parquet(source)
    for _ in range(2):
        stream = spark.readStream.schema("object string, data binary").parquet(source)
        sync_stream(stream, table, str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(table).count() == 3


def test_scans_list_on_the_executors(spark, root, tmp_path):
    """The driver holds no listing: no plan of a scan reads the manifests' folder by Spark's readers; hidden names stay out."""
    arts, chunks, _ = ingest.raw(files(spark, {f"f{k}": bytes([k]) * (k + 1) for k in range(9)}), 4)
    assert manifests.save(ingest.manifests(arts, chunks), root) == 9
    folder = tmp_path / "store" / "manifests"
    (folder / "deep").mkdir()
    (folder / "deep" / "broken.JSON").write_text("{")
    (folder / "_hidden").mkdir()
    for name in ("_hidden/a.json", ".b.json", "c.txt"):
        (folder / name).write_text("{")
    sound, found = manifests.scan_tolerant(spark, root)
    assert sound.count() == 9 and [(r.path, r.rule) for r in found.collect()] == [(f"file:{folder}/deep/broken.JSON", "json")]
    assert not any("/manifests" in f for frame in (sound, found) for f in frame.inputFiles())
    (folder / "deep" / "broken.JSON").unlink()
    assert manifests.scan(spark, root).count() == 9
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        manifests.scan(spark, root + "-not-there").count()
