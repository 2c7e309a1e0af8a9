import hashlib
import json
import struct

import pytest
from pyspark.sql import functions as F

from chunkloom.functions import codec
from chunkloom.functions.hashing import blake3_many
from chunkloom.model import PACK_INDEX, Policy
from chunkloom.operators import compare, delta, ingest, lineage, materialize, packs, reports, sync, validate
from chunkloom.sources import containers
from chunkloom.sources.manifests import Remotes
from tests.helpers import files, sha


def container(tensors: dict[str, bytes]) -> bytes:
    at, header = 0, {"__metadata__": {"format": "test"}}
    for name, data in tensors.items():
        header[name] = {"dtype": "U8", "shape": [len(data)], "data_offsets": [at, at + len(data)]}
        at += len(data)
    raw = json.dumps(header).encode()
    return struct.pack("<Q", len(raw)) + raw + b"".join(tensors.values())


def pair(spark, left: bytes, right: bytes):
    return spark.createDataFrame([(0, sha(left), sha(right))], "pair long, left_id string, right_id string")


def block(value: int, n: int = 4096) -> bytes:
    return bytes([value]) * n


def test_shared_and_exclusive_bytes(spark):
    arts, chunks, _ = ingest.raw(files(spark, {"a": block(1) + block(2), "b": block(1) + block(3)}), 4096)
    sizes = chunks.groupBy("object").agg(F.min("size").alias("primary_size"))
    got = {r.source_name: (r.shared_bytes, r.exclusive_bytes, r.attributed_physical_bytes, r.shared_pct) for r in reports.attribution(arts, chunks, sizes).collect()}
    assert got == {"a": (4096, 4096, 6144, 50.0), "b": (4096, 4096, 6144, 50.0)}


def test_repeats_inside_one_artifact_stay_exclusive(spark):
    arts, chunks, _ = ingest.raw(files(spark, {"a": block(1) * 4}), 4096)
    row = reports.attribution(arts, chunks, chunks.groupBy("object").agg(F.min("size").alias("primary_size"))).first()
    assert (row.shared_bytes, row.exclusive_bytes) == (0, 16384)
    stats = reports.chunk_stats(arts, chunks).first()
    assert (stats.chunks, stats.exact_duplicate_chunks, stats.exact_duplicate_bytes, stats.median_bytes) == (4, 3, 12288, 4096.0)


def test_equal_files_are_one_artifact(spark):
    arts, chunks, objects = ingest.raw(files(spark, {"x": block(0x31, 32768), "y": block(0x31, 32768), "empty": b""}), 4096)
    assert sorted((r.source_name, r.logical_size) for r in arts.collect()) == [("empty", 0), ("y", 32768)]
    assert chunks.count() == 8 and objects.count() == 1
    totals = reports.dedup_totals(arts, chunks).first()
    assert (totals.dedup_savings_bytes, totals.dedup_savings_pct) == (28672, 87.5)


def test_manifests_of_good_artifacts_have_no_violations_and_bad_ones_do(spark):
    arts, chunks, _ = ingest.raw(files(spark, {"a": block(1) + b"tail", "empty": b""}), 4096)
    m = ingest.manifests(arts, chunks)
    assert validate.manifest_violations(m).count() == 0
    huge = m.where("source_name = 'empty'").withColumn("logical_size", F.lit("18446744073709551615").cast("decimal(20,0)"))
    assert [r.rule for r in validate.manifest_violations(huge).collect()] == ["logical_size"]
    edge = "array(named_struct('parent_artifact_id', upper(artifact_id), 'operation', ' ', 'note', repeat('n', 1025)))"
    assert {r.rule for r in validate.manifest_violations(m.withColumn("lineage", F.expr(edge))).collect()} == {"lineage_self", "lineage_operation", "lineage_note"}


def test_diff_of_one_changed_tensor_and_header_chunks(spark):
    left, right = (container({"layer.bias": b"\2" * 40, "layer.weight": b"\1" * 80 + bytes([k])}) for k in (1, 2))
    _, chunks, tensors, _ = ingest.containers(containers.inspect(files(spark, {"l": left, "r": right})), 16)
    diff = {r.name: r.status for r in compare.tensor_diff(pair(spark, left, right), tensors, chunks).collect()}
    assert diff == {"layer.bias": "unchanged", "layer.weight": "changed"}
    totals = compare.diff_totals(compare.tensor_diff(pair(spark, left, right), tensors, chunks)).first()
    assert (totals.changed_bytes, totals.reused_bytes, totals.added_bytes) == (1, 40 + 80, 0)
    same = compare.reuse(pair(spark, left, left), chunks).first()
    assert (same.shared_bytes, same.reuse_pct) == (len(left), 100.0)


def test_containers_reject_what_is_malformed(spark):
    good = container({"a": b"123", "b": b"45"})
    header = lambda h: struct.pack("<Q", len(h)) + h
    bad = {
        "short": b"123", "long header": struct.pack("<Q", 1 << 40) + b"{}", "cut": struct.pack("<Q", 50) + b"{}", "gap": good + b"x",
        "reversed": header(b'{"a":{"dtype":"U8","shape":[1],"data_offsets":[3,1]}}') + b"abc", "outside": header(b'{"a":{"dtype":"U8","shape":[9],"data_offsets":[0,9]}}') + b"abc",
    }
    got = {r.source_name: r.error for r in containers.inspect(files(spark, {"good": good, **bad})).select("source_name", "error").collect()}
    assert got.pop("good") is None
    assert all(got.values()) and len(got) == len(bad)
    assert [t["name"] for t in containers.parse_header(container({"b": b"1", "a": b"2"}))["tensors"]] == ["a", "b"]


def test_selection_and_assembly_round_trip(spark):
    body = container({"encoder.a": b"a" * 32, "encoder.b": b"b" * 32, "head.weight": b"h" * 32})
    arts, chunks, tensors, objects = ingest.containers(containers.inspect(files(spark, {"m": body})), 16)
    assert materialize.bodies(arts, chunks, objects).first().ok
    assert materialize.verify(arts, chunks, objects).where("error is not null").count() == 0
    chosen = materialize.select_tensors(tensors, ["head.weight"], ["encoder.b"])
    assert [r.name for r in chosen.orderBy("selected_ix").collect()] == ["encoder.b", "head.weight"]
    made = bytes(materialize.assemble(chosen, chunks, objects).first().file)
    again = containers.parse_header(made)
    assert [(t["name"], made[t["data_offset"] : t["data_offset"] + t["data_size"]]) for t in again["tensors"]] == [("encoder.b", b"b" * 32), ("head.weight", b"h" * 32)]
    for names, prefixes in (([], []), ([""], []), (["x", "x"], [])):
        with pytest.raises(ValueError):
            materialize.select_tensors(tensors, names, prefixes)
    with pytest.raises(Exception, match="selector matches no tensor"):
        materialize.select_tensors(tensors, ["head.weight", "absent"]).collect()


def test_materialize_notices_missing_and_corrupt_objects(spark):
    arts, chunks, objects = ingest.raw(files(spark, {"a": block(9, 4097)}), 1024)
    part = objects.where("size = 1")
    assert [r.error for r in materialize.verify(arts, chunks, part).collect()] == ["missing object"]
    wrong = objects.withColumn("data", F.concat("data", F.unhex(F.lit("00"))))
    assert [r.error for r in materialize.verify(arts, chunks, wrong).collect()] == ["corrupt object"]
    m = ingest.manifests(arts, chunks)
    reps = part.select("object", F.lit("loose").alias("kind"), F.col("size").alias("logical_size"), F.col("size").alias("stored_size"))
    row = reports.integrity(validate.manifest_violations(m), m, chunks.select("object"), reps, part).first()
    assert (row.missing_objects, row.corrupt_objects, row.ok) == (1, 0, False)


def lineage_frames(spark, edges, ids):
    e = spark.createDataFrame([(c, p, op, None) for c, p, op in edges], "child_id string, parent_id string, operation string, note string")
    return e, spark.createDataFrame([(i,) for i in ids], "artifact_id string")


def test_lineage_chain_missing_cycle_and_depth(spark):
    edges, known = lineage_frames(spark, [("c", "b", "quantize"), ("b", "a", "fine-tune"), ("a", "gone", "merge")], "abc")
    root = spark.createDataFrame([("c",)], "root_id string")
    tree = {r.node_id: (r.depth, r.operation, r.missing, r.truncated) for r in lineage.ancestry(edges, root, known).collect()}
    assert tree == {"c": (0, None, False, False), "b": (1, "quantize", False, False), "a": (2, "fine-tune", False, False), "gone": (3, "merge", True, False)}
    assert {r.node_id: r.truncated for r in lineage.ancestry(edges, root, known, 1).collect()} == {"c": False, "b": True}
    ring, known = lineage_frames(spark, [("a", "b", "x"), ("b", "a", "x")], "ab")
    assert [r.path for r in lineage.ancestry(ring, known.withColumnRenamed("artifact_id", "root_id").where("root_id = 'a'"), known).where("cycle").collect()] == [["a", "b", "a"]]
    asked = spark.createDataFrame([("a", "c"), ("c", "a"), ("a", "a")], "child_id string, parent_id string")
    assert {(r.child_id, r.parent_id): r.cycle for r in lineage.would_cycle(edges, asked).collect()} == {("a", "c"): True, ("c", "a"): False, ("a", "a"): True}


def test_lineage_diamonds_are_walked_once_per_path(spark):
    edges, known = lineage_frames(spark, [("d", "b", "x"), ("d", "c", "x"), ("b", "a", "x"), ("c", "a", "x")], "abcd")
    root = spark.createDataFrame([("d",)], "root_id string")
    assert lineage.ancestry(edges, root, known).where("node_id = 'a'").count() == 2
    assert lineage.closure(edges, root).count() == 4
    last = {tuple(r.path): r.last for r in lineage.tree_lines(lineage.ancestry(edges, root, known)).collect()}
    assert last[("d", "c")] and not last[("d", "b")]


def test_edges_are_inserted_once(spark):
    edges, _ = lineage_frames(spark, [("c", "b", "quantize")], "")
    new = spark.createDataFrame([("c", "B", " quantize ", None), ("c", "b", "prune", "n")], "child_id string, parent_id string, operation string, note string")
    assert [tuple(r) for r in lineage.insert_edges(edges, new).collect()] == [("c", "b", "prune", "n")]
    with pytest.raises(Exception, match="operation must have"):
        lineage.insert_edges(edges, new.withColumn("operation", F.lit("  "))).collect()


def versions(spark, n=4, size=65536):
    bodies = [bytes([0x31]) * size]
    for k in range(1, n):
        bodies.append(bodies[-1][:k] + bytes([k]) + bodies[-1][k + 1 :])
    arts, chunks, objects = ingest.raw(files(spark, {f"v{i}": b for i, b in enumerate(bodies)}), size)
    return bodies, chunks, objects


def loose(objects, ids=None):
    rows = objects if ids is None else objects.where(F.col("object").isin(ids))
    return rows.select("object", F.lit("loose").alias("kind"), F.lit("raw").alias("encoding"), F.octet_length("data").cast("long").alias("stored_size"), F.octet_length("data").cast("long").alias("logical_size"), F.lit(None).cast("string").alias("base"), F.lit(0).cast("long").alias("depth"))


def test_delta_depth_is_bounded_along_a_chain(spark):
    bodies, chunks, objects = versions(spark)
    reps, depths = loose(objects), []
    for k in range(1, 4):
        verdict = delta.optimize(pair(spark, bodies[k - 1], bodies[k]), chunks, objects, reps, Policy()).first()
        depths.append((verdict.stored, verdict.depth))
        if verdict.stored:
            row = spark.createDataFrame([(verdict.target, "delta", "delta", verdict.delta_bytes, len(bodies[k]), verdict.base, verdict.depth)], reps.schema)
            reps = reps.where(F.col("object") != verdict.target).unionByName(row)
    assert depths == [(True, 1), (True, 2), (False, 3)]
    named = chunks.where(F.col("artifact_id") == sha(bodies[2])).select("object")
    assert delta.reachable(named, reps).count() == 3


def test_delta_policy_rejects_noise_and_what_is_not_loose(spark):
    import random

    a, b = random.Random(1).randbytes(4096), random.Random(2).randbytes(4096)
    _, chunks, objects = ingest.raw(files(spark, {"a": a, "b": b}), 4096)
    judge = lambda reps, policy=None: delta.optimize(pair(spark, a, b), chunks, objects, reps, policy).first()
    assert judge(loose(objects), Policy(delta_min_savings_pct=95)).reason == "savings below the policy"
    assert judge(loose(objects, [sha(a)])).reason == "target is not loose"
    both = loose(objects).unionByName(loose(objects, [sha(b)]).withColumn("kind", F.lit("pack")))
    assert judge(both).reason == "target is also packed"
    with pytest.raises(ValueError):
        Policy(max_delta_depth=0)


def test_delta_potential_of_a_small_change(spark):
    state, left = 0x12345678, bytearray()
    for _ in range(16 * 1024):
        state ^= state << 13 & 0xFFFFFFFF
        state ^= state >> 17
        state ^= state << 5 & 0xFFFFFFFF
        left.append(state & 255)
    right = bytes(b ^ 1 if 4096 <= i < 4160 else b for i, b in enumerate(left))
    left = bytes(left)
    _, chunks, objects = ingest.raw(files(spark, {"l": left, "r": right}), 4096)
    row = delta.potential(pair(spark, left, right), chunks, objects).first()
    assert (row.changed_chunks, row.comparable_chunks, row.incomparable_bytes) == (1, 1, 0)
    full, small = len(codec.zstd(right[4096:8192])), len(codec.zstd(codec.xor(left[4096:8192], right[4096:8192])))
    assert (row.full_compressed_bytes, row.delta_compressed_bytes, row.potential_savings_bytes) == (full, small, full - small)


def test_reconstruction_follows_the_chain_and_stops_at_damage(spark):
    bodies = [bytes([7]) * 1000, bytes([7]) * 999 + b"x", bytes([7]) * 998 + b"yx"]
    ids = blake3_many(bodies)
    records = [(ids[k], ids[k - 1], k, bytearray(codec.encode_delta(bodies[k], bodies[k - 1], ids[k - 1], k))) for k in (1, 2)]
    rows = spark.createDataFrame(records, "object string, base string, depth long, record binary")
    full = spark.createDataFrame([(ids[0], bytearray(bodies[0]))], "object string, data binary")
    assert {r.object: (bytes(r.data), r.ok) for r in delta.reconstruct(full, rows).collect()} == {ids[1]: (bodies[1], True), ids[2]: (bodies[2], True)}
    broken = rows.withColumn("record", F.when(F.col("depth") == 1, F.unhex(F.lit("00"))).otherwise(F.col("record")))
    assert [r.ok for r in delta.reconstruct(full, broken).collect()] == [False, False]


def test_simulation_matches_a_walk(spark):
    left, right = block(1) + block(2) + block(3, 100), block(1) + block(4) + block(4) + block(5, 100)
    _, _, _ = ingest.raw(files(spark, {"l": left}), 4096)
    bodies = files(spark, {"l": left, "r": right}).select(F.sha2("body", 256).alias("artifact_id"), "body")
    got = {r.delta_threshold_pct: (r.chunks, r.shared_chunks, r.estimated_physical_bytes) for r in delta.simulate(pair(spark, left, right), bodies, [4096], [0, 101]).collect()}
    size = lambda b: min(len(b), len(codec.zstd(b, sized=True)))
    base = size(block(1)) + size(block(2)) + size(block(3, 100))
    plain = base + size(block(4)) + size(block(5, 100))
    assert got[101] == (7, 2, plain) and got[0][2] <= plain


def test_packs_are_built_read_and_checked(spark):
    data = {f"f{k}": block(k, 100 * k) for k in range(1, 6)}
    _, _, objects = ingest.raw(files(spark, data), 4096)
    built = packs.build(packs.encoded(objects))
    assert built.count() == 1
    indexes = built.select(F.from_json("index", PACK_INDEX).alias("i")).select("i.*")
    assert packs.verify_totals(packs.verify(indexes, built.select("pack_file", "body"), "sha256")).first().ok
    damaged = built.select("pack_file", F.expr("substring(body, 1, length(body) - 1)").alias("body"))
    assert packs.verify(indexes, damaged, "sha256").where("error is not null").count() == 1
    outside = indexes.withColumn("pack_file", F.lit("../../outside.mvpack"))
    assert {r.error for r in packs.verify(outside, built.select("pack_file", "body")).collect()} == {"pack file outside of its folder"}
    old = spark.createDataFrame([(1, "p.mvpack", [("A" * 64, 0, 5, 0, None)])], PACK_INDEX)
    assert [(r.object, r.stored_size, r.encoding, r.error) for r in packs.entries(old).collect()] == [("a" * 64, 5, "raw", None)]


def test_packs_send_bytes_once(spark):
    """Objects meet by the digits of their pack: one exchange up to the packs, and none where a body is next to its index."""
    texts = [bytes([k]) * 300 for k in range(40)] * 3
    rows = spark.createDataFrame([(hashlib.sha256(t).hexdigest(), t) for t in texts], "object string, data binary").repartition(3)
    once = packs.gathered(rows)
    assert sorted(r.object for r in once.collect()) == sorted({r.object for r in rows.collect()})
    built = packs.build(packs.gathered(rows.coalesce(2)), one_pack=False, pack_bytes=20)
    plan = built._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    made = built.select(F.from_json("index", PACK_INDEX).alias("i"), "body").select("i.*", "body")
    verdicts = packs.verify(made, hash="sha256")
    assert verdicts._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = packs.verify_totals(verdicts).first()
    assert got.ok and got.entries == 40
    cut = made.withColumn("body", F.when(F.col("pack_file") >= "pack-8", F.expr("substring(body, 1, length(body) - 1)")))
    assert {r.error for r in packs.verify(cut, hash="sha256").collect()} == {None, "missing pack", "entry outside of the pack"}  # of a pack cut short, the last entry


def test_duplicate_representations_and_garbage(spark):
    arts, chunks, objects = ingest.raw(files(spark, {"a": block(65, 131072)}), 4096)
    reps = loose(objects).unionByName(loose(objects).withColumn("kind", F.lit("pack")).withColumn("stored_size", F.lit(20).cast("long")))
    reach = chunks.select("object")
    row = reports.storage_report(arts, reps, reach, chunks.select("object", "size")).first()
    assert (row.duplicate_representation_bytes, row.orphan_objects, row.physical_bytes) == (4096, 0, 4116)
    none = chunks.where("false").select("object")
    assert tuple(reports.gc_report(loose(objects), none).first()) == (1, 4096, 1, 4096)
    assert tuple(reports.gc_report(reps, none).first()) == (1, 4096, 0, 0)


def test_sync_twice(spark):
    body = block(7, 20000)
    _, chunks, objects = ingest.raw(files(spark, {"a": body}), 4096)
    ids = objects.select("object")
    first = sync.totals(sync.plan(chunks, ids, ids.where("false"))).first()
    again = sync.totals(sync.plan(chunks, ids, ids)).first()
    assert (first.objects_copied, first.bytes_copied, first.bytes_reused) == (2, 4096 + 3616, 0)
    assert (again.bytes_copied, again.bytes_reused) == (0, 20000)
    wrong = chunks.withColumn("size", F.col("chunk_ix") + 1)
    with pytest.raises(Exception, match="sizes differ"):
        sync.unique_tasks(wrong).collect()


def test_ingest_counts_first_occurrences(spark):
    _, chunks, _ = ingest.raw(files(spark, {"a": block(1) * 2 + block(2), "b": block(2)}), 4096)
    row = ingest.ingest_totals(chunks, ["artifact_id", "chunk_ix"]).first()
    assert (row.new_bytes, row.reused_bytes, row.new_objects) == (8192, 8192, 2)
    assert ingest.first_occurrences(chunks, ["artifact_id", "chunk_ix"]).where("new").count() == 2


def test_remotes():
    r = Remotes.loads(None)
    r.add("main", path="/data/remote")
    r.add("cloud", bucket="b", prefix="/p/q/", region="x")
    assert r.resolve() == ("main", {"type": "filesystem", "path": "/data/remote"}) and r.url("cloud") == "s3a://b/p/q"
    r.use("cloud")
    assert Remotes.loads(r.dumps()).default == "cloud"
    r.remove("cloud")
    assert r.default is None
    for bad in (lambda: r.add("bad name", path="x"), lambda: r.add("main", path="x"), lambda: r.add("n"), lambda: r.add("n", bucket="b", max_attempts=0)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(KeyError):
        r.resolve()
