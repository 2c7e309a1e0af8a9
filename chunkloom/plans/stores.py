"""Queries that write stores, manifests and reports to the shared folder and read them again, and those of small functions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.deploy import shared_dir
from chunkloom.functions import cdc, codec
from chunkloom.functions.scalars import artifact_format, object_path, provenance, target_path
from chunkloom.model import count_where, total
from chunkloom.operators import compare, delta, ingest, lineage, maintenance, materialize, packs, reports, sync
from chunkloom.plans import adapters as A
from chunkloom.plans.queries import _diff, _docs, _manifests, _store, query
from chunkloom.sources import containers, manifests, store
from chunkloom.sources.files import write_files


def _root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"


@query
def manifest_round_trip(spark, d):
    """Manifests of all documents saved, those of even documents saved again under another name, all scanned."""
    root, m = _root(spark), lineage.cut(_manifests(spark, d))
    manifests.save(m, root)
    manifests.save(m.where("n % 2 = 0").withColumn("source_name", F.concat(F.lit("again-"), "source_name")), root)
    found = manifests.scan(spark, root)
    file = F.element_at(F.split("path", "/"), -1)
    return found.select("artifact_id", "source_name", file.alias("file"), F.col("logical_size").cast("long").alias("logical_size"), F.size("chunks").cast("long").alias("chunks"))


@query
def manifest_scan_errors(spark, d):
    """A tolerant scan of manifests of which some are cut off or break rules: files by rule, and the sound ones."""
    root, m = _root(spark), _manifests(spark, d)
    names = [f.name for f in manifests.MANIFEST.fields]
    bad = m.withColumn("version", F.when(F.col("n") % 13 == 0, 2).otherwise(1)).withColumn("logical_size", F.when(F.col("n") % 17 == 0, F.col("logical_size") + 1).otherwise(F.col("logical_size")))
    text = F.to_json(F.struct(*names))
    text = F.when(F.col("n") % 11 == 0, F.expr("left(json, length(json) - 1)")).otherwise(F.col("json"))
    files = bad.withColumn("json", F.to_json(F.struct(*names))).select(F.concat(F.lit("manifests/"), "artifact_id", F.lit(".JSON")), text)
    write_files(files, root)
    sound, found = manifests.scan_tolerant(spark, root)
    return found.groupBy("rule").agg(F.countDistinct("path").alias("files")).unionByName(sound.agg(F.lit("sound").alias("rule"), F.count("*").alias("files")))


@query
def pointer_round_trip(spark, d):
    """Pointers saved in folders, hidden ones among them, and found again; those in skipped folders are not."""
    root = _root(spark)
    m = _manifests(spark, d)
    folder = F.when(F.col("n") % 11 == 0, "a/.git/").when(F.col("n") % 5 == 0, "b/.hidden/").otherwise("")
    kind = F.when(F.col("n") % 3 == 0, ".MVPTR").otherwise(".mvptr")
    p = manifests.from_manifests(m, "manifests").join(m.select("artifact_id", F.concat(folder, "artifact_id", kind).alias("pointer")), "artifact_id")
    manifests.save_pointers(p, root)
    return manifests.pointers(spark, root, 1_000_000).select("pointer", "artifact_id", "manifest", F.col("logical_size").cast("long").alias("logical_size"))


def _bench_objects(spark, d) -> DataFrame:
    """object, data: the texts of the benchmark."""
    rows = A.read(spark, d, "benchmark").where("text is not null").select(F.encode("text", "UTF-8").alias("data"))
    return rows.groupBy(F.sha2("data", 256).alias("object")).agg(F.first("data").alias("data"))


def _bench_store(spark, d) -> str:
    """A store of the benchmark's texts: all loose and raw, those with a first digit from 8 on packed too, from c on also as deltas."""
    root, objects = _root(spark), lineage.cut(_bench_objects(spark, d))
    store.export_loose(objects, root)
    store.export_packs(packs.build(packs.encoded(objects.where("object >= '8'"))), root)
    base = F.repeat(F.lit("x"), F.octet_length("data")).cast("binary")

    @F.pandas_udf("binary")
    def record(target, base, base_id):
        import pandas as pd

        return pd.Series([codec.encode_delta(bytes(t), bytes(b), i, 1) for t, b, i in zip(target, base, base_id, strict=True)], dtype=object)

    made = objects.where("object >= 'c'").select(F.col("object").alias("target"), record("data", base, F.sha2(base, 256)).alias("record"), F.lit(True).alias("stored"))
    store.export_deltas(made, root)
    return root


@query
def store_listing(spark, d):
    """Every representation in a store's files; sizes come from names, headers and indexes."""
    reps = store.representations(spark, _bench_store(spark, d)).where("object is not null")
    return reps.select("object", "kind", "logical_size", "base", "depth", F.when(F.col("kind") == "loose", F.col("stored_size")).alias("loose_bytes"))


@query
def store_objects(spark, d):
    """Every object of a store once, with the bytes of its first form, and the form its size is taken from."""
    root = _bench_store(spark, d)
    reps = store.representations(spark, root)
    found = store.objects(spark, root, "sha256").select("object", F.sha2("data", 256).alias("digest"))
    return found.join(reports.logical_objects(reps), "object").select("object", (F.col("digest") == F.col("object")).alias("ok"), "size")


@query
def pack_lookup(spark, d):
    """The entry of each packed object, from two packs that share objects: the first pack by name has it."""
    objects = lineage.cut(_bench_objects(spark, d))
    made = packs.encoded(objects)
    listed = lambda rows, name: rows.groupBy().agg(F.array_sort(F.collect_list(F.struct(F.col("object").alias("id"), F.lit(0).cast("long").alias("offset"), "size", "stored_size", "encoding"))).alias("objects")).select(F.lit(2).alias("version"), F.lit(name).alias("pack_file"), "objects")
    both = listed(made.where("object < 'a'"), "pack-b.mvpack").unionByName(listed(made.where("object >= '6'"), "pack-a.mvpack"))
    return packs.lookup(both, objects).select("object", "pack_file", "size")


@query
def repack_counts(spark, d):
    """A store's loose objects packed and their loose files pruned: what the run reports, and what is left by kind."""
    root = _bench_store(spark, d)
    report = maintenance.repack(spark, root, prune_loose=True, hash="sha256")
    left = store.representations(spark, root).groupBy("kind").agg(F.count("object").alias("n")).where("kind in ('loose', 'delta', 'pack')")
    return left.unionByName(report.select(F.explode(F.array(*(F.struct(F.lit(f"report {c}").alias("kind"), F.col(c).alias("n")) for c in ("objects", "pruned")))).alias("x")).select("x.*"))


@query
def compact_counts(spark, d):
    """A store put into new packs, everything else pruned: every object is left once, and sound."""
    root = _bench_store(spark, d)
    maintenance.compact(spark, root, prune_old=True, prune_loose=True, hash="sha256")
    reps = store.representations(spark, root).where("object is not null")
    sound = store.objects(spark, root, "sha256").where(F.sha2("data", 256) == F.col("object"))
    return reps.groupBy("kind").agg(F.count("*").alias("n"), total("logical_size").alias("bytes")).crossJoin(F.broadcast(sound.agg(F.count("*").alias("sound"))))


@query
def gc_prune(spark, d):
    """Objects that no kept text names are pruned from a store; packed forms stay."""
    root = _bench_store(spark, d)
    kept = _bench_objects(spark, d).where("object like '%0' or object like '%1'").select("object")
    report = maintenance.collect_garbage(spark, root, delta.reachable(kept, store.representations(spark, root).where("kind <> 'delta'")), prune=True)
    left = store.representations(spark, root).where("kind = 'loose'").agg(F.count("*").alias("loose_left"))
    return report.select("orphan_objects", "orphan_bytes").crossJoin(F.broadcast(left))


@query
def put_objects(spark, d):
    """Objects put into a table twice, some damaged between: what the second run writes, and what is sound after it."""
    table, objects = _root(spark), lineage.cut(_bench_objects(spark, d))
    hurt = objects.withColumn("data", F.when(F.col("object").startswith("0") | F.col("object").startswith("5"), F.lit("damaged").cast("binary")).otherwise(F.col("data")))
    hurt.where("object not like '7%'").withColumn("bucket", F.substring("object", 1, 2)).write.partitionBy("bucket").parquet(table)
    written = store.put_if_absent(objects, table, "sha256")
    after = spark.read.schema("object string, data binary, bucket string").parquet(table)
    sound = after.groupBy("object").agg(F.count("*").alias("n"), F.min(F.sha2("data", 256) == F.col("object")).alias("sound"))
    return sound.join(written.select("object", F.lit(True).alias("written")), "object", "left").select("object", "n", "sound", F.coalesce("written", F.lit(False)).alias("written"))


@query
def remote_audit(spark, d):
    """A listing of a remote checked against all manifests: missing, damaged and orphaned objects, odd keys."""
    m = _manifests(spark, d).where("n % 7 <> 0")
    chunks = A.doc_chunks(A.doc_bodies(spark, d), keep_data=True)
    objects = chunks.groupBy("object").agg(F.first("data").alias("data"))
    path = object_path(F.col("object"))
    key = F.concat(F.lit("remote/"), F.when(F.col("object").startswith("02"), F.upper(path)).otherwise(path))
    key = F.when(F.col("object").startswith("03"), F.concat(F.lit("remote/objects/"), "object")).otherwise(key)
    data = F.when(F.col("object").startswith("01"), F.concat("data", F.unhex(F.lit("00")))).otherwise(F.col("data"))
    listing = objects.where("object not like '00%'").select(key.alias("key"), F.octet_length("data").cast("long").alias("size"), data.alias("data"))
    return maintenance.audit(listing, m, "sha256", max_keys=1 << 30)


@query
def raw_file_scan(spark, d):
    """The pages written as files and scanned: name, hash, size and the format their extension asks for."""
    root = _root(spark)
    ext = F.element_at(F.array(F.lit(".bin"), F.lit(".safetensors"), F.lit(".SafeTensors"), F.lit("")), (F.col("page_id") % 4 + 1).cast("int"))
    pages = A.read(spark, d, "pages").where("html is not null").select(F.concat(F.lit("p/page-"), "page_id", ext).alias("path"), F.encode("html", "UTF-8").alias("body"))
    write_files(pages, root)
    found = containers.raw_files(spark, root)
    return found.select("source_name", F.sha2("body", 256).alias("artifact_id"), F.octet_length("body").cast("long").alias("bytes"), artifact_format(F.col("source_name")).alias("format"))


@query
def container_headers(spark, d):
    """Conversations written as tensor containers; their tensors by name as the headers list them."""
    parts = A.conv_parts(spark, d)
    whole = A.conv_tensors(parts).withColumn("selected_ix", F.col("tensor_ix")).withColumn("new_offset", F.col("data_offset"))
    objects = A.conv_chunks(parts).select("object").distinct()
    pieces = parts.select("payload", F.explode(A.piece_ranges(F.octet_length("payload"))).alias("r")).select(F.substring(F.col("payload"), F.col("r.offset").cast("int") + 1, F.col("r.len").cast("int")).alias("data"))
    objects = pieces.withColumn("object", F.sha2("data", 256)).dropDuplicates(["object"]).join(objects, "object", "left_semi")
    files = materialize.assemble(whole, A.conv_chunks(parts), objects).select(F.col("artifact_id").alias("source_name"), F.col("file").alias("body"))
    found = containers.inspect(lineage.cut(files))
    each = found.select("source_name", "error", "payload_start", F.posexplode("tensors").alias("ix", "t"))
    return each.select("source_name", F.col("ix").cast("long").alias("ix"), "t.name", "t.dtype", (F.col("t.data_offset") - F.col("payload_start")).alias("payload_offset"), "t.data_size", "error")


@query
def lineage_lines(spark, d):
    """Two levels of ancestry of documents with two parents each: the last branch of every node."""
    docs = A.read(spark, d, "documents").where("doc_id > 0").select(F.col("doc_id").alias("n"))
    part = lambda k, op: docs.select(F.col("n").cast("string").alias("child_id"), (F.col("n") / k).cast("long").cast("string").alias("parent_id"), F.lit(op).alias("operation"), F.lit(None).cast("string").alias("note"))
    known = A.read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("artifact_id"))
    tree = lineage.ancestry(part(2, "merge").unionByName(part(5, "base")), known.withColumnRenamed("artifact_id", "root_id"), known, max_depth=2)
    return lineage.tree_lines(tree).select("root_id", F.array_join("path", ">").alias("path"), "operation", "last")


@query
def hub_lookup(spark, d):
    """The newest snapshot of a cached file, among files made from the pages."""
    pages = A.read(spark, d, "pages")
    path = F.concat(F.lit("/hub/models--org--m/snapshots/r"), F.col("page_id") % 50, F.lit("/f"), F.col("page_id") % 3, F.lit(".bin"))
    files = pages.select(path.alias("path"), (F.col("page_id") * 7919 % 1000).alias("modified"), F.lit(None).cast("binary").alias("content"))
    return containers.hub_file(files, "org/m", "f1.bin")


@query
def hub_provenance(spark, d):
    """Where cached files made from the pages come from."""
    pages = A.read(spark, d, "pages")
    repo = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("org/m"), F.col("page_id"))).otherwise(F.concat(F.lit("m"), F.col("page_id")))
    path = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("/hub/snapshots/rev"), F.col("page_id"), F.lit("/f.bin"))).otherwise("/plain/f.bin")
    requested = F.when(F.col("page_id") % 5 == 0, "main")
    return pages.select("page_id", provenance(repo, requested, path, F.lit("f.bin")).alias("p")).select("page_id", "p.provider", "p.namespace", "p.repository", "p.model_name", "p.requested_revision", "p.resolved_revision", "p.filename", "p.source_uri")


@query
def diff_report(spark, d):
    """The lines of the reports that compare pairs of conversations."""
    sizes = A.conv_parts(spark, d).groupBy("artifact_id").agg(total(F.octet_length("payload")).alias("logical_size"))
    arts = sizes.select("artifact_id", F.concat("artifact_id", F.lit(".bin")).alias("source_name"), "logical_size", F.lit(0).cast("long").alias("edges"), F.lit(None).cast("string").alias("provider"))
    return compare.markdown(A.conv_pairs(spark, d), arts, lineage.cut(_diff(spark, d)))


@query
def snapshot_round_trip(spark, d):
    """The totals of all documents written as a JSON snapshot and loaded again."""
    row = reports.snapshot(reports.dedup_totals(*_docs(spark, d)))
    path = f"{_root(spark)}/snapshot.json"
    manifests.save_snapshot(row, path)
    return manifests.load_snapshot(spark, path, row.schema)


@query
def delta_eligibility(spark, d):
    """Which deltas along chains of ten documents a policy of depth two takes, if every fifth saves too little."""
    n = A.read(spark, d, "documents").select(F.col("doc_id").alias("n")).where("n % 10 <> 0")
    name = lambda c: F.concat(F.lit("o"), c.cast("string"))
    none = F.lit(None).cast("string")
    rows = n.select(F.col("n").alias("pair"), F.lit(0).cast("long").alias("chunk_ix"), name(F.col("n")).alias("target"), name(F.col("n") - 1).alias("base"), none.alias("before"), F.when(F.col("n") % 5 == 0, "savings below the policy").alias("after"))
    state = A.read(spark, d, "documents").select(name(F.col("doc_id")).alias("object"), F.lit(0).cast("long").alias("depth"), none.alias("up"))
    return delta.decide(rows, state, 2).select("target", "base", "depth", "reason")


@query
def sync_run(spark, d):
    """Totals of transferring all artifacts one after another: what one copies, the next ones reuse."""
    _, kept, chunks, _ = _store(spark, d)
    everything = chunks.select("object").distinct()
    return sync.totals(sync.run_plan(sync.plan(chunks, everything.where("object not like '00%'"), kept.select("object"))))


@query
def path_targets(spark, d):
    """Where paths made from the pages would be written below a root, if they may."""
    k = F.col("page_id") % 6
    name = F.concat(F.lit("f"), F.col("page_id"))
    path = F.when(k == 0, F.concat(F.lit("a/./"), name)).when(k == 1, F.concat(F.lit("../"), name)).when(k == 2, F.concat(F.lit("/root/x//"), name)).when(k == 3, F.concat(F.lit("/rooted/"), name)).when(k == 4, F.concat(F.lit("/root/x/../../"), name)).otherwise(name)
    return A.read(spark, d, "pages").select("page_id", target_path("/root", path).alias("target"))


@query
def content_defined_cover(spark, d):
    """Content-defined chunks of every document: they cover it without gaps, and none is longer than four times the average."""
    cut = A.doc_bodies(spark, d).select("artifact_id", "body", cdc.cdc_chunks(256)("body").alias("cuts"))
    end = F.aggregate("cuts", F.lit(0).cast("long"), lambda a, r: F.when(a == r["offset"], a + r["len"]).otherwise(F.lit(-1).cast("long")))
    longest = F.coalesce(F.array_max(F.transform("cuts", lambda r: r["len"])), F.lit(0))
    return cut.select("artifact_id", end.alias("covered_bytes"), (longest <= 1024).alias("bounded"))


@query
def delta_headers(spark, d):
    """Headers of delta records made from the documents, parsed; odd marks and a depth of zero are malformed."""
    rows = A.read(spark, d, "documents").where("text is not null").select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("base"), F.octet_length(F.encode("text", "UTF-8")).cast("long").alias("n"))
    mark = F.when(F.col("doc_id") % 7 == 0, "MVDX").otherwise("MVD1")
    depth = F.lpad(F.hex(F.col("doc_id") % 4), 2, "0")
    size = F.lpad(F.hex("n"), 16, "0")
    little = F.array_join(F.transform(F.sequence(F.lit(15), F.lit(1), F.lit(-2)), lambda i: F.substring(size, i, F.lit(2))), "")
    record = F.concat(F.encode(F.concat(mark, F.upper("base")), "UTF-8"), F.unhex(depth), F.unhex(little), F.unhex(F.lit("00")))
    return rows.select("doc_id", store.delta_header(record).alias("h")).select("doc_id", "h.base", "h.depth", "h.size")


@query
def positional_chunks(spark, d):
    """Right chunks of document pairs against the left chunk of the same place and length."""
    rows = compare.positional(A.doc_pairs(spark, d), _docs(spark, d)[1])
    hit = F.col("left_object").isNotNull()
    return rows.groupBy("pair").agg(F.count("*").alias("right_chunks"), count_where(hit).alias("placed"), count_where(hit & (F.col("left_object") == F.col("object"))).alias("equal"))


@query
def ingest_files(spark, d):
    """The pages ingested as raw files: artifacts, chunks and objects."""
    pages = A.read(spark, d, "pages").where("html is not null").select(F.concat(F.lit("page-"), "page_id").alias("source_name"), F.encode("html", "UTF-8").alias("body"))
    arts, chunks, objects = ingest.raw(pages, 1024)
    per = chunks.groupBy("artifact_id").agg(F.count("*").alias("chunks"), F.countDistinct("object").alias("objects"))
    return arts.join(per, "artifact_id").select("artifact_id", "source_name", "logical_size", "chunks", "objects")
