"""The queries over the driver's tables, one per operator."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.functions import cdc, codec
from chunkloom.functions.hashing import blake3_hex
from chunkloom.functions.ranges import chunk_bodies, ranges
from chunkloom.functions.scalars import canonical_key_id, insecure_endpoint, is_object_id, object_path, remote_name_ok, snapshot_revision
from chunkloom.model import Policy, pct, total
from chunkloom.operators import compare, delta, ingest, lineage, materialize, packs, reports, sync, validate
from chunkloom.plans import adapters as A

Query = Callable[[SparkSession, str], DataFrame]
_ALL: dict[str, Query] = {}


def query(f: Query) -> Query:
    _ALL[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    from chunkloom.plans import stores  # noqa: F401  registers its queries

    return dict(_ALL)


def _docs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    bodies = A.doc_bodies(spark, d)
    return A.artifacts(bodies), A.doc_chunks(bodies)


@query
def dedup_efficiency(spark, d):
    return reports.dedup_totals(*_docs(spark, d))


@query
def chunk_listing(spark, d):
    return _docs(spark, d)[1].select("artifact_id", "chunk_ix", "object", "offset", "size")


@query
def chunk_stats(spark, d):
    return reports.chunk_stats(*_docs(spark, d)).drop("source_name")


@query
def chunk_dup_profile(spark, d):
    per = _docs(spark, d)[1].groupBy("object").agg(F.count("*").alias("instances"), F.min("size").alias("size"))
    return per.groupBy("instances").agg(F.count("*").alias("objects"), total("size").alias("bytes"))


@query
def artifact_attribution(spark, d):
    arts, chunks = _docs(spark, d)
    sizes = chunks.groupBy("object").agg(F.min("size").alias("primary_size"))
    return reports.attribution(arts, chunks, sizes)


@query
def ingest_new_vs_reused(spark, d):
    ids = A.doc_ids(spark, d).join(A.doc_chunks(A.doc_bodies(spark, d)), "artifact_id")
    return ingest.ingest_totals(ids, ["doc_id", "chunk_ix"])


@query
def tensor_listing(spark, d):
    return A.conv_tensors(A.conv_parts(spark, d)).select("artifact_id", "tensor_ix", "name", "data_offset", "data_size")


@query
def tensor_chunks(spark, d):
    return A.conv_chunks(A.conv_parts(spark, d)).select("artifact_id", "chunk_ix", "tensor", "object", "offset", "size")


@query
def select_tensors_prefix(spark, d):
    tensors = A.conv_tensors(A.conv_parts(spark, d))
    return materialize.select_tensors(tensors, prefixes=["user"]).select("artifact_id", "name", "selected_ix", "new_offset", "data_size")


@query
def extract_overlap(spark, d):
    parts = A.conv_parts(spark, d)
    met = materialize.overlaps(A.conv_tensors(parts), A.container_chunks(parts))
    return met.select("artifact_id", "name", "chunk_ix", F.col("from").alias("piece_from"), F.col("to").alias("piece_to"), F.col("at").alias("piece_at"))


def _diff(spark, d):
    parts = A.conv_parts(spark, d)
    return compare.tensor_diff(A.conv_pairs(spark, d), A.conv_tensors(parts), A.conv_chunks(parts))


@query
def model_diff(spark, d):
    return _diff(spark, d)


@query
def model_diff_totals(spark, d):
    return compare.diff_totals(_diff(spark, d))


@query
def compare_reuse(spark, d):
    return compare.reuse(A.doc_pairs(spark, d), _docs(spark, d)[1])


@query
def pair_shared_objects(spark, d):
    return compare.shared_objects(A.doc_pairs(spark, d), _docs(spark, d)[1])


@query
def delta_alignment(spark, d):
    return compare.alignment(A.doc_pairs(spark, d), _docs(spark, d)[1])


def _manifests(spark, d):
    bodies = A.doc_bodies(spark, d)
    m = ingest.manifests(A.artifacts(bodies), A.doc_chunks(bodies))
    return m.withColumn("n", F.col("source_name").cast("long"))


@query
def manifest_violations(spark, d):
    """Rules broken by manifests with planted errors, by rule."""
    m = _manifests(spark, d)
    hit = lambda k: F.col("n") % k == 0
    moved = F.transform("chunks", lambda c: F.when(hit(17) & (c["offset"] == A.CHUNK), c.withField("offset", c["offset"] + 1)).otherwise(c))
    m = m.withColumn("chunks", moved).withColumn("key", F.col("artifact_id"))
    m = m.withColumn("logical_size", F.when(hit(13), F.col("logical_size") + 1).otherwise(F.col("logical_size"))).withColumn("version", F.when(hit(29), 2).otherwise(F.col("version")))
    m = m.withColumn("artifact_id", F.when(hit(19), F.lit("xyz")).otherwise(F.col("artifact_id"))).withColumn("chunk_size", F.when(hit(23), 0).otherwise(F.col("chunk_size")))
    return validate.manifest_violations(m, "key").groupBy("rule").agg(F.count("*").alias("manifests"))


@query
def pointer_violations(spark, d):
    """Rules broken by pointers with planted errors, by rule."""
    from chunkloom.sources.manifests import from_manifests

    m = _manifests(spark, d)
    p = from_manifests(m, ".modelstore/manifests").withColumn("n", F.col("source_name").cast("long")).withColumn("pointer", F.col("artifact_id"))
    hit = lambda k: F.col("n") % k == 0
    p = p.withColumn("logical_size", F.when(hit(13), F.col("logical_size") + 1).otherwise(F.col("logical_size"))).withColumn("manifest", F.when(hit(17), F.lit("../../x.json")).otherwise(F.col("manifest")))
    p = p.withColumn("format", F.when(hit(19), "safetensors").otherwise(F.col("format")))
    return validate.pointer_violations(p, m.where("n % 11 <> 0")).groupBy("rule").agg(F.count("*").alias("pointers"))


def _store(spark, d):
    """Artifacts and chunks that are kept, all chunks, and what is stored."""
    arts, chunks = _docs(spark, d)
    kept, chunks = A.kept_ids(spark, d), lineage.cut(chunks)
    return arts.join(kept, "artifact_id", "left_semi"), lineage.cut(chunks.join(kept, "artifact_id", "left_semi")), chunks, lineage.cut(A.representations(chunks))


@query
def fsck_structural(spark, d):
    m = _manifests(spark, d)
    bodies = A.doc_bodies(spark, d)
    there = A.representations(A.doc_chunks(bodies)).where("object not like '00%'")
    bad = validate.manifest_violations(m.withColumn("version", F.when(F.col("n") % 29 == 0, 2).otherwise(1)))
    reach = A.doc_chunks(bodies).select("object").distinct()
    return reports.integrity(bad, m, reach, there)


@query
def fsck_deep(spark, d):
    m = _manifests(spark, d)
    chunks = A.doc_chunks(A.doc_bodies(spark, d), keep_data=True)
    kept = A.kept_ids(spark, d)
    there = A.damaged(chunks)
    reps = there.select("object", F.lit("loose").alias("kind"), F.octet_length("data").cast("long").alias("logical_size"), F.octet_length("data").cast("long").alias("stored_size"))
    kept_m = m.join(kept, "artifact_id", "left_semi")
    return reports.integrity(validate.manifest_violations(kept_m), kept_m, chunks.join(kept, "artifact_id", "left_semi").select("object"), reps, there)


@query
def gc_orphans(spark, d):
    _, kept, _, reps = _store(spark, d)
    return reports.gc_report(reps, delta.reachable(kept, reps))


@query
def storage_report(spark, d):
    arts, kept, chunks, reps = _store(spark, d)
    return reports.storage_report(arts, reps, delta.reachable(kept, reps), chunks.select("object", "size"))


@query
def storage_breakdown(spark, d):
    return reports.breakdown(_store(spark, d)[3])


@query
def efficiency_report(spark, d):
    """Sizes after compression are those of the representations' rule."""
    arts, kept, chunks, reps = _store(spark, d)
    reach = delta.reachable(kept, reps)
    per = reps.groupBy("object").agg(F.min("logical_size").alias("size"), F.min(F.when(F.col("kind") != "delta", F.col("stored_size"))).alias("full_size"))
    return reports.efficiency(arts, kept, reports.primary_sizes(per, reps), reach, reports.storage_report(arts, reps, reach, chunks.select("object", "size")))


@query
def delta_closure(spark, d):
    _, kept, _, reps = _store(spark, d)
    return delta.reachable(kept, reps)


def _sync(spark, d):
    _, kept, chunks, _ = _store(spark, d)
    everything = chunks.select("object").distinct()
    return sync.plan(chunks, everything.where("object not like '00%'"), kept.select("object"))


@query
def sync_plan(spark, d):
    return _sync(spark, d)


@query
def sync_totals(spark, d):
    return sync.totals(_sync(spark, d))


def _known(spark, d):
    return A.read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("artifact_id"))


@query
def lineage_ancestry(spark, d):
    """Per document: edges and depth of its ancestry."""
    edges = A.lineage_edges(spark, d)
    tree = lineage.ancestry(edges, _known(spark, d).withColumnRenamed("artifact_id", "root_id"), _known(spark, d))
    return tree.groupBy("root_id").agg(total(F.when(F.col("depth") > 0, 1).otherwise(0)).alias("edges"), F.max("depth").alias("depth"))


@query
def lineage_missing(spark, d):
    """Where walks of at most three steps end: at an ancestor without manifest, or cut off."""
    edges, known = A.lineage_edges(spark, d), _known(spark, d)
    tree = lineage.ancestry(edges, known.withColumnRenamed("artifact_id", "root_id"), known.where("artifact_id % 5 <> 0"), max_depth=3)
    return tree.groupBy("depth").agg(F.count("*").alias("nodes"), total(F.when(F.col("missing"), 1).otherwise(0)).alias("missing"), total(F.when(F.col("truncated"), 1).otherwise(0)).alias("truncated"))


@query
def lineage_cycle_check(spark, d):
    """Would an edge from document n div 4 to its descendant n close a cycle, and one from n to n + 1?"""
    ids = A.read(spark, d, "documents").select(F.col("doc_id").alias("n")).where("n > 3")
    back = ids.select((F.col("n") / 4).cast("long").cast("string").alias("child_id"), F.col("n").cast("string").alias("parent_id"))
    side = ids.select(F.col("n").cast("string").alias("child_id"), (F.col("n") + 1).cast("string").alias("parent_id"))
    return lineage.would_cycle(A.lineage_edges(spark, d), back.unionByName(side))


@query
def pack_layout(spark, d):
    _, _, chunks, reps = _store(spark, d)
    loose = packs.repack_candidates(reps)
    entries = loose.join(chunks.groupBy("object").agg(F.min("size").alias("stored_size")), "object")
    return packs.layout(entries).select("pack", "object", "offset", "stored_size")


@query
def snapshot_compare(spark, d):
    """Totals of all documents minus those of the labelled ones."""
    arts, chunks = _docs(spark, d)
    kept = A.kept_ids(spark, d)

    def shot(a, c):
        t = reports.dedup_totals(a, c).withColumnRenamed("artifacts", "manifests")
        return t.withColumn("actual_physical_bytes", F.col("unique_logical_bytes")).withColumn("net_physical_savings_bytes", F.col("dedup_savings_bytes"))

    return compare.compare_snapshots(shot(arts.join(kept, "artifact_id", "left_semi"), chunks.join(kept, "artifact_id", "left_semi")), shot(arts, chunks))


@query
def page_revisions(spark, d):
    """Path functions: the component after ``snapshots`` of a path made from each page's address."""
    pages = A.read(spark, d, "pages")
    path = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("/hub/snapshots/rev"), "page_id", F.lit("/file.bin"))).otherwise(F.col("url"))
    return pages.select("page_id", snapshot_revision(path).alias("revision"))


@query
def benchmark_fixed(spark, d):
    """Reuse of document pairs under fixed-size chunks of several sizes."""
    bodies, pairs = A.doc_bodies(spark, d), A.doc_pairs(spark, d)
    out = None
    for size in (64, 256, 1024):
        rows = compare.reuse(pairs, chunk_bodies(bodies, size)).withColumn("chunk_size", F.lit(size).cast("long"))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("chunk_size").agg(total("shared_bytes").alias("shared_bytes"), total("right_bytes").alias("right_bytes")).withColumn("reuse_pct", pct(F.col("shared_bytes"), F.col("right_bytes")))


@query
def materialize_bodies(spark, d):
    """Every document put together again from its chunks, and whether its hash is its id."""
    bodies = A.doc_bodies(spark, d)
    chunks = A.doc_chunks(bodies, keep_data=True)
    objects = chunks.groupBy("object").agg(F.first("data").alias("data"))
    made = materialize.bodies(A.artifacts(bodies), chunks.drop("data"), objects)
    return made.select("artifact_id", F.sha2("body", 256).alias("digest"), F.octet_length("body").cast("long").alias("bytes"), "ok")


@query
def materialize_verify(spark, d):
    """What is wrong with each document in a store that lost some objects and damaged others."""
    bodies = A.doc_bodies(spark, d)
    chunks = A.doc_chunks(bodies, keep_data=True)
    return materialize.verify(A.artifacts(bodies), chunks.drop("data"), A.damaged(chunks))


@query
def lineage_insert(spark, d):
    """New edges among proposed ones: every third repeats an edge that is there, with blanks around and capital letters."""
    edges = A.lineage_edges(spark, d)
    op = F.when(F.col("child_id") % 3 == 0, F.concat(F.lit(" "), "operation", F.lit(" "))).otherwise("prune")
    return lineage.insert_edges(edges, edges.withColumn("operation", op)).select("child_id", "parent_id", "operation")


@query
def pointer_advice(spark, d):
    """The first twenty pointers and how many more there are."""
    from chunkloom.sources.manifests import advice

    return advice(A.doc_ids(spark, d).select(F.concat("artifact_id", F.lit(".mvptr")).alias("pointer")).distinct())


@query
def path_predicates(spark, d):
    """Checks of keys, names and endpoints made from the pages."""
    pages = A.read(spark, d, "pages").select("page_id", "url", F.sha2(F.col("url"), 256).alias("id"))
    odd = F.col("page_id") % 2 == 1
    key = F.concat(F.lit("store/objects/"), F.substring("id", 1, 2), F.when(odd, F.lit("/")).otherwise(F.lit("-")), F.substring("id", 3, 62))
    name = F.when(odd, F.concat(F.lit("remote-"), "page_id")).otherwise(F.concat(F.lit("remote "), "page_id"))
    return pages.select("page_id", object_path(F.col("id")).alias("path"), canonical_key_id(key).alias("key_id"), is_object_id(F.col("id")).alias("hex"), remote_name_ok(name).alias("name_ok"), insecure_endpoint(F.col("url")).alias("insecure"))


# The queries below need encodings or hashes that SQL does not have.


@query
def chunking_benchmark(spark, d):
    """Four ways to cut pairs of conversations: fixed and content-defined, across and within tensors."""
    parts, pairs = A.conv_parts(spark, d), A.conv_pairs(spark, d)
    ordered = F.array_sort(F.collect_list(F.struct("tensor_ix", "payload")))
    whole = parts.groupBy("artifact_id").agg(F.aggregate(ordered, F.unhex(F.lit("")), lambda a, p: F.concat(a, p["payload"])).alias("body"))
    size = 256
    within = parts.select(F.concat_ws("/", "artifact_id", "name").alias("part"), "artifact_id", F.col("payload").alias("body"))
    cut = cdc.cdc_chunks(size)

    def by_content(rows):
        each = rows.select("artifact_id", "body", F.explode(cut("body")).alias("r"))
        return each.select("artifact_id", F.col("r.len").alias("size"), F.sha2(F.substring(F.col("body"), F.col("r.offset").cast("int") + 1, F.col("r.len").cast("int")), 256).alias("object"))

    fixed = lambda rows, key: chunk_bodies(rows.select(F.col(key).alias("artifact_id"), "body"), size)
    ways = {
        "fixed": fixed(whole, "artifact_id").select("artifact_id", "size", "object"),
        "tensor-fixed": fixed(within, "part").select(F.split("artifact_id", "/")[0].alias("artifact_id"), "size", "object"),
        "fastcdc": by_content(whole), "tensor-fastcdc": by_content(within),
    }
    out = None
    for name, rows in ways.items():
        counts = rows.groupBy("artifact_id").agg(F.count("*").alias("n"))
        left, right = (pairs.select("pair", F.col(f"{s}_id").alias("artifact_id")).join(counts, "artifact_id").select("pair", F.col("n").alias(f"{s}_chunks")) for s in ("left", "right"))
        r = compare.reuse(pairs, rows).join(left, "pair", "left").join(right, "pair", "left").withColumn("strategy", F.lit(name))
        out = r if out is None else out.unionByName(r)
    return out.select("pair", "strategy", "left_chunks", "right_chunks", "shared_bytes", F.col("right_bytes").alias("right_size"), "reuse_pct")


@query
def delta_zstd_potential(spark, d):
    chunks = A.doc_chunks(A.doc_bodies(spark, d), keep_data=True)
    objects = chunks.groupBy("object").agg(F.first("data").alias("data"))
    return delta.potential(A.doc_pairs(spark, d), chunks.drop("data"), objects)


@query
def delta_optimize(spark, d):
    chunks = A.doc_chunks(A.doc_bodies(spark, d), keep_data=True)
    objects = chunks.groupBy("object").agg(F.first("data").alias("data"))
    reps = objects.select("object", F.lit("loose").alias("kind"), F.octet_length("data").cast("long").alias("stored_size"), F.lit(None).cast("string").alias("base"), F.lit(0).cast("long").alias("depth"))
    return delta.optimize_totals(delta.optimize(A.doc_pairs(spark, d), chunks.drop("data"), objects, reps, Policy()))


@query
def policy_simulation(spark, d):
    return delta.simulate(A.doc_pairs(spark, d), A.doc_bodies(spark, d).select("artifact_id", "body"), [256, 1024], [0, 20])


@query
def optimize_choice(spark, d):
    chunks = A.doc_chunks(A.doc_bodies(spark, d), keep_data=True)
    objects = chunks.groupBy("object").agg(F.first("data").alias("data"))
    return packs.choose_totals(packs.choose(A.representations(chunks.drop("data")), packs.encoded(objects)))


@query
def blake3_ids(spark, d):
    return A.read(spark, d, "documents").select("doc_id", blake3_hex(F.encode("text", "UTF-8")).alias("blake3"))


@query
def pack_round_trip(spark, d):
    """All objects of the documents packed, read back and verified: entries by pack and encoding."""
    bodies = A.read(spark, d, "documents").where("text is not null").select(F.lit(None).cast("string").alias("artifact_id"), F.encode("text", "UTF-8").alias("body"))
    # equal documents have equal chunks, so whole texts need not meet
    built = packs.build(packs.gathered(A.doc_chunks(bodies, keep_data=True)), one_pack=False)
    from chunkloom.model import PACK_INDEX

    made = lineage.cut(built)
    return packs.verify_totals(packs.verify(made.select(F.from_json("index", PACK_INDEX).alias("i"), "body").select("i.*", "body"), hash="sha256"))


@query
def delta_reconstruct(spark, d):
    """Every second chunk of a document kept only as a delta on the chunk before it, rebuilt, and whether it has its id."""
    chunks = A.doc_chunks(A.doc_bodies(spark, d), keep_data=True).where(F.col("size") == A.CHUNK)
    left = chunks.where("chunk_ix % 2 = 0").select("artifact_id", (F.col("chunk_ix") + 1).alias("chunk_ix"), F.col("object").alias("base"), F.col("data").alias("base_data"))

    @F.pandas_udf("binary")
    def record(target: pd.Series, base: pd.Series, base_id: pd.Series) -> pd.Series:
        return pd.Series([codec.encode_delta(bytes(t), bytes(b), i, 1) for t, b, i in zip(target, base, base_id, strict=True)], dtype=object)

    rows = chunks.join(left, ["artifact_id", "chunk_ix"]).where("object <> base").groupBy("object").agg(F.min_by(F.struct("data", "base", "base_data"), "base").alias("x"))
    records = lineage.cut(rows.select("object", F.col("x.base").alias("base"), F.lit(1).cast("long").alias("depth"), record("x.data", "x.base_data", "x.base").alias("record")))
    full = chunks.groupBy("object").agg(F.first("data").alias("data"))
    return delta.reconstruct(full, records, "sha256").select("object", "ok", F.octet_length("data").cast("long").alias("size"))


@query
def recompress_loose(spark, d):
    """Sizes of all objects before and after a change of the loose encoding."""
    objects = A.doc_chunks(A.doc_bodies(spark, d), keep_data=True).groupBy("object").agg(F.first("data").alias("stored"))
    return packs.recompress(objects, "zstd", hash="sha256").select("object", "before", F.octet_length("stored").alias("after"))


@query
def container_round_trip(spark, d):
    """Conversations written as tensor containers, parsed, and their user turns taken out into containers of their own."""
    from chunkloom.sources import containers

    parts = A.conv_parts(spark, d)
    whole = A.conv_tensors(parts).withColumn("selected_ix", F.col("tensor_ix")).withColumn("new_offset", F.col("data_offset"))
    chunks = A.conv_chunks(parts)
    objects = parts.select("payload", F.explode(ranges(F.octet_length("payload"), A.TENSOR_CHUNK)).alias("r")).select(F.substring(F.col("payload"), F.col("r.offset").cast("int") + 1, F.col("r.len").cast("int")).alias("data")).withColumn("object", F.sha2("data", 256)).dropDuplicates(["object"])
    files = materialize.assemble(whole, chunks, objects).select(F.col("artifact_id").alias("source_name"), F.col("file").alias("body"))
    arts, cuts, tensors, stored = ingest.containers(containers.inspect(lineage.cut(files)), A.CHUNK)
    users = materialize.assemble(materialize.select_tensors(tensors, prefixes=["user"]), cuts, stored)
    return users.join(arts, "artifact_id").select("source_name", F.octet_length("file").alias("file_bytes"), F.sha2("file", 256).alias("file_id"))
