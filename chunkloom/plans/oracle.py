"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_DOCS = """
doc_ids as (select doc_id, sha256(encode(text)) as artifact_id from documents where text is not null),
arts as (select sha256(encode(text)) as artifact_id, max(doc_id) as last_doc, any_value(hex(encode(text))) as h, any_value(octet_length(encode(text)))::BIGINT as logical_size
         from documents where text is not null group by 1),
chunks as (select artifact_id, last_doc, ix::BIGINT as chunk_ix, (ix * 256)::BIGINT as "offset", least(256, logical_size - ix * 256)::BIGINT as size,
                  sha256(unhex(substr(h, (ix * 512 + 1)::BIGINT, 512))) as object
           from arts, unnest(range(0, (logical_size + 255) // 256)) as t(ix)),
pairs as (select l.doc_id // 2 as pair, l.artifact_id as left_id, r.artifact_id as right_id from doc_ids l join doc_ids r on r.doc_id = l.doc_id + 1 where l.doc_id % 2 = 0),
kept as (select distinct artifact_id from doc_ids where doc_id in (select doc_id from labels)),
kept_chunks as (select * from chunks where artifact_id in (select artifact_id from kept)),
objects as (select object, min(size) as size from chunks group by 1),
reps as (
  select object, 'loose' as kind, case when substr(object, 2, 1) < '8' then 'zstd' else 'raw' end as encoding, case when substr(object, 2, 1) < '8' then size - size // 4 else size end as stored_size, size as logical_size, null::VARCHAR as base
  from objects where substr(object, 1, 1) < 'c'
  union all select object, 'pack', 'raw', size, size, null from objects where substr(object, 1, 1) >= '8'
  union all
  select o.object, 'delta', 'delta', 77 + o.size // 8, o.size, b.base from objects o join (
    select c.object, min(p.object) as base from chunks c join chunks p on p.artifact_id = c.artifact_id and p.chunk_ix = c.chunk_ix - 1
    where substr(c.object, 1, 1) = 'f' and substr(c.object, 2, 1) < '4' and p.object <> c.object group by 1) b using (object)),
reach as (select object from kept_chunks union select base from reps where base is not null and object in (select * from reach))
"""
_CONV = """
parts as (select 'conv-' || conv_id as artifact_id, conv_id, turn, concat_ws('.', role, turn) as name, hex(encode(coalesce(text, ''))) as h from conversations),
sized as (select *, (length(h) // 2)::BIGINT as n, coalesce(sum(length(h) // 2) over w, 0)::BIGINT as start, row_number() over (partition by artifact_id order by turn, name) - 1 as tensor_ix
          from parts window w as (partition by artifact_id order by turn, name rows between unbounded preceding and 1 preceding)),
cuts as (select artifact_id, conv_id, name, start + ix * 64 as "offset", least(64, n - ix * 64)::BIGINT as size, sha256(unhex(substr(h, (ix * 128 + 1)::BIGINT, 128))) as object
         from sized, unnest(range(0, (n + 63) // 64)) as t(ix)),
cpairs as (select l.conv_id // 2 as pair, l.conv_id as l, r.conv_id as r from (select distinct conv_id from conversations) l join (select distinct conv_id from conversations) r on r.conv_id = l.conv_id + 1 where l.conv_id % 2 = 0),
forms as (select conv_id, name, any_value(n) as n, list({'o': object, 's': size} order by "offset") filter (object is not null) as seq from sized left join cuts using (conv_id, name) group by 1, 2),
sides as (select pair, name, n, seq, 'l' as side from cpairs join forms on conv_id = l union all select pair, name, n, seq, 'r' from cpairs join forms on conv_id = r),
both_ as (select coalesce(a.pair, b.pair) as pair, coalesce(a.name, b.name) as name, a.n as ln, b.n as rn,
                case when a.name is null then 'added' when b.name is null then 'removed' when a.n = b.n and a.seq is not distinct from b.seq then 'unchanged' else 'changed' end as status
         from (select * from sides where side = 'l') a full join (select * from sides where side = 'r') b on a.pair = b.pair and a.name = b.name),
common as (select p.pair, c.name, sum(c.size)::BIGINT as bytes from cpairs p join cuts c on c.conv_id = p.r where exists (select 1 from cuts x where x.conv_id = p.l and x.name = c.name and x.object = c.object) group by 1, 2),
diff as (select pair, name, status, coalesce(ln, 0)::BIGINT as left_bytes, case when status = 'removed' then 0 else rn end::BIGINT as right_bytes,
                case status when 'unchanged' then rn when 'changed' then coalesce(bytes, 0) else 0 end::BIGINT as shared_bytes from both_ left join common using (pair, name))
"""
_EDGES = """
edges as (select doc_id::VARCHAR as child, (doc_id // 2)::VARCHAR as parent from documents where doc_id > 0)
"""

_PCT = "case when {1} = 0 then 0.0 else {0}::DOUBLE / {1}::DOUBLE * 100.0 end"


def _with(*parts: str, recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}" + ",".join(parts)


_D, _C, _R = _with(_DOCS.rsplit(",\nreach", 1)[0]), _with(_CONV), _with(_DOCS, recursive=True)


def _pct(a: str, b: str) -> str:
    return _PCT.format(a, b)


def _dedup(arts: str, chunks: str) -> str:
    return f"""(select *, greatest(logical_bytes - unique_logical_bytes, 0) as dedup_savings_bytes from
      (select count(*) as artifacts, sum(logical_size)::BIGINT as logical_bytes from {arts}),
      (select sum(n)::BIGINT as chunks, count(*) as objects, sum(size)::BIGINT as unique_logical_bytes from (select object, count(*) as n, min(size) as size from {chunks} group by 1)))"""


_STORAGE = """
flat as (select (select count(*) from kept) as manifests, (select sum(logical_size)::BIGINT from arts where artifact_id in (select artifact_id from kept)) as logical_bytes),
per as (select object, sum(stored_size)::BIGINT as stored, min(stored_size) as least from reps group by 1),
agg as (select count(stored) as object_count, count(*) filter (r.object is not null and stored is not null) as reachable_objects, coalesce(sum(o.size) filter (r.object is not null), 0)::BIGINT as reachable_bytes,
               count(*) filter (r.object is null) as orphan_objects, coalesce(sum(stored) filter (r.object is null), 0)::BIGINT as orphan_bytes,
               coalesce(sum(stored - least) filter (r.object is not null), 0)::BIGINT as duplicate_representation_bytes
        from per full join (select distinct object from reach) r using (object) left join objects o using (object)),
kinds as (select coalesce(sum(stored_size) filter (kind = 'loose' and encoding = 'raw'), 0)::BIGINT as loose_raw_bytes, coalesce(sum(stored_size) filter (kind = 'loose' and encoding = 'zstd'), 0)::BIGINT as loose_compressed_bytes,
                 coalesce(sum(stored_size) filter (kind = 'delta'), 0)::BIGINT as delta_bytes, coalesce(sum(stored_size) filter (kind = 'pack'), 0)::BIGINT as pack_data_bytes,
                 0::BIGINT as pack_index_bytes, 0::BIGINT as manifest_bytes, 0::BIGINT as metadata_bytes, sum(stored_size)::BIGINT as physical_bytes from reps)
"""

_ALIGNED = """
lefts as (select pair, "offset", size, object from (select p.pair, c.*, row_number() over (partition by p.pair, c."offset", c.size order by c.chunk_ix desc) as rn from pairs p join chunks c on c.artifact_id = p.left_id) where rn = 1),
aligned as (select p.pair, c.size, c.object, l.object as lo from pairs p join chunks c on c.artifact_id = p.right_id left join lefts l on l.pair = p.pair and l."offset" = c."offset" and l.size = c.size)
"""


def _reuse(size: int) -> str:
    k = 2 * size
    chunk = f"sha256(unhex(substr(h, (ix * {k} + 1)::BIGINT, {k})))"
    return f"""select {size}::BIGINT as chunk_size, coalesce(sum(size) filter (hit), 0)::BIGINT as shared_bytes, sum(size)::BIGINT as right_bytes from (
      select c.size, exists (select 1 from c{size} x where x.artifact_id = p.left_id and x.object = c.object) as hit from pairs p join c{size} c on c.artifact_id = p.right_id)""".replace("\n", " "), (
        f"c{size} as (select artifact_id, least({size}, logical_size - ix * {size})::BIGINT as size, {chunk} as object from arts, unnest(range(0, (logical_size + {size - 1}) // {size})) as t(ix))"
    )


_BENCH = [_reuse(s) for s in (64, 256, 1024)]

SQL: dict[str, str] = {
    "dedup_efficiency": f"{_D} select *, {_pct('dedup_savings_bytes', 'logical_bytes')} as dedup_savings_pct from {_dedup('arts', 'chunks')}",
    "chunk_listing": f'{_D} select artifact_id, chunk_ix, object, "offset", size from chunks',
    "chunk_stats": f"""{_D} select artifact_id, coalesce(n, 0) as chunks, coalesce(total, 0)::BIGINT as logical_bytes, coalesce(lo, 0) as min_bytes, coalesce(hi, 0) as max_bytes, coalesce(mean, 0.0) as average_bytes, coalesce(med, 0.0) as median_bytes,
        coalesce(dup, 0)::BIGINT as exact_duplicate_chunks, coalesce(dupb, 0)::BIGINT as exact_duplicate_bytes from arts
        left join (select artifact_id, count(*) as n, sum(size) as total, min(size) as lo, max(size) as hi, avg(size) as mean, median(size)::DOUBLE as med from chunks group by 1) using (artifact_id)
        left join (select artifact_id, sum(k - 1) as dup, sum((k - 1) * size) as dupb from (select artifact_id, object, count(*) as k, min(size) as size from chunks group by 1, 2) group by 1) using (artifact_id)""",
    "chunk_dup_profile": f"{_D} select n as instances, count(*) as objects, sum(size)::BIGINT as bytes from (select object, count(*) as n, min(size) as size from chunks group by 1) group by 1",
    "artifact_attribution": f"""{_D}, held as (select artifact_id, object, sum(size) as bytes from chunks group by 1, 2), refs as (select object, count(*) as refs from held group by 1),
        byrefs as (select artifact_id, refs, sum(bytes) as bytes, sum(size) as physical from held join refs using (object) join objects using (object) group by 1, 2)
        select artifact_id, last_doc::VARCHAR as source_name, logical_size, coalesce(sh, 0)::BIGINT as shared_bytes, coalesce(ex, 0)::BIGINT as exclusive_bytes, coalesce(part, 0)::BIGINT as attributed_physical_bytes, {_pct('coalesce(sh, 0)', 'logical_size')} as shared_pct
        from arts left join (select artifact_id, sum(bytes) filter (refs > 1) as sh, sum(bytes) filter (refs = 1) as ex, round(sum(physical / refs)) as part from byrefs group by 1) using (artifact_id)""",
    "ingest_new_vs_reused": f"""{_D}, rows_ as (select size, row_number() over (partition by object order by doc_id, chunk_ix) as rn from doc_ids join chunks using (artifact_id))
        select sum(size) filter (rn = 1)::BIGINT as new_bytes, coalesce(sum(size) filter (rn > 1), 0)::BIGINT as reused_bytes, count(*) filter (rn = 1) as new_objects from rows_""",
    "tensor_listing": f"{_C} select artifact_id, tensor_ix, name, start as data_offset, n as data_size from sized",
    "tensor_chunks": f'{_C} select artifact_id, row_number() over (partition by artifact_id order by "offset") - 1 as chunk_ix, name as tensor, object, "offset"::BIGINT as "offset", size from cuts',
    "select_tensors_prefix": f"""{_C} select artifact_id, name, row_number() over (partition by artifact_id order by tensor_ix) - 1 as selected_ix,
        coalesce(sum(n) over (partition by artifact_id order by tensor_ix rows between unbounded preceding and 1 preceding), 0)::BIGINT as new_offset, n as data_size from sized where name like 'user%'""",
    "extract_overlap": f"""{_C}, whole as (select artifact_id, sum(n)::BIGINT as total from sized group by 1),
        grid as (select artifact_id, ix::BIGINT as chunk_ix, (ix * 512)::BIGINT as c0, least(total, ix * 512 + 512)::BIGINT as c1 from whole, unnest(range(0, (total + 511) // 512)) as t(ix))
        select artifact_id, name, chunk_ix, greatest(start, c0) - c0 as piece_from, least(start + n, c1) - c0 as piece_to, greatest(start, c0) - start as piece_at from sized join grid using (artifact_id) where c0 < start + n and c1 > start""",
    "model_diff": f"{_C} select * from diff",
    "model_diff_totals": f"""{_C} select pair, count(*) filter (status = 'added') as added_tensors, count(*) filter (status = 'removed') as removed_tensors, count(*) filter (status = 'changed') as changed_tensors, count(*) filter (status = 'unchanged') as unchanged_tensors,
        coalesce(sum(right_bytes) filter (status = 'added'), 0)::BIGINT as added_bytes, coalesce(sum(left_bytes) filter (status = 'removed'), 0)::BIGINT as removed_bytes,
        coalesce(sum(right_bytes - shared_bytes) filter (status = 'changed'), 0)::BIGINT as changed_bytes, sum(shared_bytes)::BIGINT as reused_bytes from diff group by 1""",
    "compare_reuse": f"""{_D}, hits as (select p.pair, c.size, exists (select 1 from chunks x where x.artifact_id = p.left_id and x.object = c.object) as hit from pairs p join chunks c on c.artifact_id = p.right_id),
        sums as (select pair, count(*) filter (hit) as shared_chunks, coalesce(sum(size) filter (hit), 0)::BIGINT as shared_bytes, sum(size)::BIGINT as right_bytes from hits group by 1),
        every as (select pair, coalesce(shared_chunks, 0) as shared_chunks, coalesce(shared_bytes, 0) as shared_bytes, coalesce(right_bytes, 0) as right_bytes from pairs left join sums using (pair))
        select *, right_bytes - shared_bytes as right_only_bytes, {_pct('shared_bytes', 'right_bytes')} as reuse_pct from every""",
    "pair_shared_objects": f"""{_D}, a as (select p.pair, c.object, min(c.size) as ls from pairs p join chunks c on c.artifact_id = p.left_id group by 1, 2), b as (select p.pair, c.object, min(c.size) as rs from pairs p join chunks c on c.artifact_id = p.right_id group by 1, 2)
        select pair, count(ls) as left_objects, count(rs) as right_objects, count(*) filter (ls is not null and rs is not null) as shared_objects, coalesce(sum(ls) filter (rs is not null), 0)::BIGINT as shared_bytes from a full join b using (pair, object) group by 1""",
    "delta_alignment": f"""{_D}, {_ALIGNED} select pair, coalesce(rc, 0) as right_chunks, coalesce(cc, 0) as changed_chunks, coalesce(ib, 0)::BIGINT as incomparable_bytes from pairs
        left join (select pair, count(*) as rc, count(*) filter (lo is not null and lo <> object) as cc, sum(size) filter (lo is null) as ib from aligned group by 1) using (pair)""",
    "manifest_violations": f"""{_D} select rule, count(*) as manifests from (
        select 'version' as rule from arts where last_doc % 29 = 0 union all select 'artifact_id' from arts where last_doc % 19 = 0 union all select 'chunk_size' from arts where last_doc % 23 = 0
        union all select 'logical_size' from arts where last_doc % 13 = 0 union all select 'chunk_offset' from arts where last_doc % 17 = 0 and logical_size > 256) group by 1""",
    "pointer_violations": f"""{_D} select rule, count(*) as pointers from (
        select 'missing_manifest' as rule from arts where last_doc % 11 = 0 union all select 'manifest_path' from arts where last_doc % 17 = 0
        union all select 'logical_size' from arts where last_doc % 13 = 0 and last_doc % 11 <> 0 union all select 'format' from arts where last_doc % 19 = 0 and last_doc % 11 <> 0) group by 1""",
    "fsck_structural": f"""{_D}, t as (select (select count(*) from arts) as scanned, (select count(*) from arts where last_doc % 29 = 0) as bad, (select count(*) from objects) as refs, (select count(*) from objects where object like '00%') as missing)
        select scanned as manifests_scanned, scanned - bad as manifests_ok, refs as referenced_objects, missing as missing_objects, 0::BIGINT as corrupt_objects, 0::BIGINT as orphan_objects, bad = 0 and missing = 0 as ok from t""",
    "fsck_deep": f"""{_D}, refs as (select distinct object from kept_chunks), t as (select (select count(*) from kept) as scanned, (select count(*) from refs) as refs, (select count(*) from refs where object like '00%') as missing,
        (select count(*) from refs where object like '01%') as corrupt, (select count(*) from objects where object not like '00%' and object not in (select object from refs)) as orphans)
        select scanned as manifests_scanned, scanned as manifests_ok, refs as referenced_objects, missing as missing_objects, corrupt as corrupt_objects, orphans as orphan_objects, missing = 0 and corrupt = 0 as ok from t""",
    "gc_orphans": f"""{_R}, o as (select object, size, substr(object, 1, 1) >= '8' as packed from objects where object not in (select object from reach))
        select count(*) as orphan_objects, coalesce(sum(size), 0)::BIGINT as orphan_bytes, count(*) filter (not packed) as removable_objects, coalesce(sum(size) filter (not packed), 0)::BIGINT as removable_bytes from o""",
    "storage_report": f"{_R}, {_STORAGE} select * from flat, agg, kinds",
    "storage_breakdown": f"{_R}, {_STORAGE} select * from kinds",
    "efficiency_report": f"""{_R}, {_STORAGE}, karts as (select * from arts where artifact_id in (select artifact_id from kept)),
        sizes as (select object, min(stored_size) filter (kind <> 'delta') as full_size, min(stored_size) as primary_size from reps where object in (select object from reach) group by 1),
        s as (select coalesce(sum(full_size) filter (object in (select object from kept_chunks)), 0)::BIGINT as full_encoded_bytes, sum(primary_size)::BIGINT as primary_encoded_bytes from sizes),
        t as (select e.*, s.*, a.duplicate_representation_bytes, 0::BIGINT as metadata_overhead_bytes, k.physical_bytes as actual_physical_bytes from {_dedup('karts', 'kept_chunks')} e, s, agg a, kinds k),
        u as (select *, greatest(unique_logical_bytes - full_encoded_bytes, 0) as compression_savings_bytes, greatest(full_encoded_bytes - primary_encoded_bytes, 0) as delta_savings_bytes, logical_bytes - actual_physical_bytes as net_physical_savings_bytes from t)
        select *, {_pct('dedup_savings_bytes', 'logical_bytes')} as dedup_savings_pct, {_pct('compression_savings_bytes', 'unique_logical_bytes')} as compression_savings_pct, {_pct('delta_savings_bytes', 'full_encoded_bytes')} as delta_savings_pct,
        {_pct('net_physical_savings_bytes', 'logical_bytes')} as net_physical_savings_pct from u""",
    "delta_closure": f"{_R} select distinct object from reach",
    "sync_plan": f"""{_D} select artifact_id, object, min(size) as size, count(*) as instances, case when object in (select object from kept_chunks) then 'reuse' when object like '00%' then 'missing' else 'copy' end as action from chunks group by artifact_id, object""",
    "sync_totals": f"""{_D}, p as (select artifact_id, object, min(size) as size, count(*) as k, case when object in (select object from kept_chunks) then 'reuse' when object like '00%' then 'missing' else 'copy' end as action from chunks group by artifact_id, object)
        select artifact_id, count(*) filter (action = 'copy') as objects_copied, coalesce(sum(size) filter (action = 'copy'), 0)::BIGINT as bytes_copied, count(*) filter (action = 'reuse') as objects_reused, coalesce(sum(size * k) filter (action = 'reuse'), 0)::BIGINT as bytes_reused,
        count(*) filter (action = 'missing') as objects_missing from p group by 1""",
    "lineage_ancestry": f"""{_with(_EDGES, "walk as (select doc_id::VARCHAR as root, doc_id::VARCHAR as node, 0::BIGINT as depth from documents union all select root, parent, depth + 1 from walk join edges on child = node)", recursive=True)}
        select root as root_id, count(*) filter (depth > 0) as edges, max(depth) as depth from walk group by 1""",
    "lineage_missing": f"""{_with(_EDGES, "walk as (select doc_id as root, doc_id as node, 0::BIGINT as depth, false as missing from documents union all select root, parent::BIGINT, depth + 1, parent::BIGINT % 5 = 0 from walk join edges on child = node::VARCHAR where not missing and depth < 3)", recursive=True)}
        select depth, count(*) as nodes, count(*) filter (missing) as missing, count(*) filter (depth = 3 and not missing and node > 0) as truncated from walk group by 1""",
    "lineage_cycle_check": f"""{_with(_EDGES, "ids as (select doc_id as n from documents where doc_id > 3)", "asked as (select (n // 4)::VARCHAR as c, n::VARCHAR as p from ids union all select n::VARCHAR, (n + 1)::VARCHAR from ids)", "up as (select distinct p as root, p as node from asked union select root, parent from up join edges on child = node)", recursive=True)}
        select c as child_id, p as parent_id, exists (select 1 from up where root = p and node = c) as cycle from asked""",
    "pack_layout": f"""{_D} select substr(object, 1, 2) as pack, object, coalesce(sum(size) over (partition by substr(object, 1, 2) order by object rows between unbounded preceding and 1 preceding), 0)::BIGINT as "offset", size as stored_size
        from objects where substr(object, 1, 1) < '8'""",
    "snapshot_compare": f"""{_D}, karts as (select * from arts where artifact_id in (select artifact_id from kept))
        select b.artifacts - a.artifacts as manifests_delta, b.objects - a.objects as objects_delta, b.logical_bytes - a.logical_bytes as logical_bytes_delta, b.unique_logical_bytes - a.unique_logical_bytes as unique_logical_bytes_delta,
        b.unique_logical_bytes - a.unique_logical_bytes as actual_physical_bytes_delta, b.dedup_savings_bytes - a.dedup_savings_bytes as net_physical_savings_bytes_delta from {_dedup('karts', 'kept_chunks')} a, {_dedup('arts', 'chunks')} b""",
    "page_revisions": "select page_id, case when page_id % 3 = 0 then 'rev' || page_id end as revision from pages",
    "benchmark_fixed": f"{_D}, {', '.join(c for _, c in _BENCH)} select *, {_pct('shared_bytes', 'right_bytes')} as reuse_pct from ({' union all '.join(q for q, _ in _BENCH)})",
    "materialize_bodies": f"{_D} select artifact_id, artifact_id as digest, logical_size as bytes, true as ok from arts",
    "materialize_verify": f"""{_D} select artifact_id, case when bool_or(object like '00%') then 'missing object' when bool_or(object like '01%') then 'corrupt object' end as error from arts left join chunks using (artifact_id) group by 1""",
    "lineage_insert": f"{_with(_EDGES)} select child as child_id, parent as parent_id, 'prune' as operation from edges where child::BIGINT % 3 <> 0",
    "pointer_advice": f"""{_D} select artifact_id || '.mvptr' as pointer, greatest((select count(*) from arts) - 20, 0) as more from arts order by 1 limit 20""",
    "path_predicates": """with p as (select page_id, url, sha256(url) as id, page_id % 2 = 1 as odd from pages)
        select page_id, 'objects/' || substr(id, 1, 2) || '/' || substr(id, 3) as path, case when odd then id end as key_id, true as hex, odd as name_ok, url like 'http://%' as insecure from p""",
    "delta_reconstruct": f"""{_D}, w as (select * from chunks where size = 256)
        select distinct c.object, true as ok, 256::BIGINT as size from w c join w p on p.artifact_id = c.artifact_id and p.chunk_ix = c.chunk_ix - 1 where c.chunk_ix % 2 = 1 and c.object <> p.object""",
}

_BENCHED = "with objects as (select sha256(encode(text)) as object, any_value(octet_length(encode(text)))::BIGINT as n from benchmark where text is not null group by 1)"

SQL |= {
    "manifest_round_trip": f"""{_D} select artifact_id, case when last_doc % 2 = 0 then 'again-' else '' end || last_doc as source_name, artifact_id || '.json' as file, logical_size, ((logical_size + 255) // 256)::BIGINT as chunks from arts""",
    "manifest_scan_errors": f"""{_D}, m as (select last_doc % 11 = 0 as torn, last_doc % 13 = 0 as old, last_doc % 17 = 0 as size from arts)
        select rule, files from (select 'json' as rule, count(*) filter (torn) as files from m union all select 'version', count(*) filter (old and not torn) from m union all select 'logical_size', count(*) filter (size and not torn) from m) where files > 0
        union all select 'sound', count(*) filter (not torn and not old and not size) from m""",
    "pointer_round_trip": f"""{_D} select case when last_doc % 5 = 0 then 'b/.hidden/' else '' end || artifact_id || case when last_doc % 3 = 0 then '.MVPTR' else '.mvptr' end as pointer, artifact_id, 'manifests/' || artifact_id || '.json' as manifest, logical_size from arts where last_doc % 11 <> 0""",
    "store_listing": f"""{_BENCHED} select object, 'loose' as kind, n as logical_size, null::VARCHAR as base, 0::BIGINT as depth, n as loose_bytes from objects
        union all select object, 'pack', n, null, 0, null from objects where object >= '8'
        union all select object, 'delta', n, sha256(repeat('x', n)), 1, null from objects where object >= 'c'""",
    "store_objects": f"{_BENCHED} select object, true as ok, n as size from objects",
    "pack_lookup": f"{_BENCHED} select object, case when object >= '6' then 'pack-a.mvpack' else 'pack-b.mvpack' end as pack_file, n as size from objects",
    "repack_counts": f"""{_BENCHED}, c as (select count(*) as n, count(*) filter (object >= '8') as packed, count(*) filter (object >= 'c') as deltas from objects)
        select 'pack' as kind, n from c union all select 'loose', packed from c where packed > 0 union all select 'delta', deltas from c where deltas > 0
        union all select 'report objects', n - packed from c union all select 'report pruned', n - packed from c""",
    "compact_counts": f"{_BENCHED} select 'pack' as kind, count(*) as n, sum(n)::BIGINT as bytes, count(*) as sound from objects",
    "gc_prune": f"""{_BENCHED} select count(*) filter (not k) as orphan_objects, coalesce(sum(n) filter (not k), 0)::BIGINT as orphan_bytes, count(*) filter (k) as loose_left from (select *, right(object, 1) in ('0', '1') as k from objects)""",
    "put_objects": f"{_BENCHED} select object, 1::BIGINT as n, true as sound, substr(object, 1, 1) in ('0', '5', '7') as written from objects",
    "remote_audit": f"""{_D}, refs as (select distinct object from chunks where last_doc % 7 <> 0), o as (select object, size, object in (select object from refs) as named, substr(object, 1, 2) as p from objects)
        select count(*) filter (p not in ('00', '02', '03')) as objects, count(*) filter (named) as referenced_objects, count(*) filter (named and p in ('00', '02', '03')) as missing_objects, count(*) filter (named and p = '01') as corrupt_objects,
          count(*) filter (not named and p not in ('00', '02', '03')) as orphan_objects, coalesce(sum(size) filter (not named and p not in ('00', '02', '03')), 0)::BIGINT as orphan_bytes, count(*) filter (p = '03') as bad_keys, false as ok from o""",
    "raw_file_scan": """select 'page-' || page_id || case page_id % 4 when 0 then '.bin' when 1 then '.safetensors' when 2 then '.SafeTensors' else '' end as source_name, sha256(encode(html)) as artifact_id, octet_length(encode(html))::BIGINT as bytes,
        case when page_id % 4 in (1, 2) then 'safetensors' else 'raw' end as format from pages where html is not null""",
    "container_headers": f"""{_C} select artifact_id as source_name, row_number() over (partition by artifact_id order by encode(name)) - 1 as ix, name, 'U8' as dtype, start as payload_offset, n as data_size, null::VARCHAR as error from sized""",
    "lineage_lines": """with e as (select doc_id::VARCHAR as c, (doc_id // 2)::VARCHAR as p, 'merge' as op from documents where doc_id > 0 union all select doc_id::VARCHAR, (doc_id // 5)::VARCHAR, 'base' from documents where doc_id > 0)
        select c as root_id, c || '>' || p as path, op as operation, op = 'merge' as last from e union all select a.c, a.c || '>' || a.p || '>' || b.p, b.op, b.op = 'merge' from e a join e b on b.c = a.p""",
    "hub_lookup": """select path, snapshot from (select '/hub/models--org--m/snapshots/r' || page_id % 50 || '/f1.bin' as path, 'r' || page_id % 50 as snapshot, page_id * 7919 % 1000 as modified from pages where page_id % 3 = 1) order by modified desc, path limit 1""",
    "hub_provenance": """select page_id, 'huggingface' as provider, case when page_id % 2 = 0 then 'org' end as namespace, case when page_id % 2 = 0 then 'org/m' || page_id else 'm' || page_id end as repository, 'm' || page_id as model_name,
        case when page_id % 5 = 0 then 'main' end as requested_revision, case when page_id % 3 = 0 then 'rev' || page_id end as resolved_revision, 'f.bin' as filename,
        'hf://' || case when page_id % 2 = 0 then 'org/m' || page_id else 'm' || page_id end || case when page_id % 3 = 0 then '@rev' || page_id when page_id % 5 = 0 then '@main' else '' end || '/f.bin' as source_uri from pages""",
    "diff_report": f"""{_C}, whole as (select conv_id, sum(n)::BIGINT as total from sized group by 1), t as (select pair, count(*) filter (status = 'unchanged') as c3, count(*) filter (status = 'changed') as c4, count(*) filter (status = 'added') as c5, count(*) filter (status = 'removed') as c6,
          sum(shared_bytes)::BIGINT as c7, coalesce(sum(right_bytes) filter (status = 'added'), 0)::BIGINT as c8, coalesce(sum(left_bytes) filter (status = 'removed'), 0)::BIGINT as c9, coalesce(sum(right_bytes - shared_bytes) filter (status = 'changed'), 0)::BIGINT as c10 from diff group by 1),
        named as (select * from (values (3, 'Unchanged'), (4, 'Changed'), (5, 'Added'), (6, 'Removed'), (7, 'Reused right bytes'), (8, 'Added bytes'), (9, 'Removed bytes'), (10, 'Changed right bytes')) as v(part, label))
        select pair, 1::INTEGER as part, '' as name, '| Left | `conv-' || l || '` | conv-' || l || '.bin | ' || total || ' | 0 | none |' as line from cpairs join whole on conv_id = l
        union all select pair, 2, '', '| Right | `conv-' || r || '` | conv-' || r || '.bin | ' || total || ' | 0 | none |' from cpairs join whole on conv_id = r
        union all select pair, part, '', '- ' || label || ': ' || [c3, c4, c5, c6, c7, c8, c9, c10][part - 2] from t cross join named
        union all select pair, 11, name, printf('| %s | %s | %d | %.2f%% |', name, status, right_bytes, {_pct('shared_bytes', 'right_bytes')}) from diff where status <> 'unchanged'""",
    "snapshot_round_trip": f"""{_D} select 1::INTEGER as format_version, artifacts as manifests, logical_bytes, chunks, objects, unique_logical_bytes, dedup_savings_bytes, {_pct('dedup_savings_bytes', 'logical_bytes')} as dedup_savings_pct from {_dedup('arts', 'chunks')}""",
    "delta_eligibility": """select 'o' || doc_id as target, 'o' || (doc_id - 1) as base, case doc_id % 5 when 1 then 1 when 2 then 2 when 3 then 3 when 4 then 1 else 2 end::BIGINT as depth,
        case doc_id % 5 when 3 then 'depth' when 0 then 'savings below the policy' end as reason from documents where doc_id % 10 <> 0""",
    "sync_run": f"""{_D}, tasks as (select artifact_id, object, min(size) as size, count(*) as k from chunks group by 1, 2), there as (select distinct object from kept_chunks),
        planned as (select *, case when object in (select object from there) then 'reuse' when object not like '00%' then case when row_number() over (partition by object order by artifact_id) = 1 then 'copy' else 'reuse' end else 'missing' end as action from tasks)
        select artifact_id, count(*) filter (action = 'copy') as objects_copied, coalesce(sum(size) filter (action = 'copy'), 0)::BIGINT as bytes_copied, count(*) filter (action = 'reuse') as objects_reused, coalesce(sum(size * k) filter (action = 'reuse'), 0)::BIGINT as bytes_reused,
          count(*) filter (action = 'missing') as objects_missing from planned group by 1""",
    "path_targets": """select page_id, case page_id % 6 when 0 then '/root/a/f' || page_id when 2 then '/root/x/f' || page_id when 5 then '/root/f' || page_id end as target from pages""",
    "content_defined_cover": f"{_D} select artifact_id, logical_size as covered_bytes, true as bounded from arts",
    "delta_headers": """select doc_id, case when ok then sha256(encode(text)) end as base, case when ok then doc_id % 4 end as depth, case when ok then octet_length(encode(text))::BIGINT end as size from (select *, doc_id % 7 <> 0 and doc_id % 4 <> 0 as ok from documents where text is not null)""",
    "positional_chunks": f"""{_D} select p.pair, count(*) as right_chunks, count(l.object) as placed, count(*) filter (l.object = c.object) as equal from pairs p join chunks c on c.artifact_id = p.right_id left join chunks l on l.artifact_id = p.left_id and l.chunk_ix = c.chunk_ix and l.size = c.size group by 1""",
    "ingest_files": """with a as (select sha256(encode(html)) as artifact_id, max('page-' || page_id) as source_name, any_value(hex(encode(html))) as h, any_value(octet_length(encode(html)))::BIGINT as n from pages where html is not null group by 1)
        select artifact_id, source_name, n as logical_size, count(*) as chunks, count(distinct substr(h, (ix * 2048 + 1)::BIGINT, 2048)) as objects from a, unnest(range(0, (n + 1023) // 1024)) as t(ix) group by 1, 2, 3""",
}
