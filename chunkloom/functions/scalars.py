"""Small scalar functions of paths, ids and provenance, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chunkloom.model import HEX64

#: Fixed value: where a hub's files are fetched from, for provenance.
HUB = "hf://"


def is_object_id(column: Column) -> Column:
    return F.coalesce(column.rlike(HEX64), F.lit(False))


def object_path(column: Column) -> Column:
    return F.concat(F.lit("objects/"), F.substring(column, 1, 2), F.lit("/"), F.substring(column, 3, 62))


def delta_path(column: Column) -> Column:
    return F.concat(F.lit("deltas/"), F.substring(column, 1, 2), F.lit("/"), F.substring(column, 3, 62), F.lit(".mvdelta"))


def canonical_key_id(key: Column) -> Column:
    """The object id of a canonical object key, or null: xx/rest, lower case, under objects/."""
    found = F.regexp_extract(key, "^(?:.*/)?objects/([0-9a-f]{2})/([0-9a-f]{62})$", 0)
    return F.when(found != "", F.concat(F.regexp_extract(key, "objects/([0-9a-f]{2})/([0-9a-f]{62})$", 1), F.regexp_extract(key, "objects/([0-9a-f]{2})/([0-9a-f]{62})$", 2)))


def little_endian(data: Column) -> Column:
    """An unsigned number of up to eight bytes, least significant first (a decimal, as it may pass a long)."""
    return F.conv(F.hex(_reversed(data)), 16, 10).cast("decimal(20,0)")


def _reversed(data: Column) -> Column:
    parts = F.transform(F.sequence(F.octet_length(data), F.lit(1), F.lit(-1)), lambda i: F.substring(F.hex(data), 2 * i - 1, F.lit(2)))
    return F.unhex(F.array_join(parts, ""))


def snapshot_revision(path: Column) -> Column:
    """The path's component after the first one named snapshots, or null."""
    parts = F.split(F.translate(path, "\\", "/"), "/")
    at = F.array_position(parts, "snapshots")
    return F.when(at > 0, F.nullif(F.get(parts, at.cast("int")), F.lit("")))


def provenance(repo: Column, requested: Column, path: Column, filename: Column) -> Column:
    """Where a cached hub file comes from; its local path is not part of it."""
    parts = F.split(repo, "/")
    resolved = snapshot_revision(path)
    revision = F.coalesce(resolved, requested)
    return F.struct(
        F.lit("huggingface").alias("provider"), F.when(F.size(parts) > 1, parts[0]).alias("namespace"), repo.alias("repository"), F.element_at(parts, -1).alias("model_name"),
        requested.alias("requested_revision"), resolved.alias("resolved_revision"), filename.alias("filename"),
        F.concat(F.lit(HUB), repo, F.coalesce(F.concat(F.lit("@"), revision), F.lit("")), F.lit("/"), filename).alias("source_uri"),
    )


def remote_name_ok(name: Column) -> Column:
    return F.coalesce(name.rlike("^[A-Za-z0-9._-]+$"), F.lit(False))


def insecure_endpoint(endpoint: Column) -> Column:
    """Plain http to a host that is not this machine."""
    host = F.regexp_extract(F.lower(endpoint), r"^http://(?:[^/@]*@)?(\[[^\]]*\]|[^/:?#]*)", 1)
    return F.lower(endpoint).startswith("http://") & ~host.isin("localhost", "[::1]") & ~host.rlike(r"^127\.\d+\.\d+\.\d+$")


def mib_per_second(bytes_: Column, ms: Column) -> Column:
    return F.when(ms == 0, F.lit(0.0)).otherwise(bytes_ / 1048576.0 / (ms / 1000.0))


def is_container(name: Column) -> Column:
    """Whether a file is to be read as a tensor container, by its extension."""
    return F.lower(F.regexp_extract(name, r"[^/\\]\.([^./\\]+)$", 1)) == "safetensors"


def artifact_format(name: Column, wanted: Column | None = None) -> Column:
    """The format a file is read in: the one wanted, or by its extension where that is null or ``auto``."""
    chosen = F.when(is_container(name), "safetensors").otherwise("raw")
    return chosen if wanted is None else F.when(wanted.isNull() | (wanted == "auto"), chosen).otherwise(wanted)


def target_path(root: str, requested: Column) -> Column:
    """Where a requested path lies, or null if it leaves ``root``: relative ones must not go up, absolute ones must lie inside.

    Links are not followed: the paths need not exist.
    """
    parts = F.split(requested, "/")
    relative = ~requested.startswith("/")
    up = F.array_contains(parts, "..")
    kept = F.filter(parts, lambda p: (p != "") & (p != "."))
    steps = F.aggregate(
        kept, F.array().cast("array<string>"),
        lambda a, p: F.when(p != "..", F.concat(a, F.array(p))).otherwise(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))),
    )
    flat = F.concat(F.lit("/"), F.array_join(steps, "/"))
    base = root.rstrip("/")
    inside = flat.startswith(base + "/")
    return F.when(relative & ~up & (F.size(kept) > 0), F.concat(F.lit(base + "/"), F.array_join(kept, "/"))).when(~relative & inside, flat)
