"""Manifests, pointers, snapshots and configuration as tables."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkloom.model import LINEAGE, MANIFEST, POINTER, lineage_edges
from chunkloom.operators import lineage
from chunkloom.operators.validate import manifest_violations
from chunkloom.sources.files import read_files, write_files

_BAD = "_corrupt"


def _json(spark: SparkSession, path: str, schema: T.StructType, pattern: str, mode: str) -> DataFrame:
    """One record per file, with its path; in PERMISSIVE mode what cannot be parsed is in the column _BAD.

    The files are listed and read once, by the executors; the records are written to the shared folder.
    """
    if mode == "PERMISSIVE":
        schema = T.StructType([*schema.fields, T.StructField(_BAD, T.StringType())])
    record = F.from_json(F.col("content").cast("string"), schema, {"mode": mode, "columnNameOfCorruptRecord": _BAD})
    return lineage.cut(read_files(spark, path, pattern).select("path", record.alias("r"))).select("r.*", "path")


def scan_tolerant(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Sound manifests, and (path, rule, detail) of what is wrong with the others."""
    rows = _json(spark, f"{root}/manifests", MANIFEST, "*.[jJ][sS][oO][nN]", "PERMISSIVE")
    broken = rows.where(F.col(_BAD).isNotNull()).select("path", F.lit("json").alias("rule"), F.col(_BAD).alias("detail"))
    parsed = rows.where(F.col(_BAD).isNull()).drop(_BAD)
    found = manifest_violations(parsed, "path").unionByName(broken)
    return parsed.join(found.select("path").distinct(), "path", "left_anti"), found


def scan(spark: SparkSession, root: str) -> DataFrame:
    """All manifests by path; the first unsound one is an error."""
    rows = _json(spark, f"{root}/manifests", MANIFEST, "*.[jJ][sS][oO][nN]", "FAILFAST")
    worst = manifest_violations(rows, "path").groupBy("path").agg(F.min(F.concat_ws(": ", "rule", "detail")).alias("why"))
    checked = rows.join(worst, "path", "left")
    message = F.concat(F.lit("invalid manifest "), "path", F.lit(": "), "why")
    return checked.withColumn("version", F.when(F.col("why").isNotNull(), F.raise_error(message)).otherwise(F.col("version"))).drop("why").orderBy("path")


def _lean(records: DataFrame, *lists: str) -> DataFrame:
    """Empty lists become null, which JSON leaves out."""
    for name in lists:
        records = records.withColumn(name, F.when(F.size(name) > 0, F.col(name)))
    return records


def save(manifests: DataFrame, root: str) -> int:
    """One file ``manifests/<id>.json`` for each id, replacing what it held; unsound manifests raise before any is written.

    Of several rows of one id the one whose JSON is greatest stays. Meant to run once the objects are in their place.
    """
    worst = manifest_violations(manifests).limit(1).collect()
    if worst:
        raise ValueError(f"invalid manifest {worst[0].artifact_id}: {worst[0].rule} {worst[0].detail}")
    names = [f.name for f in MANIFEST.fields]
    record = F.to_json(F.struct(*names), {"ignoreNullFields": "true"})
    files = _lean(manifests.select(*names), "lineage", "tensors").select(F.concat(F.lit("manifests/"), F.lower("artifact_id"), F.lit(".json")).alias("path"), record.alias("json"))
    return write_files(files.groupBy("path").agg(F.max("json")), root)


def save_pointers(pointers: DataFrame, root: str) -> int:
    """One file for each row of ``pointers``, at its ``pointer`` path below root (``<source name>.mvptr`` where it has none)."""
    names = [f.name for f in POINTER.fields]
    path = F.col("pointer") if "pointer" in pointers.columns else F.concat("source_name", F.lit(".mvptr"))
    lean = _lean(pointers.withColumn("_path", path), "lineage")
    return write_files(lean.groupBy("_path").agg(F.max(F.to_json(F.struct(*names), {"ignoreNullFields": "true"}))), root)


def _pointer_paths(spark: SparkSession, root: str, limit: int, skipped: tuple[str, ...]) -> tuple[list[str], str]:
    """Paths of the pointer files below root, hidden folders included (Spark's readers pass these over), and root's own path."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    path = fs.makeQualified(path)
    out, folders = [], [path]
    while folders:
        for status in fs.listStatus(folders.pop()):
            name = status.getPath().getName()
            if status.isDirectory():
                folders += [status.getPath()] if name not in skipped else []
            elif name.lower().endswith(".mvptr"):
                out.append(status.getPath().toString())
                if len(out) > limit:
                    raise ValueError(f"more than {limit} pointers")
    return out, path.toString()


def pointers(spark: SparkSession, root: str, limit: int = 10_000, skipped: tuple[str, ...] = (".git", ".modelstore")) -> DataFrame:
    """Pointer files below ``root`` with their path there, in order; folders of the names ``skipped`` are left out, too many are an error."""
    found, base = _pointer_paths(spark, root, limit, skipped)
    if not found:
        return spark.createDataFrame([], T.StructType([*POINTER.fields, T.StructField("pointer", T.StringType())]))
    files = spark.read.format("binaryFile").load(found)
    record = F.from_json(F.col("content").cast("string"), POINTER, {"mode": "FAILFAST"})
    return files.select(record.alias("r"), F.substring(F.col("path"), F.lit(len(base) + 2), F.length("path")).alias("pointer")).select("r.*", "pointer").orderBy("pointer")


def derive(manifests: DataFrame, proposed: DataFrame, root: str, pointer_root: str | None = None) -> DataFrame:
    """Record parents of artifacts: refuse cycles, add the edges that are new, save the manifests and their pointers.

    proposed: child_id, parent_id, operation, note. Returns the manifests that changed, as they were saved.
    """
    edges = lineage_edges(manifests)
    known = proposed.select("child_id").distinct().join(manifests.select(F.lower("artifact_id").alias("child_id")), "child_id", "left_anti").limit(1).collect()
    if known:
        raise ValueError(f"unknown artifact {known[0].child_id}")
    # the proposed edges take part, so that two of them cannot close a cycle together
    everything = edges.unionByName(proposed.select(*edges.columns))
    bad = lineage.would_cycle(everything, proposed.select("child_id", "parent_id").distinct()).where("cycle").limit(1).collect()
    if bad:
        raise ValueError(f"lineage cycle: {bad[0].child_id} and {bad[0].parent_id}")
    new = lineage.insert_edges(edges, proposed)
    added = new.groupBy("child_id").agg(F.array_sort(F.collect_list(F.struct(F.col("parent_id").alias("parent_artifact_id"), "operation", "note"))).alias("added"))
    changed = manifests.join(added, F.lower("artifact_id") == F.col("child_id"))
    changed = lineage.cut(changed.withColumn("lineage", F.concat(F.coalesce("lineage", F.array().cast(LINEAGE)), F.col("added").cast(LINEAGE))).select(*manifests.columns))
    save(changed, root)
    if pointer_root is not None:
        save_pointers(from_manifests(changed, "manifests"), pointer_root)
    return changed


def save_snapshot(row: DataFrame, path: str) -> int:
    """A one-row snapshot as one JSON file."""
    folder, _, name = path.rpartition("/")
    return write_files(row.select(F.lit(name).alias("path"), F.to_json(F.struct(*row.columns))), folder)


def load_snapshot(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The snapshot of a file; a format version other than 1 is an error."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    version = F.when(F.col("format_version").eqNullSafe(F.lit(1)), F.col("format_version")).otherwise(F.raise_error(F.lit("unsupported snapshot version")))
    return rows.withColumn("format_version", version)


def from_manifests(manifests: DataFrame, folder: str) -> DataFrame:
    """The pointer of each manifest."""
    reference = F.concat(F.lit(f"{folder}/"), F.lower("artifact_id"), F.lit(".json"))
    return manifests.select(F.lit(1).alias("version"), "artifact_id", "format", "logical_size", reference.alias("manifest"), "source_name", "provenance", "lineage")


def advice(found: DataFrame, shown: int = 20) -> DataFrame:
    """The first pointers by path, each with how many more there are."""
    more = found.agg(F.greatest(F.count("*") - shown, F.lit(0)).alias("more"), F.lit(1).alias("one"))
    return found.orderBy("pointer").limit(shown).select("pointer", F.lit(1).alias("one")).join(more, "one").drop("one")


class Remotes:
    """Named destinations, kept as JSON: filesystem paths or buckets. The first one added becomes the default."""

    def __init__(self, remotes: dict[str, dict] | None = None, default: str | None = None) -> None:
        self.remotes, self.default = dict(remotes or {}), default

    @classmethod
    def loads(cls, text: str | None) -> Remotes:
        """No text: no remotes."""
        raw = json.loads(text) if text else {}
        return cls(raw.get("remotes"), raw.get("default"))

    def dumps(self) -> str:
        return json.dumps({"default": self.default, "remotes": dict(sorted(self.remotes.items()))}, indent=2)

    def add(self, name: str, path: str | None = None, bucket: str | None = None, prefix: str = "", **more) -> None:
        if not re.fullmatch(r"[A-Za-z0-9._-]+", name or ""):
            raise ValueError("remote names have letters, digits, dots, dashes and underscores")
        if name in self.remotes:
            raise ValueError(f"remote {name} exists")
        if (path is None) == (not bucket):
            raise ValueError("a remote has either a path or a bucket")
        if int(more.get("max_attempts", 1)) < 1:
            raise ValueError("max_attempts must be at least 1")
        self.remotes[name] = {"type": "filesystem", "path": path} if path else {"type": "s3", "bucket": bucket, "prefix": prefix.strip("/"), **more}
        self.default = self.default or name

    def remove(self, name: str) -> None:
        if self.remotes.pop(name, None) is None:
            raise KeyError(name)
        self.default = None if self.default == name else self.default

    def use(self, name: str) -> None:
        if name not in self.remotes:
            raise KeyError(name)
        self.default = name

    def resolve(self, name: str | None = None) -> tuple[str, dict]:
        name = name or self.default
        if name is None or name not in self.remotes:
            raise KeyError(name or "no default remote")
        return name, self.remotes[name]

    def url(self, name: str | None = None) -> str:
        """The Hadoop path of a remote."""
        r = self.resolve(name)[1]
        return r["path"] if r["type"] == "filesystem" else "/".join(x for x in (f"s3a://{r['bucket']}", r["prefix"]) if x)
