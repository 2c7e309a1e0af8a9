"""Artifacts from their chunks: whole bodies, byte ranges of tensors, and selections of tensors."""

from __future__ import annotations

import json
import struct

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunkloom.functions.ranges import digest
from chunkloom.operators.validate import coverage


def _join_bytes(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """by, body: the bytes of ``data`` in order. A body must fit in one row's two gigabytes."""
    parts = F.array_sort(F.collect_list(F.struct(order, "data")))
    return rows.groupBy(*by).agg(F.unhex(F.array_join(F.transform(parts, lambda p: F.hex(p["data"])), "")).alias("body"))


def bodies(artifacts: DataFrame, chunks: DataFrame, objects: DataFrame, hash: str = "sha256") -> DataFrame:
    """artifact_id, body, ok of every artifact; null bodies where a chunk's object is missing."""
    rows = chunks.join(objects.select("object", "data"), "object", "left")
    made = _join_bytes(rows.where("data is not null"), ["artifact_id"], "chunk_ix")
    lost = rows.where("data is null").select("artifact_id").distinct().withColumn("lost", F.lit(True))
    out = artifacts.select("artifact_id", "logical_size").join(made, "artifact_id", "left").join(lost, "artifact_id", "left")
    body = F.when(F.col("lost").isNull(), F.coalesce("body", F.unhex(F.lit(""))))
    return out.select("artifact_id", "logical_size", body.alias("body")).withColumn("ok", F.coalesce((digest(F.col("body"), hash) == F.col("artifact_id")) & (F.octet_length("body") == F.col("logical_size")), F.lit(False))).drop("logical_size")


def verify(artifacts: DataFrame, chunks: DataFrame, objects: DataFrame, hash: str = "sha256") -> DataFrame:
    """artifact_id, error (null: sound): coverage, then each object, then the whole."""
    gaps = coverage(chunks).where(F.col("offset") != F.col("expected_offset")).select("artifact_id").distinct().withColumn("gap", F.lit(True))
    rows = chunks.join(objects.select("object", "data"), "object", "left")
    bad = F.when(F.col("data").isNull(), 2).when((digest(F.col("data"), hash) != F.col("object")) | (F.octet_length("data") != F.col("size")), 1).otherwise(0)
    worst = rows.groupBy("artifact_id").agg(F.max(bad).alias("worst"))
    whole = bodies(artifacts, chunks, objects, hash).select("artifact_id", "ok")
    joined = artifacts.select("artifact_id").join(gaps, "artifact_id", "left").join(worst, "artifact_id", "left").join(whole, "artifact_id", "left")
    error = F.when(F.col("gap"), "coverage").when(F.col("worst") == 2, "missing object").when(F.col("worst") == 1, "corrupt object").when(~F.col("ok"), "identity")
    return joined.select("artifact_id", error.alias("error"))


def overlaps(tensors: DataFrame, chunks: DataFrame, cell: int | None = None) -> DataFrame:
    """Tensor x chunk pieces: artifact_id, name, object, chunk_ix, from (in the object), to, at (in the tensor).

    Intervals meet in cells of ``cell`` bytes of their artifact, so that the join has equality keys and never compares
    all chunks of an artifact with all its tensors. By default a cell is as long as the artifact's longest chunk.
    """
    t = tensors.select("artifact_id", "name", F.col("data_offset").alias("t0"), (F.col("data_offset") + F.col("data_size")).alias("t1")).where("t1 > t0")
    c = chunks.select("artifact_id", "object", "chunk_ix", F.col("offset").alias("c0"), (F.col("offset") + F.col("size")).alias("c1")).where("c1 > c0")
    if cell is None:
        longest = c.groupBy("artifact_id").agg(F.max(F.col("c1") - F.col("c0")).alias("cell"))
        t, c = t.join(longest, "artifact_id"), c.join(longest, "artifact_id")
    else:
        t, c = t.withColumn("cell", F.lit(cell).cast("long")), c.withColumn("cell", F.lit(cell).cast("long"))
    cells = lambda lo, hi: F.explode(F.sequence((F.col(lo) / F.col("cell")).cast("long"), ((F.col(hi) - 1) / F.col("cell")).cast("long")))
    t, c = t.withColumn("at_cell", cells("t0", "t1")).drop("cell"), c.withColumn("at_cell", cells("c0", "c1"))
    lo, hi = F.greatest("t0", "c0"), F.least("t1", "c1")
    met = t.join(c, ["artifact_id", "at_cell"]).where((lo < hi) & ((lo / F.col("cell")).cast("long") == F.col("at_cell")))
    return met.select("artifact_id", "name", "object", "chunk_ix", (lo - F.col("c0")).alias("from"), (hi - F.col("c0")).alias("to"), (lo - F.col("t0")).alias("at"))


def tensor_bytes(tensors: DataFrame, chunks: DataFrame, objects: DataFrame) -> DataFrame:
    """artifact_id, name, body of tensors."""
    rows = overlaps(tensors, chunks).join(objects.select("object", "data"), "object")
    part = F.substring(F.col("data"), F.col("from").cast("int") + 1, (F.col("to") - F.col("from")).cast("int"))
    made = _join_bytes(rows.withColumn("data", part), ["artifact_id", "name"], "at")
    return tensors.select("artifact_id", "name").join(made, ["artifact_id", "name"], "left").withColumn("body", F.coalesce("body", F.unhex(F.lit(""))))


def select_tensors(tensors: DataFrame, names: list[str] = (), prefixes: list[str] = ()) -> DataFrame:
    """Tensors by exact name or prefix, each artifact's in manifest order, with selected_ix and the offset in a new file.

    No selector, an empty or a repeated one is an error; so is, when the result is used, one that finds nothing in an
    artifact.
    """
    selectors = [*names, *prefixes]
    if not selectors or any(not s for s in selectors):
        raise ValueError("empty selection")
    if len(set(names)) != len(names) or len(set(prefixes)) != len(prefixes):
        raise ValueError("duplicate selector")
    tests = [F.col("name") == n for n in names] + [F.col("name").startswith(p) for p in prefixes]
    whole = Window.partitionBy("artifact_id")
    found = F.array(*(F.max(t.cast("int")).over(whole) for t in tests))
    any_ = tests[0]
    for t in tests[1:]:
        any_ = any_ | t
    checked = tensors.withColumn("_found", F.array_min(found))
    kept = checked.where(any_ | (F.col("_found") == 0))
    name = F.when(F.col("_found") == 0, F.raise_error(F.lit("a selector matches no tensor"))).otherwise(F.col("name"))
    kept = kept.withColumn("name", name).drop("_found")
    before = Window.partitionBy("artifact_id").orderBy("tensor_ix").rowsBetween(Window.unboundedPreceding, -1)
    rank = F.row_number().over(Window.partitionBy("artifact_id").orderBy("tensor_ix")).cast("long") - 1
    return kept.withColumn("selected_ix", rank).withColumn("new_offset", F.coalesce(F.sum("data_size").over(before), F.lit(0)).cast("long"))


def assemble(selected: DataFrame, chunks: DataFrame, objects: DataFrame) -> DataFrame:
    """artifact_id, file: a tensor container with the selected tensors, header in name order, payload in manifest order."""
    rows = selected.join(tensor_bytes(selected, chunks, objects), ["artifact_id", "name"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        header = {r.name_: {"dtype": r.dtype, "shape": [int(x) for x in r.shape], "data_offsets": [int(r.new_offset), int(r.new_offset + r.data_size)]} for r in pdf.sort_values("name_").itertuples()}
        raw = json.dumps(header, separators=(",", ":"), ensure_ascii=False).encode()
        return pd.DataFrame({"artifact_id": [pdf["artifact_id"].iloc[0]], "file": [struct.pack("<Q", len(raw)) + raw + b"".join(pdf.sort_values("selected_ix")["body"])]})

    return rows.withColumnRenamed("name", "name_").groupBy("artifact_id").applyInPandas(run, "artifact_id string, file binary")
