"""Raw files and tensor containers (eight bytes of header length, a JSON header, then the payload).

Spark's binaryFile source reads a file as one row, which limits it to two gigabytes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.functions.scalars import is_container, little_endian  # noqa: F401

#: Fixed value: the longest header that is read.
MAX_HEADER = 100 * 1024 * 1024

_TENSOR = "struct<name: string, dtype: string, shape: array<long>, data_offset: long, data_size: long>"
_PARSED = f"payload_start long, tensors array<{_TENSOR}>, error string"


def raw_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, source_name (the file's own name), body."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return rows.select("path", F.element_at(F.split("path", "/"), -1).alias("source_name"), F.col("content").alias("body"))


def parse_header(body: bytes, cover: bool = True, size: int | None = None) -> dict:
    """payload_start and tensors by name, with offsets in the file; raises where the container is malformed.

    ``body`` may end after the header if ``size``, the file's length, is given. With ``cover`` the tensors must fill the
    payload without gaps or overlaps.
    """
    size = len(body) if size is None else size
    if len(body) < 8:
        raise ValueError("truncated container")
    n = int.from_bytes(body[:8], "little")
    if n > MAX_HEADER:
        raise ValueError("header exceeds the limit")
    start = 8 + n
    if start > size:
        raise ValueError("truncated header")
    found = []
    for name, t in sorted(json.loads(body[8:start]).items(), key=lambda x: x[0].encode()):
        if name == "__metadata__":
            continue
        lo, hi = t["data_offsets"]
        if not 0 <= lo <= hi or start + hi > size:
            raise ValueError(f"tensor {name} is outside of the payload")
        found.append({"name": name, "dtype": t["dtype"], "shape": [int(x) for x in t["shape"]], "data_offset": start + lo, "data_size": hi - lo})
    if cover:
        at = start
        for t in sorted(found, key=lambda t: (t["data_offset"], t["data_size"])):
            if t["data_offset"] != at:
                raise ValueError("gap or overlap in the payload")
            at += t["data_size"]
        if at != size:
            raise ValueError("payload is not covered")
    return {"payload_start": start, "tensors": found}


def inspect(files: DataFrame, cover: bool = True) -> DataFrame:
    """``files`` (path, source_name, body) with payload_start, tensors by name, and error (null: sound).

    Only the headers go to Python.
    """

    @F.pandas_udf(_PARSED)
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for headers, sizes in parts:
            out = []
            for header, size in zip(headers, sizes, strict=True):
                try:
                    out.append(parse_header(bytes(header), cover, int(size)) | {"error": None})
                except (ValueError, KeyError, TypeError, json.JSONDecodeError) as e:
                    out.append({"payload_start": None, "tensors": None, "error": str(e)})
            yield pd.DataFrame(out, columns=["payload_start", "tensors", "error"]).astype({"payload_start": "Int64"})

    n = F.least(little_endian(F.substring(F.col("body"), 1, 8)), F.lit(MAX_HEADER)).cast("int")
    header = F.substring(F.col("body"), F.lit(1), F.coalesce(n, F.lit(0)) + 8)
    return files.withColumn("h", run(header, F.octet_length("body"))).select("*", "h.*").drop("h")


def hub_file(files: DataFrame, repo: str, filename: str, revision: str | None = None) -> DataFrame:
    """The path of a cached hub file among ``files`` (path, modified): one row, or none.

    With a revision: that snapshot, or the one its ref names (rows with ``content``). Without: main's, else the newest.
    """
    folder = "models--" + repo.replace("/", "--")
    here = files.where(F.col("path").contains(f"/{folder}/"))
    inside = F.regexp_extract("path", r"/snapshots/([^/]+)/(.+)$", 1).alias("snapshot"), F.regexp_extract("path", r"/snapshots/([^/]+)/(.+)$", 2).alias("file")
    found = here.select("path", "modified", *inside).where(F.col("file") == filename)
    ref = here.where(F.col("path").endswith(f"/{folder}/refs/{revision or 'main'}")).select(F.regexp_replace(F.col("content").cast("string"), r"^\s+|\s+$", "").alias("snapshot")).withColumn("order", F.lit(1))
    wanted = found.join(ref, "snapshot", "left").withColumn("order", F.when(F.col("snapshot") == (revision or "main"), 0).otherwise(F.coalesce("order", F.lit(2))))
    wanted = wanted.where("order < 2") if revision else wanted
    return wanted.orderBy("order", F.desc("modified"), "path").limit(1).select("path", "snapshot")
