"""Small files listed, read, written, replaced and deleted by the executors, each under its own name.

Spark's writers choose their own file names; stores that other tools read need given ones. Every task writes its rows'
files beside their place and moves them there, so that a repeated task replaces what it wrote before. Spark's readers
list on the driver, which holds every file of a folder at once; read_files() has one task list them in passing.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from fnmatch import fnmatchcase

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names in a batch of a listing; files and bytes in a batch of their contents.
LISTED, READ_ROWS, READ_BYTES = 10_000, 2000, 8 << 20


def _open(root: str) -> tuple[pafs.FileSystem, str]:
    local = re.sub(r"^file:/+", "/", root)
    return (pafs.LocalFileSystem(), local.rstrip("/")) if local.startswith("/") else pafs.FileSystem.from_uri(root.rstrip("/"))


def _reachable(root: str) -> bool:
    """Whether workers can write below root themselves; other file systems go through Hadoop's API."""
    try:
        _open(root)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def write_files(files: DataFrame, root: str) -> int:
    """Write (path below root, bytes) rows; returns their number."""
    if not _reachable(root):
        return _through_driver(files, root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(root)
        for rows in batches:
            for path, data in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                final = f"{base}/{path}"
                folder, name = final.rsplit("/", 1)
                part = f"{folder}/.{name}.{uuid.uuid4().hex}"
                fs.create_dir(folder, recursive=True)
                with fs.open_output_stream(part) as out:
                    out.write(data)
                fs.move(part, final)
            yield pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64())], names=["n"])

    named = files.toDF("path", "data").select("path", F.col("data").cast("binary"))
    return int(named.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0)


def _below(fs: pafs.FileSystem, base: str) -> Iterator[tuple[str, bool]]:
    """(name, whether it is a folder) of what a folder has, local ones without holding the whole listing."""
    if isinstance(fs, pafs.LocalFileSystem):
        with os.scandir(base) as found:
            yield from ((x.name, x.is_dir()) for x in found)
    else:
        yield from ((x.base_name, x.type == pafs.FileType.Directory) for x in fs.get_file_info(pafs.FileSelector(base)))


def read_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """path, content of the files below root whose names match; as for Spark's readers, names that begin with . or _ are hidden.

    One task lists, and sends names only; the files are dealt by name and read where they arrive.
    """
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    if not _reachable(root) or not there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
        return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root).select("path", "content")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(root)
        for _ in batches:
            folders, names = [""], []
            while folders:
                folder = folders.pop()
                for name, is_folder in _below(fs, f"{base}/{folder}".rstrip("/")):
                    if name[0] in "._":
                        continue
                    if is_folder:
                        folders.append(f"{folder}{name}/")
                    elif fnmatchcase(name, pattern):
                        names.append(folder + name)
                    if len(names) == LISTED:
                        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["name"])
                        names = []
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["name"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(root)
        shown = f"file:{base}" if isinstance(fs, pafs.LocalFileSystem) else root.rstrip("/")
        made = lambda paths, bodies: pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(bodies, pa.binary())], names=["path", "content"])
        paths, bodies, size = [], [], 0
        for rows in batches:
            for name in rows.column(0).to_pylist():
                with fs.open_input_stream(f"{base}/{name}", compression=None) as file:
                    bodies.append(file.read())
                paths.append(f"{shown}/{name}")
                size += len(bodies[-1])
                if len(paths) == READ_ROWS or size > READ_BYTES:
                    yield made(paths, bodies)
                    paths, bodies, size = [], [], 0
        yield made(paths, bodies)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return spark.range(0, 1, 1, 1).mapInArrow(listed, "name string").repartition(parts, "name").mapInArrow(run, "path string, content binary")


def delete_files(paths: DataFrame, root: str) -> int:
    """Delete the files whose path below root is the first column; those that are gone already do not count."""
    if not _reachable(root):
        raise ValueError(f"cannot delete below {root}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(root)
        for rows in batches:
            n = 0
            for path in rows.column(0).to_pylist():
                if fs.get_file_info(f"{base}/{path}").type == pafs.FileType.File:
                    fs.delete_file(f"{base}/{path}")
                    n += 1
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return int(paths.toDF("path").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0)


def _through_driver(files: DataFrame, root: str) -> int:
    spark = files.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    for row in files.toLocalIterator():
        final, part = jvm.org.apache.hadoop.fs.Path(f"{root}/{row[0]}"), jvm.org.apache.hadoop.fs.Path(f"{root}/{row[0]}.part")
        fs = final.getFileSystem(conf)
        out = fs.create(part, True)
        out.write(bytearray(row[1]))
        out.close()
        fs.delete(final, False)
        fs.rename(part, final)
        n += 1
    return n
