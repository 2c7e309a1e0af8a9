"""Harmonic packing of token sequences.

A document's ids are cut into pieces of the capacity C; the rest is cut again so that its pieces fall just below
C / k for some k. Pieces of class k, with lengths in (C / (k + 1), C / k], fill bins of exactly k pieces; the smallest
class is filled by total length. Pieces are dealt by a hash to groups of bounded size that fill their bins without
knowledge of each other; the fewer than k pieces that a group has left of each class fill bins first-fit by length.

Defined results: a null or empty text is one piece, the end id alone; repeated rows are documents of their own; rows
without doc_id are packed with a null id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.llm.common import blocks, read, staged
from chunkloom.llm.subwords import Subwords

CAPACITY, CLASSES, SLACK, END = 2048, 64, 16, 1
#: Pieces of one group, without and with their ids.
GROUP, ID_GROUP = 50_000, 5_000

_PIECES = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
_SQL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def piece_lengths(total: int, capacity: int = CAPACITY) -> list[int]:
    """Full pieces, then pieces of just C / k, until the rest wastes no more than SLACK in its class or is of the smallest."""
    out = [capacity] * (total // capacity)
    rest = total % capacity
    while rest:
        k = capacity // rest
        if k >= CLASSES or capacity // k - rest <= SLACK:
            out.append(rest)
            break
        out.append(capacity // (k + 1))
        rest -= out[-1]
    return out


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """The pieces of every document, each with a checksum of its ids (and the ids as little-endian 32-bit numbers)."""
    schema = pa.schema([*_PIECES, *([("ids", pa.binary())] if with_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Subwords.shared(tokenizer)
        for b in blocks(batches):
            ids, first = coder.ids(b)
            whole = np.insert(ids, first[1:], END).astype("<u4")
            begin = first[:-1] + np.arange(len(b))
            total = (np.diff(first) + 1).tolist()
            lengths = [piece_lengths(n, capacity) for n in total]
            counts = np.fromiter(map(len, lengths), np.int64, len(b))
            size = np.array([x for each in lengths for x in each], np.int64)
            doc = np.repeat(np.arange(len(b)), counts)
            at = np.cumsum(size) - size
            raw = memoryview(whole.tobytes())
            spans = [raw[4 * a : 4 * (a + n)] for a, n in zip(at.tolist(), size.tolist(), strict=True)]
            crc = np.fromiter(map(zlib.crc32, spans), np.int64, len(spans))
            columns = [b.rows.column(0).take(pa.array(doc)), at - begin[doc], size, crc, np.asarray(total)[doc]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns] + ([pa.array([s.tobytes() for s in spans], pa.binary())] if with_ids else []), schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SQL + (", ids binary" if with_ids else ""))


def fill(size: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The bin of each piece of one group."""
    kind = np.minimum(capacity // size, CLASSES)
    out = np.full(len(size), -1, np.int64)
    made, rest = 0, []
    for k in np.unique(kind):
        mine = np.flatnonzero(kind == k)
        if k < CLASSES:
            full = len(mine) // k * k
            out[mine[:full]] = made + np.arange(full) // k
            made += full // k
            rest += mine[full:].tolist()
            continue
        used = capacity
        for i in mine.tolist():
            if used + size[i] > capacity:
                made, used = made + 1, 0
            out[i] = made - 1
            used += size[i]
    free = np.zeros(0, np.int64)
    for i in sorted(rest, key=lambda i: (-size[i], i)):
        fits = np.flatnonzero(free >= size[i])
        if len(fits) == 0:
            free, fits = np.append(free, capacity), [len(free)]
        free[fits[0]] -= size[i]
        out[i] = made + fits[0]
    return out


def pack(parts: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``parts`` (staged pieces, with or without their ids) with sequence_id and offset."""
    n = max(1, math.ceil(parts.count() / group))
    columns = [*_PIECES, *([("ids", pa.binary())] if "ids" in parts.columns else [])]
    schema = pa.schema([*columns, ("sequence_id", pa.int64()), ("offset", pa.int64())])
    sql = _SQL + (", ids binary" if "ids" in parts.columns else "") + ", sequence_id long, offset long"

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in ("doc_id", "start", "length", "ids_crc32")])
        size = rows.column("length").to_numpy()
        bins = fill(size, capacity)
        order = np.argsort(bins, kind="stable")
        total = np.cumsum(size[order]) - size[order]
        head = np.flatnonzero(np.concatenate([[True], np.diff(bins[order]) > 0]))
        offset = np.empty(len(size), np.int64)
        offset[order] = total - np.repeat(total[head], np.diff(np.append(head, len(size))))
        unique = bins * n + rows.column("bucket")[0].as_py()
        return pa.Table.from_arrays([*(rows.column(c).cast(t) for c, t in columns), pa.array(unique), pa.array(offset)], schema=schema)

    bucket = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(n)).cast("int")
    lean = parts.select(*(c for c, _ in columns)).withColumn("bucket", bucket)
    return lean.groupBy("bucket").applyInArrow(run, sql)


def sequences(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, pad: int = 0) -> DataFrame:
    """sequence_id, ids (array of ``capacity`` ids; a sequence whose length is a power of two is not padded), doc_ids."""
    parts = staged(pieces(docs, tokenizer, capacity, with_ids=True), "pieces")
    joined = pack(parts, capacity, ID_GROUP).select("doc_id", "ids", "sequence_id", "offset")

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("offset")
        ids = np.frombuffer(b"".join(rows.column("ids").to_pylist()), "<u4").astype(np.int32)
        short = len(ids) & (len(ids) - 1)
        ids = np.append(ids, np.full(capacity - len(ids), pad, np.int32)) if short else ids
        return pa.table({"sequence_id": rows.column("sequence_id").slice(0, 1), "ids": pa.array([ids], pa.list_(pa.int32())), "doc_ids": pa.array([rows.column("doc_id").to_pylist()], pa.list_(pa.int64()))})

    return joined.groupBy("sequence_id").applyInArrow(run, "sequence_id long, ids array<int>, doc_ids array<long>")


def packed(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    return pack(staged(pieces(docs, tokenizer, capacity), "pieces"), capacity)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(read(spark, sf_dir, "documents"))
