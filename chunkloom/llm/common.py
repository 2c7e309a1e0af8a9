"""Shared building blocks of the operators: vectorised word spans, rolling hashes and staged tables.

Texts reach Python as Arrow batches and are handled as one byte buffer per block of documents, so that
words, lines and windows of a whole block are found with a few numpy passes instead of a loop per word.
A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, which is the pattern ``[^\\x20\\x09-\\x0D]+``
(UTF-8 never uses these bytes inside a character).
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.deploy import shared_dir

WORD = r"[^\x20\x09-\x0D]+"

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD1B54A32D192ED03
_SECOND_BASE = 0xA24BAED4963EE407


@dataclass
class Block:
    """Some documents as one buffer. ``off`` has one entry more than there are documents."""

    rows: pa.RecordBatch
    data: np.ndarray
    off: np.ndarray

    def __len__(self) -> int:
        return len(self.off) - 1


def as_block(rows: pa.RecordBatch, column: str = "text") -> Block:
    """The text column of ``rows`` as bytes; null texts are empty."""
    col = rows.column(rows.schema.get_field_index(column))
    col = col.cast(pa.large_binary())
    if len(col) == 0:
        return Block(rows, np.zeros(0, np.uint8), np.zeros(1, np.int64))
    if col.null_count:
        col = col.fill_null(b"")
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return Block(rows, raw[off[0] : off[-1]], off - off[0])


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", max_bytes: int = 1_000_000) -> Iterator[Block]:
    """Slices of the batches with about ``max_bytes`` of text each (a longer document is a block of its own)."""
    for rows in batches:
        whole = as_block(rows, column)
        at = 0
        while at < len(whole):
            to = max(at + 1, int(np.searchsorted(whole.off, whole.off[at] + max_bytes, side="right")) - 1)
            lo, hi = whole.off[at], whole.off[to]
            yield Block(rows.slice(at, to - at), whole.data[lo:hi], whole.off[at : to + 1] - lo)
            at = to
    trim()


def trim() -> None:
    """Give freed memory back to the system: workers stay for later tasks, and executors share their memory with them."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lowered(block: Block) -> Block:
    """A-Z become a-z; nothing else changes."""
    return Block(block.rows, _LOWER[block.data], block.off)


@dataclass
class Words:
    """Byte spans of all words of a block; ``first[i]:first[i + 1]`` are the words of document ``i``."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words(block: Block) -> Words:
    data, off = block.data, block.off
    solid = ~SPACE[data]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    edge = off[:-1][off[:-1] < len(data)]
    begin[edge] = solid[edge]
    end = solid.copy()
    end[:-1] &= ~solid[1:]
    edge = off[1:][off[1:] > 0] - 1
    end[edge] = solid[edge]
    starts = np.flatnonzero(begin)
    return Words(starts, np.flatnonzero(end) + 1, np.searchsorted(starts, off))


#: Tables of powers up to this length are kept, the longest of each base.
_KEPT = 1 << 21
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < size."""
    p, q = _tables.get(base, (np.zeros(0), np.zeros(0)))
    if len(p) < size:
        room = 1 << max(10, int(size - 1).bit_length()) if size <= _KEPT else size
        p, q = (np.full(room, b, dtype=np.uint64) for b in (base, pow(base, -1, 1 << 64)))
        for x in (p, q):
            x[0] = 1
            np.multiply.accumulate(x, out=x)
        if room <= _KEPT:
            _tables[base] = p, q
    return p[:size], q[:size]


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3 (fixed multipliers)."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BYTE_BASE) -> np.ndarray:
    """A 64-bit hash of each byte span, from one running polynomial sum over the buffer."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    p, inverse = powers(base, len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(_SECOND_BASE))


def window_hashes(tokens: np.ndarray, k: int, base: int = _WORD_BASE) -> np.ndarray:
    """Rabin-Karp hashes (modulo 2**64) of the k consecutive token hashes that begin at each place."""
    n = len(tokens) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    p, inverse = powers(base, len(tokens))
    total = np.zeros(len(tokens) + 1, np.uint64)
    np.cumsum(tokens * p, out=total[1:])
    return (total[k:] - total[:-k]) * inverse[:n]


def window_places(first: np.ndarray, k: int) -> np.ndarray:
    """Which of the windows of k tokens lie in one document: a mask over window_hashes()' places."""
    n = int(first[-1])
    ends = np.repeat(first[1:], np.diff(first))
    return (np.arange(n) + k <= ends)[: max(0, n - k + 1)]


def per_doc(first: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over first[i]:first[i + 1]."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct values, a place of each, and which of them stands at each place."""
    order = x.argsort()
    ordered = x[order]
    new = np.ones(len(x), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    which = np.empty(len(x), np.int64)
    which[order] = np.cumsum(new) - 1
    return ordered[new], order[new], which


def gather_spans(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Indices of all elements of the spans starts[i] : starts[i] + lengths[i], one span after another."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    begin = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - begin, lengths)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def named(columns: list[str]) -> list[F.Column]:
    """Columns by their exact names, which may hold dots."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def keyed(docs: DataFrame, key: str, nulls_first: bool = True) -> DataFrame:
    """``docs`` with a long key of each row: doc_id where each row has its own, else numbers in the order of the rows.

    Rows order by doc_id (null first, or last), a hash of the text, then the text.
    """
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        return docs.withColumn(key, F.col("doc_id").cast("long"))
    by_id = F.col("doc_id").cast("long")
    ordered = docs.orderBy(by_id.asc_nulls_first() if nulls_first else by_id.asc_nulls_last(), F.xxhash64("text"), "text")
    return staged(ordered.withColumn(key, F.monotonically_increasing_id()), "keyed")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends there, and losing an executor costs no rework."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps now rather than at some later collection."""
    import gc
    import time

    for _ in range(2):  # the cleaner works beside, on what a first collection has found
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def crc_bucket(column: str, modulus: int) -> F.Column:
    """crc32 of the id as text, modulo ``modulus``."""
    return F.crc32(F.col(column).cast("string")) % modulus


def partitions_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
