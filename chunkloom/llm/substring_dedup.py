"""Removal of repeated passages, by Rabin-Karp hashes of every window of words.

Each block of documents hashes all its windows with one rolling sum, keeps the first window of each hash (later ones
repeat it, wherever else it occurs) and sends the firsts to buckets by the hash's upper bits: seven bytes a window for
the lower ones, with document and place packed beside in little more than one. A bucket counts the hashes it got from all blocks; all but the earliest window of a hash repeat.
Repeated windows go back to their documents, where they merge into maximal intervals of words to remove. A passage that
a third of all documents share thus reaches its bucket once per block, not once per document.

The bucket and the lower 56 bits are taken as a window's identity, about 62 bits for a hundred buckets: with n windows
some n * n / 2**63 pairs collide by chance.

Defined results: a null text has no words and is kept as the empty text; a text shorter than a window is never cut;
windows order by doc_id (null first), then place; rows that repeat a doc_id (or have none) are documents of their own, in
the order of a hash of the text, then of the text: of equal rows the later ones repeat the first; an empty table gives
no rows; other columns are carried along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.llm.common import Block, blocks, gather_spans, keyed, named, per_doc, read, release, span_hashes, staged, window_hashes, window_places, words

WINDOW = 20
#: Text whose windows make one bucket, and text that one task cuts.
BUCKET_BYTES, HOME_BYTES = 8_000_000, 16_000_000
NO_ID = -(1 << 63)
_SENT = pa.schema([("bucket", pa.int32()), ("hashes", pa.binary()), ("ids", pa.binary()), ("places", pa.binary())])
_SENT_SQL = "bucket int, hashes binary, ids binary, places binary"
_BACK = pa.schema([("home", pa.int32()), ("ids", pa.binary()), ("places", pa.binary())])


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal values begin, and their lengths."""
    if len(x) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    return at, np.diff(np.append(at, len(x)))


def home_of(ids: np.ndarray, n: int) -> np.ndarray:
    """The group of a row key, the same in Python and in Spark (home_column); keys in even steps spread too."""
    return (np.mod(ids, 2147483647).astype(np.uint64) * np.uint64(2654435761) % np.uint64(4294967291) % np.uint64(n)).astype(np.int32)


def home_column(key: str, n: int) -> F.Column:
    part = F.pmod(F.col(key), F.lit(2147483647).cast("long")) * F.lit(2654435761)
    return F.pmod(F.pmod(part, F.lit(4294967291)), F.lit(n).cast("long")).cast("int")


def _packed(ids: np.ndarray, places: np.ndarray) -> list[bytes]:
    """Document ids once per run and run lengths (compressed), and the steps between places: a byte each, wide ones apart."""
    at, size = _runs(ids)
    step = np.diff(places, prepend=0)
    step[at] = places[at]
    wide = (step < 0) | (step >= 255)
    head = zstandard.ZstdCompressor(level=1).compress(np.diff(ids[at], prepend=0).astype(np.int64).tobytes() + size.astype(np.uint32).tobytes())
    return [head, np.where(wide, 255, step).astype(np.uint8).tobytes() + step[wide].astype(np.int32).tobytes() + np.uint32(len(step)).tobytes()]


def _unpacked(head: bytes, steps: bytes) -> tuple[np.ndarray, np.ndarray]:
    head = zstandard.ZstdDecompressor().decompress(head)
    runs = len(head) // 12
    ids, size = np.cumsum(np.frombuffer(head, np.int64, runs)), np.frombuffer(head, np.uint32, runs, 8 * runs).astype(np.int64)
    n = int(np.frombuffer(steps, np.uint32, 1, len(steps) - 4)[0])
    step = np.frombuffer(steps, np.uint8, n).astype(np.int64)
    step[step == 255] = np.frombuffer(steps[n:-4], np.int32)
    total = np.cumsum(step)
    at = np.cumsum(size) - size
    return np.repeat(ids, size), total - np.repeat(total[at] - step[at], size)


def _seven(hashes: np.ndarray) -> bytes:
    """The low 56 bits of each hash; its bucket stands for more."""
    return hashes.view(np.uint8).reshape(-1, 8)[:, :7].tobytes()


def _from_seven(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 7, 8), np.uint8)
    out[:, :7] = np.frombuffer(raw, np.uint8).reshape(-1, 7)
    return out.view(np.uint64).reshape(-1)


def _later(hashes: np.ndarray, ids: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A mask of the windows whose hash also begins at an earlier (id, place)."""
    out = np.zeros(len(hashes), dtype=bool)
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    if not same.any():
        return out
    tied = np.zeros(len(hashes), dtype=bool)
    tied[1:] |= same
    tied[:-1] |= same
    some = order[tied]
    some = some[np.lexsort((places[some], ids[some], hashes[some]))]
    begin = np.concatenate([[True], hashes[some[1:]] != hashes[some[:-1]]])
    group = np.cumsum(begin) - 1
    first = some[np.flatnonzero(begin)][group]
    out[some] = (ids[some] != ids[first]) | (places[some] != places[first])
    return out


def _windows(b: Block, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """hashes, document ids and places of all windows of a block."""
    w = words(b)
    inside = np.flatnonzero(window_places(w.first, k))
    hashes = window_hashes(span_hashes(b.data, w.starts, w.ends), k)[inside]
    doc = w.doc[inside]
    ids = b.rows.column(0).fill_null(NO_ID).to_numpy()
    return hashes, ids[doc], inside - w.first[doc]


def repeated_windows(docs: DataFrame, k: int, buckets: int, homes: int) -> DataFrame:
    """home, ids, places: the windows that an earlier one repeats, packed for the groups of documents they belong to."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, max_bytes=2_000_000):
            hashes, ids, places = _windows(b, k)
            order = np.lexsort((places, ids)) if np.any(ids[1:] < ids[:-1]) else np.arange(len(ids))
            hashes, ids, places = hashes[order], ids[order], places[order]
            later = _later(hashes, ids, places)
            group = ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            by = np.argsort(group.astype(np.uint16) if buckets <= 65536 else group, kind="stable")
            out: list[list] = [[], [], [], []]
            at, size = _runs(group[by])
            for lo, n in zip(at, size, strict=True):
                mine = by[lo : lo + n]
                send_on, known = mine[~later[mine]], mine[later[mine]]
                for column, value in zip(out, [int(group[mine[0]]), _seven(hashes[send_on]), *_packed(ids[send_on], places[send_on])], strict=True):
                    column.append(value)
                if len(known):
                    for column, value in zip(out, [int(group[mine[0]]), None, *_packed(ids[known], places[known])], strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _SENT, strict=True)], schema=_SENT)

    def count(rows: pa.Table) -> pa.Table:
        parts = [(h, *_unpacked(*x)) for h, *x in zip(*(rows.column(c).to_pylist() for c in ("hashes", "ids", "places")), strict=True)]
        sent = [x for x in parts if x[0] is not None]
        cat = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
        hashes = cat([_from_seven(x[0]) for x in sent], np.uint64)
        ids, places = cat([x[1] for x in sent], np.int64), cat([x[2] for x in sent], np.int64)
        later = _later(hashes, ids, places)
        ids = cat([ids[later], *(x[1] for x in parts if x[0] is None)], np.int64)
        places = cat([places[later], *(x[2] for x in parts if x[0] is None)], np.int64)
        home = home_of(ids, homes)
        order = np.lexsort((places, ids, home))
        home, ids, places = home[order], ids[order], places[order]
        at, size = _runs(home)
        made = [[int(home[lo]), *_packed(ids[lo : lo + n], places[lo : lo + n])] for lo, n in zip(at, size, strict=True)]
        return pa.Table.from_arrays([pa.array([m[i] for m in made], f.type) for i, f in enumerate(_BACK)], schema=_BACK)

    sent = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(send, _SENT_SQL)
    return sent.groupBy("bucket").applyInArrow(count, "home int, ids binary, places binary")


def cut(b: Block, ids: np.ndarray, places: np.ndarray, k: int, key: str) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Word counts, removed words and the kept text (words joined by a space) of each document. ids and places are sorted."""
    w = words(b)
    own = b.rows.column(b.rows.schema.get_field_index(key)).fill_null(NO_ID).to_numpy()
    lo, hi = np.searchsorted(ids, own), np.searchsorted(ids, own, side="right")
    doc = np.repeat(np.arange(len(own)), hi - lo)
    at = places[gather_spans(hi - lo, lo)]
    real = at + k <= w.counts[doc]
    begin = (w.first[doc] + at)[real]
    cover = np.zeros(int(w.first[-1]) + 1, np.int64)
    np.add.at(cover, begin, 1)
    np.add.at(cover, begin + k, -1)
    gone = np.cumsum(cover)[:-1] > 0
    stay = np.flatnonzero(~gone)
    size = w.ends[stay] - w.starts[stay] + 1
    text = np.full(int(size.sum()), 32, np.uint8)
    to = np.cumsum(size) - size
    text[gather_spans(size - 1, to)] = b.data[gather_spans(size - 1, w.starts[stay])]
    removed = per_doc(w.first, gone)
    ends = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(w.counts - removed))]
    raw = text.tobytes()
    return w.counts, removed, [raw[a : max(a, z - 1)] for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def remove_repeats(docs: DataFrame, k: int = WINDOW, digest_only: bool = False) -> DataFrame:
    """``docs`` with n_words, n_removed and either the kept text in the place of text, or only its SHA-256.

    A text of which nothing is removed stays as it is, white space included; others become words joined by a space. With ``digest_only`` the columns are doc_id, n_words, n_removed and kept_sha256.
    """
    spark = docs.sparkSession
    size = int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    n = max(1, -(-size // HOME_BYTES))
    names = ["doc_id"] if digest_only else [c for c in docs.columns if c not in ("text", "n_words", "n_removed")]
    key, home = "_key", "_home"
    if digest_only:
        plain = names
        docs = keyed(docs.select("doc_id", "text"), key)
    else:  # positions for names: Spark's grouped functions do not take dots
        plain = ["doc_id" if c == "doc_id" else f"_{i}" for i, c in enumerate(names)]
        docs = keyed(docs.select(*(c.alias(p) for c, p in zip(named(names), plain, strict=True)), "text"), key)
    final, names = names, plain
    found = staged(repeated_windows(docs.select(F.col(key).alias("doc_id"), "text"), k, max(1, -(-size // BUCKET_BYTES)), n), "repeats")
    release(spark)
    sql = ", ".join([*(f"{c} {t}" for c, t in docs.select(*names).dtypes), "n_words long, n_removed long", "kept_sha256 string" if digest_only else "text string"])
    kinds = [("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256" if digest_only else "text", pa.string())]

    def finish(mine: pa.Table, gone: pa.Table) -> Iterator[pa.RecordBatch]:
        parts = [_unpacked(*x) for x in zip(*(gone.column(c).to_pylist() for c in ("ids", "places")), strict=True)]
        ids, places = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(2))
        order = np.lexsort((places, ids))
        ids, places = ids[order], places[order]
        for b in blocks(iter(mine.combine_chunks().to_batches())):
            counts, removed, kept = cut(b, ids, places, k, key)
            if digest_only:
                last = pa.array([hashlib.sha256(x).hexdigest() for x in kept])
            else:
                same = b.rows.column(b.rows.schema.get_field_index("text")).cast(pa.string())
                last = pc.if_else(pa.array(removed == 0), same, pa.array(kept, pa.binary()).cast(pa.string()))
            own = [b.rows.column(b.rows.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*own, pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), last], names=[*names, *(x for x, _ in kinds)])

    def run(mine: pa.Table, gone: pa.Table) -> pa.Table:
        made = list(finish(mine, gone))
        if made:
            return pa.Table.from_batches(made)
        fields = [mine.schema.field(c) for c in names] if mine.num_columns else []
        return pa.Table.from_batches([], schema=pa.schema([*fields, *kinds]))

    left = docs.select(*names, key, "text").withColumn(home, home_column(key, n)).groupBy(home)
    return left.cogroup(found.groupBy("home")).applyInArrow(run, sql).toDF(*final, *(x for x, _ in kinds))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return remove_repeats(docs, digest_only=True)
