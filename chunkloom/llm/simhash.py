"""Near duplicates by SimHash fingerprints and BK-trees.

Texts with one fingerprint are one vertex, so copies cost nothing after the fingerprint. Distinct fingerprints are dealt
to shards of about ``TREE`` members: of three blocks of bits, two fingerprints that differ in two bits or fewer agree in
one, so that a shard takes as its key as many bits of one block as the number of fingerprints asks for. A shard becomes a
BK-tree (children keyed by their Hamming distance to the parent) in the task that holds it, and all of its members follow
only the edges within the radius. Shards meet their queries by the shard key; they are not broadcast to all tasks, as
only a shard's own members can match its tree and what is broadcast would grow with the data. A shard above
``SHARD_LIMIT`` members is dealt again by three blocks of its remaining bits, which after four rounds bounds every tree
by 2**14 members whatever the data. A shard reports a spanning forest of its links; star contraction joins the forests.

Defined results: a null or blank text has fingerprint zero and links like any other; a text of fewer words than a
shingle is hashed whole; rows without doc_id get the component of their fingerprint (null if no member has an id);
repeated rows stay; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.llm.common import keyed, mix, partitions_of, read, staged
from chunkloom.llm.components import components

SHINGLE, RADIUS, SEED = 3, 2, 42
TREE, SHARD_LIMIT = 1024, 4096
ALL = (1 << 64) - 1


def fingerprint(text: str | None, k: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of the text's lower-cased shingles of k words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(size) - 1
    k = min(k, len(words))
    starts = (ends - size + 1)[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(joined[a:b], seed) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)])
    bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, k: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            marks = np.fromiter((fingerprint(t.as_py(), k, seed) for t in rows.column(1)), np.uint64, len(rows))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(marks.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints: of one number each, or of a row of numbers each."""
    bits = np.bitwise_count(a ^ b)
    return bits.astype(np.int64) if bits.ndim == 1 else bits.sum(axis=1, dtype=np.int64)


class BKTree:
    """Values (numbers, or rows of numbers) under a root, the first; a child hangs on the edge that is its Hamming distance to the parent.

    ``child[node, distance]`` is the child on that edge, or -1. Inserting one value after another gives the same tree as
    here, where all values walk down together, level by level.
    """

    def __init__(self, values: np.ndarray) -> None:
        self.values = values
        self.bits = 64 * (values.shape[1] if values.ndim == 2 else 1)
        edges, below = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        at, rest = np.zeros(len(values), np.int64), np.arange(1, len(values))
        while len(rest):
            edge = at[rest] * (self.bits + 1) + distance(values[rest], values[at[rest]])
            keys, first, which = np.unique(edge, return_index=True, return_inverse=True)
            edges.append(keys)
            below.append(rest[first])
            at[rest] = rest[first][which]
            rest = rest[at[rest] != rest]
        order = np.argsort(np.concatenate(edges))
        self.edges, self.below = np.concatenate(edges)[order], np.concatenate(below)[order]

    @property
    def child(self) -> np.ndarray:
        table = np.full((len(self.values), self.bits + 1), -1, np.int32)
        table.reshape(-1)[self.edges] = self.below
        return table

    def within(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Pairs of places (query, value) within the radius, and how many nodes were visited."""
        q, node, visited = np.arange(len(queries)), np.zeros(len(queries), np.int64), 0
        found = []
        while len(q) and len(self.values):
            visited += len(q)
            d = distance(queries[q], self.values[node])
            near = d <= radius
            found.append(np.stack([q[near], node[near]]))
            lo = np.searchsorted(self.edges, node * (self.bits + 1) + np.maximum(d - radius, 0))
            n = np.searchsorted(self.edges, node * (self.bits + 1) + np.minimum(d + radius, self.bits), "right") - lo  # edges in reach
            q = np.repeat(q, n)
            node = self.below[np.arange(len(q)) + np.repeat(lo - (np.cumsum(n) - n), n)]
        both = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        return both[0], both[1], visited


def forest(members: np.ndarray, radius: int) -> np.ndarray:
    """Links (member, the first member of its group) that join all members whose chains of links join them."""
    tree, label = BKTree(members), np.arange(len(members))
    for lo in range(0, len(members), 1024):
        i, j, _ = tree.within(members[lo : lo + 1024], radius)
        i = i + lo
        while True:
            a, b = label[i], label[j]
            i, j = i[a != b], j[a != b]
            if len(i) == 0:
                break
            a, b = label[i], label[j]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(label, label[label]):
                label = label[label]
    out = np.flatnonzero(label != np.arange(len(members)))
    return np.stack([members[out], members[label[out]]], axis=1)


def first_masks(n: int, parts: int) -> list[int]:
    """The bits that key the shards of n fingerprints: of each of ``parts`` blocks, as many as make shards of about TREE members."""
    bits = max(0, -(-n // TREE) - 1).bit_length()
    cuts = [64 * i // parts for i in range(parts + 1)]
    return [sum(1 << b for b in range(lo, min(hi, lo + bits))) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)] if bits else [0]


def submasks(mask: int, parts: int) -> list[int]:
    """``mask`` with one of ``parts`` runs of the remaining bits added, for each run."""
    free = [b for b in range(64) if not mask >> b & 1]
    cuts = [len(free) * i // parts for i in range(parts + 1)]
    return [mask | sum(1 << b for b in free[lo:hi]) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]


def set_fingerprints(hashes: np.ndarray, first: np.ndarray, words: int) -> np.ndarray:
    """The SimHash of each set of 64-bit hashes (those of set i from first[i] to first[i + 1]), 64 * words bits; an empty set's is zero."""
    sizes = np.diff(first)
    some = np.flatnonzero(sizes)
    out = np.zeros((len(sizes), words), np.uint64)
    for w in range(words if len(some) else 0):
        h = mix(hashes + np.uint64(0x9E3779B97F4A7C15 * (w + 1) & ALL))
        for bit in range(64):
            ones = np.add.reduceat((h >> np.uint64(bit) & np.uint64(1)).astype(np.int32), first[some])
            out[some, w] |= (2 * ones > sizes[some]).astype(np.uint64) << np.uint64(bit)
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shards(marks: DataFrame, radius: int = RADIUS, limit: int = SHARD_LIMIT) -> DataFrame:
    """(mask, key, fp): each fingerprint in every shard it belongs to; no shard is larger than max(limit, 2**14)."""
    parts = radius + 1
    below = {0: first_masks(marks.count(), parts)}
    now = marks.select(F.lit(0).cast("long").alias("mask"), "fp")
    done = None
    while True:
        table = F.create_map(*(x for m, to in below.items() for x in (F.lit(_signed(m)), F.array(*(F.lit(_signed(s)).cast("long") for s in to)))))
        dealt = now.select(F.explode(table[F.col("mask")]).alias("mask"), "fp").withColumn("key", F.col("mask").bitwiseAND(F.col("fp")))
        level = sorted({s for to in below.values() for s in to})
        if min(64 - m.bit_count() for m in level) <= 14 or len(level) >= parts**4:
            return dealt if done is None else done.unionByName(dealt)
        hot = staged(dealt.groupBy("mask", "key").count().where(F.col("count") > limit).select("mask", "key"), "hot-shards")
        if hot.isEmpty():
            return dealt if done is None else done.unionByName(dealt)
        cool = dealt.join(hot, ["mask", "key"], "left_anti")
        done = cool if done is None else done.unionByName(cool)
        now = dealt.join(hot, ["mask", "key"], "left_semi").select("mask", "fp")
        below = {m: submasks(m, parts) for m in level}


def links(marks: DataFrame, radius: int = RADIUS, limit: int = SHARD_LIMIT) -> DataFrame:
    """(u, v): links between distinct fingerprints that connect whatever the radius connects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members = None, []

        def flush() -> np.ndarray:
            whole = np.concatenate(members) if members else np.zeros(0, np.uint64)
            return forest(whole, radius) if len(whole) > 1 else np.zeros((0, 2), np.uint64)

        for rows in batches:
            out = []
            mask, value, fp = (rows.column(k).to_numpy() for k in range(3))
            new = np.flatnonzero(np.concatenate([[True], (mask[1:] != mask[:-1]) | (value[1:] != value[:-1])])) if len(fp) else []
            for lo, hi in zip(new, [*new[1:], len(fp)], strict=True):
                if key != (mask[lo], value[lo]):
                    out.append(flush())
                    key, members = (mask[lo], value[lo]), []
                members.append(fp[lo:hi].view(np.uint64))
            yield _edges(out)
        yield _edges([flush()])

    dealt = shards(marks, radius, limit)
    together = dealt.repartition(partitions_of(marks.sparkSession), "mask", "key").sortWithinPartitions("mask", "key", "fp")
    return together.select("mask", "key", "fp").mapInArrow(run, "u long, v long")


def _edges(pairs: list[np.ndarray]) -> pa.RecordBatch:
    both = np.concatenate([*pairs, np.zeros((0, 2), np.uint64)]).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["u", "v"])


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id of the component) for every row of ``docs``."""
    marked = staged(fingerprints(docs), "fingerprints")
    least = staged(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components(links(least.select("fp"), radius))
    grouped = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    joined = staged(grouped, "roots")
    ids = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = joined.join(ids, "root").select("fp", "component_id")
    return marked.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with only the first row of each component, in the order of common.keyed() (rows without doc_id last)."""
    rows = keyed(docs, "_key", nulls_first=False)
    groups = near_duplicates(rows.select(F.col("_key").alias("doc_id"), "text"), radius)
    lead = groups.where("doc_id = component_id").select(F.col("doc_id").alias("_key"))
    return rows.join(lead, "_key", "left_semi").select(*docs.columns)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
