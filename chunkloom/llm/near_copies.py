"""Near copies by the similarity of their word sets: Jaccard of five-word shingles, 0.8 or more.

Texts with one set of shingles are one vertex, so copies cost nothing after their sketch. Candidates are SimHash
fingerprints that BK-trees find (see simhash), one tree per shard. A fingerprint of ``WORDS`` * 64 bits is taken over the
set of shingles: two sets of similarity 0.8 differ in more than ``RADIUS`` of them with probability 1.1e-9 at most
(calculated for all sizes up to 89; the worst are 4 and 5 shingles, large sets have 7e-15), and two unlike sets in as few
with 4e-7. Shards follow 128 minima of hashed shingles, in 32 bands of four, instead of blocks of the fingerprint's
bits, of which so wide a radius leaves too few: two texts of similarity 0.8 miss each other in all bands with probability
5e-8, less if they are closer. What a tree finds becomes a link only after the shingles of both texts were compared.
Shards are searched in two steps, so that a large group of copies is not compared pair by pair: all members of a band with
its least vertex, and then those that are still in different components with each other. In both, what a tree found is
left out if the minima agree in fewer than ``LEAST_EQUAL`` of 128 places (at similarity 0.8 less likely than 1e-9).

Shingles travel as sorted 32-bit hashes. A vertex's are sent once to each tile that compares it: a star is cut into tiles
of ``TILE`` members, and so is each component of the second step's pairs, where a tile has two parts of the component.
Pairs stay packed by tile; a tile reports links that join what its pairs join, fewer than it has members.

Defined results: words are lower-cased (A-Z); a text of fewer words than a shingle is one shingle; null and blank texts
are copies of each other; rows that share a doc_id or have none are documents of their own (see common.keyed), of which
the first of each group stays; other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.llm.common import Block, blocks, keyed, lowered, mix, span_hashes, staged, window_hashes, window_places, words
from chunkloom.llm.components import components
from chunkloom.llm.simhash import BKTree, set_fingerprints

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 32, 4
LEAST_EQUAL = 70
WORDS, RADIUS = 4, 88
TILE = 1000
_MARKS = "key long, vertex long, bands array<long>, sketch binary, shingles binary"
_RANDOM = np.random.default_rng(11).integers(1, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64)
_XOR, _TIMES = _RANDOM[0], _RANDOM[1] << np.uint64(1) | np.uint64(1)


def shingle_sets(b: Block, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each document, ascending, and where each document's begin."""
    low = lowered(b)
    w = words(low)
    inside = np.flatnonzero(window_places(w.first, k))
    hashes, doc = mix(window_hashes(span_hashes(low.data, w.starts, w.ends), k)[inside]), w.doc[inside]
    short = np.flatnonzero((w.counts > 0) & (w.counts < k))
    if len(short):
        raw = low.data.tobytes()
        whole = [xxhash.xxh64_intdigest(b" ".join(raw[s:e] for s, e in zip(w.starts[w.first[d] : w.first[d + 1]], w.ends[w.first[d] : w.first[d + 1]], strict=True))) for d in short]
        hashes, doc = np.append(hashes, np.array(whole, np.uint64)), np.append(doc, short)
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[new], np.searchsorted(doc[new], np.arange(len(b) + 1))


def sketches(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The vertex of each set (0 if it is empty), its bands, and a byte of each of its minima with its fingerprint behind them."""
    some = np.flatnonzero(np.diff(first))
    vertex = np.zeros(len(first) - 1, np.uint64)
    least = np.zeros((len(first) - 1, BANDS * ROWS), np.uint64)
    if len(some):
        at = first[some]
        vertex[some] = mix(np.add.reduceat(mix(hashes ^ np.uint64(0x5BD1E995)), at))
        for i in range(BANDS * ROWS):
            least[some, i] = np.minimum.reduceat((hashes ^ _XOR[i]) * _TIMES[i], at)
    least = mix(least)
    bands = np.zeros((len(least), BANDS), np.uint64)
    for r in range(ROWS):
        bands = mix(bands + least[:, r::ROWS] + np.arange(BANDS, dtype=np.uint64))
    marks = set_fingerprints(hashes, first, WORDS).view(np.uint8)
    return vertex, bands, np.concatenate([(least & np.uint64(255)).astype(np.uint8), marks], axis=1)


def marked(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, vertex, bands, sketch and shingles (sorted 32-bit hashes) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            hashes, first = shingle_sets(b)
            vertex, bands, sketch = sketches(hashes, first)
            short = (hashes >> np.uint64(32)).astype(np.uint32)  # the sets are sorted, and so are the upper halves
            raw = memoryview(short.tobytes())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS), pa.int32()), pa.array(bands.view(np.int64).reshape(-1)))
            sets = [raw[4 * lo : 4 * hi].tobytes() for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.rows.column(0), pa.array(vertex.view(np.int64)), lists, pa.array([s.tobytes() for s in sketch], pa.binary()), pa.array(sets, pa.binary())], names=["key", "vertex", "bands", "sketch", "shingles"])

    return docs.select(F.col(key).cast("long").alias("key"), "text").mapInArrow(run, _MARKS)


class Groups:
    """Numbers joined step by step; each is known by the least of its group."""

    def __init__(self, n: int) -> None:
        self.of = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.of[i], self.of[j]
            i, j = i[a != b], j[a != b]
            if len(i) == 0:
                return
            a, b = self.of[i], self.of[j]
            np.minimum.at(self.of, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(self.of, self.of[self.of]):
                self.of = self.of[self.of]


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have a similarity of SIMILAR or more."""
    x, y = len(a), len(b)
    part = round(10 * SIMILAR)
    if 10 * min(x, y) < part * max(x, y):
        return False
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, y - 1)] == a).sum()) if x and y else 0
    return 10 * both >= part * (x + y - both)


def _sketch(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the minima, and fingerprints."""
    whole = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(len(rows), BANDS * ROWS + 8 * WORDS)
    return whole[:, : BANDS * ROWS], np.ascontiguousarray(whole[:, BANDS * ROWS :]).view(np.uint64)


class Shard:
    """The BK-tree of a shard's distinct fingerprints, and the members that have each."""

    def __init__(self, sketch: np.ndarray, marks: np.ndarray) -> None:
        self.sketch, self.marks = sketch, marks
        values, which = np.unique(marks, axis=0, return_inverse=True)
        self.tree, which = BKTree(values), which.reshape(-1)
        self.members, self.size = np.argsort(which, kind="stable"), np.bincount(which, minlength=len(values))
        self.first = np.cumsum(self.size) - self.size

    def near(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of members (one of i, any) whose fingerprints are within the radius and whose minima agree enough."""
        q, node, _ = self.tree.within(self.marks[i], RADIUS)
        n = self.size[node]
        x = i[np.repeat(q, n)]
        y = self.members[np.arange(len(x)) + np.repeat(self.first[node] - (np.cumsum(n) - n), n)]
        like = (self.sketch[x] == self.sketch[y]).sum(1) >= LEAST_EQUAL
        return x[like], y[like]


def star(rows: pa.Table) -> pa.Table:
    """(u, v): the members of a star's tile whose sets are like the lead's."""
    lead = rows.column("lead")[0].as_py()
    vertex, shard = rows.column("vertex").to_numpy(), Shard(*_sketch(rows))
    sets = [np.frombuffer(x, np.uint32) for x in rows.column("shingles").to_pylist()]
    at = int(np.flatnonzero(vertex == lead)[0])
    near = np.sort(shard.near(np.array([at]))[1])
    out = [vertex[i] for i in near[vertex[near] != lead].tolist() if alike(sets[at], sets[i])]
    return pa.table({"u": pa.array([lead] * len(out), pa.int64()), "v": pa.array(out, pa.int64())})


def across(rows: pa.Table) -> pa.Table:
    """u, v, pairs: for the band's members in different components that its tree finds near each other, links that join them (pairs
    null), and the pairs themselves, packed, with the least vertex that they reach (as u). Each pair is given by the first
    band that has it."""
    band = rows.column("band")[0].as_py()
    vertex, root, (sketch, marks) = rows.column("vertex").to_numpy(), rows.column("root").to_numpy(), _sketch(rows)
    bands = (rows.column("bands").combine_chunks().flatten().to_numpy().reshape(len(vertex), BANDS) if len(vertex) else np.zeros((0, BANDS))).astype(np.int64)
    order = np.argsort(vertex)
    vertex, root, bands = vertex[order], root[order], bands[order]
    shard = Shard(sketch[order], marks[order])
    column = int(np.flatnonzero((bands == band).all(0))[0])
    names, size = np.unique(root, return_counts=True)
    out = np.flatnonzero(root != names[np.argmax(size)])  # each pair has a member outside the largest
    groups, made = Groups(len(vertex)), []
    step = max(1, 250_000 // max(1, len(vertex)))  # queries at a time: so many visits, and pairs, at most
    for lo in range(0, len(out), step):
        i = out[lo : lo + step]
        x, y = shard.near(i)
        apart = root[x] != root[y]
        x, y = x[apart], y[apart]
        x, y = np.minimum(x, y), np.maximum(x, y)
        fresh = ~(bands[x, :column] == bands[y, :column]).any(1)
        made.append(np.unique(np.stack([x[fresh], y[fresh]], axis=1), axis=0))
        groups.join(x[fresh], y[fresh])
    pairs = np.unique(np.concatenate([*made, np.zeros((0, 2), np.int64)]), axis=0)
    which = groups.of[pairs[:, 0]]
    pairs, which = pairs[np.argsort(which, kind="stable")], np.sort(which)
    ends = np.flatnonzero(np.diff(which, append=-1)) + 1
    packed = [vertex[pairs[a:z]].tobytes() for a, z in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)] if len(which) else []
    hung = np.flatnonzero(groups.of != np.arange(len(vertex)))
    u = [*vertex[groups.of[hung]].tolist(), *vertex[which[ends - 1]].tolist()] if len(which) else []
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array([*vertex[hung].tolist(), *[None] * len(packed)] if u else [], pa.int64()), "pairs": pa.array([*[None] * len(hung), *packed] if u else [], pa.binary())})


def part_of(vertex: np.ndarray, parts: int) -> np.ndarray:
    return (mix(vertex.astype(np.int64).view(np.uint64)) % np.uint64(parts)).astype(np.int64)


def tiled(rows: DataFrame) -> DataFrame:
    """root, i, j and what they came with: a vertex goes to each tile with its part of the component, packed pairs to their tile's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for root, parts, vertex, shingles, pairs in zip(*(batch.column(c).to_pylist() for c in ("root", "parts", "vertex", "shingles", "pairs")), strict=True):
                if pairs is None:
                    p = int(part_of(np.array([vertex]), parts)[0])
                    out += [(root, min(p, q), max(p, q), vertex, shingles, None) for q in range(parts)]
                    continue
                both = np.frombuffer(pairs, np.int64).reshape(-1, 2)
                tile = np.sort(part_of(both, parts), axis=1)
                code = tile[:, 0] * parts + tile[:, 1]
                out += [(root, int(c) // parts, int(c) % parts, None, None, both[code == c].tobytes()) for c in np.unique(code)]
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["root", "i", "j", "vertex", "shingles", "pairs"])

    return rows.select("root", "parts", "vertex", "shingles", "pairs").mapInArrow(run, "root long, i long, j long, vertex long, shingles binary, pairs binary")


def compare(rows: pa.Table) -> pa.Table:
    """(u, v): links that join what the tile's like pairs join."""
    pairs = [np.frombuffer(x, np.int64).reshape(-1, 2) for x in rows.column("pairs").to_pylist() if x is not None]
    none = pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
    if not pairs:
        return none
    vertex, sets = zip(*((v, np.frombuffer(s, np.uint32)) for v, s in zip(rows.column("vertex").to_pylist(), rows.column("shingles").to_pylist(), strict=True) if v is not None), strict=True)
    order = np.argsort(vertex)
    names = np.array(vertex, np.int64)[order]
    both = np.searchsorted(names, np.unique(np.concatenate(pairs), axis=0))
    groups = Groups(len(names))
    for a, b in both.tolist():
        if groups.of[a] != groups.of[b] and alike(sets[order[a]], sets[order[b]]):
            groups.join(np.array([a]), np.array([b]))
    hung = np.flatnonzero(groups.of != np.arange(len(names)))
    return pa.table({"u": pa.array(names[groups.of[hung]]), "v": pa.array(names[hung])}) if len(hung) else none


def near_copies(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and component_id (the smallest key of the component) for every row of ``docs``."""
    marks = staged(marked(docs, key), "marks")
    heads = staged(marks.groupBy("vertex").agg(F.min(F.struct("key", "bands", "sketch")).alias("m")).select("vertex", F.col("m.key").alias("least"), "m.bands", "m.sketch"), "vertices")
    entries = heads.select("vertex", F.explode("bands").alias("band"))
    leads = entries.groupBy("band").agg(F.min("vertex").alias("lead"), F.count("*").alias("n")).where("n > 1").select("band", "lead")
    shared = staged(entries.join(leads, "band"), "shared-bands")
    used = heads.join(shared.select("vertex").distinct(), "vertex", "left_semi").select(F.col("least").alias("key"))
    sets = staged(marks.select("key", "vertex", "shingles").join(used, "key", "left_semi").dropDuplicates(["vertex"]), "shingles")

    stars = staged(shared.where("vertex <> lead").select("lead", "vertex").distinct(), "stars")
    cuts = stars.groupBy("lead").agg(F.ceil(F.count("*") / TILE).alias("parts"))
    members = stars.join(cuts, "lead").select("lead", F.pmod(F.xxhash64("vertex"), F.col("parts")).alias("tile"), "vertex")
    own = cuts.select("lead", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("tile"), F.col("lead").alias("vertex"))
    full = members.unionByName(own).join(sets.select("vertex", "shingles"), "vertex").join(heads.select("vertex", "sketch"), "vertex")
    edges = staged(full.groupBy("lead", "tile").applyInArrow(star, "u long, v long"), "links")
    roots = components(edges).withColumnRenamed("node", "vertex")

    placed = staged(shared.select("band", "vertex").join(roots, "vertex", "left").withColumn("root", F.coalesce("root", "vertex")), "placed")
    mixed = placed.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("band")
    left = placed.join(mixed, "band", "left_semi").join(heads.select("vertex", "sketch", "bands"), "vertex")
    met = staged(left.groupBy("band").applyInArrow(across, "u long, v long, pairs binary"), "across")
    near = components(met.where("v is not null").select("u", "v"))
    size = near.groupBy("root").agg(F.ceil(F.count("*") / TILE).alias("parts"))
    of = staged(near.join(size, "root"), "tiles")
    none = F.lit(None)
    vertices = of.withColumnRenamed("node", "vertex").join(sets, "vertex").select("root", "parts", "vertex", "shingles", none.cast("binary").alias("pairs"))
    packed = met.where("pairs is not null").join(of.withColumnRenamed("node", "u"), "u").select("root", "parts", none.cast("long").alias("vertex"), none.cast("binary").alias("shingles"), "pairs")
    more = staged(tiled(vertices.unionByName(packed)).groupBy("root", "i", "j").applyInArrow(compare, "u long, v long"), "more-links")

    roots = components(edges.unionByName(more)).withColumnRenamed("node", "vertex")
    joined = staged(heads.select("vertex", "least").join(roots, "vertex", "left").withColumn("root", F.coalesce("root", "vertex")), "roots")
    ids = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    return marks.select("key", "vertex").join(joined.join(ids, "root").select("vertex", "component_id"), "vertex").select("key", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with only the first row of each component, in the order of common.keyed()."""
    rows = keyed(docs, "_key", nulls_first=False)
    lead = near_copies(rows.select("_key", "text"), "_key").where("key = component_id").select(F.col("key").alias("_key"))
    return rows.join(lead, "_key", "left_semi").select(*docs.columns)
