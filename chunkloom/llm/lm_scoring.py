"""Language-model scores of whole texts.

1. Documents become blocks: each keeps its distinct words once, with their subword ids, and its texts as numbers of
   these words. Blocks are written to the shared folder and serve all later steps.
2. Words are counted over all training documents: blocks send hashes and counts to buckets and get the totals of their
   words back, so that a word costs one entry per block and not one per document.
3. A causal self-attention model of subword ids (``attention``) is trained on windows that tile every training document:
   each subword is a target once. Documents are dealt to rounds and units by a hash of their own, not by where they are
   stored; a round trains each of its units from common weights and averages the results in the order of the units.
4. Overlapping windows score every subword of every text once; a text's score is their sum, the model's alone. The base
   score adds smoothed word frequencies. ``blended_score`` mixes each word's probability with its discounted count.

Only averaged weights (of fixed size), counts by subword id (at most the tokenizer's vocabulary) and counts of pairs of
classes (at most ``attention.CLASSES`` squared) reach the driver.

Defined results: a null or blank text is its end token alone; rows without doc_id are scored and not trained on;
repeated rows count each time; without training documents all base counts are 0 and the model is uniform by class size;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.llm import attention as A
from chunkloom.llm.common import Block, blocks, crc_bucket, distinct, gather_spans, lowered, mix, per_doc, read, release, span_hashes, staged, words
from chunkloom.llm.subwords import Subwords

END = 50256
ROUNDS, BATCH, RATE = 3, 96, 0.02
#: Subwords of one training unit, about.
UNIT = 400_000
#: Text of one block, and text whose words make one bucket of counts.
BLOCK_BYTES, BUCKET_BYTES = 1_000_000, 16_000_000
#: For the blended score: share of the word counts in a word's probability, and what absolute discounting takes from each count.
BLEND, DISCOUNT = 0.5, 0.75
#: Subwords that a task holds before it sends them to their units.
POOL = 2_000_000
#: Weights that are averaged at once.
FAN = 32
#: The hash that stands for the end token among words.
END_HASH = 0
#: The columns of the texts themselves.
_TEXT = ("train", "n_words", "word_of", "subwords", "sizes")
_BLOCK_SQL = "block string, doc_ids array<long>, keys binary, train binary, n_words binary, word_of binary, hashes binary, subwords binary, sizes binary"


def in_training(ids: list[int | None], modulus: int = 10, held: int = 0) -> np.ndarray:
    return np.array([i is not None and zlib.crc32(str(i).encode()) % modulus != held for i in ids], dtype=np.uint8)


def encoded(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Blocks of documents, see step 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Subwords.shared(tokenizer)
        for b in blocks(batches, max_bytes=BLOCK_BYTES):
            low = lowered(b)
            w = words(low)
            hashes = span_hashes(low.data, w.starts, w.ends)
            np.maximum(hashes, np.uint64(END_HASH + 1), out=hashes)
            keys, where, word_of = distinct(hashes)
            size = (w.ends - w.starts)[where]
            data = np.full(int(size.sum()) + len(size), 32, np.uint8)
            off = np.append(0, np.cumsum(size + 1))
            data[gather_spans(size, off[:-1] + 1)] = low.data[gather_spans(size, w.starts[where])]
            ids, first = coder.ids(Block(None, data, off)) if len(size) else (np.zeros(0, np.uint32), np.zeros(1, np.int64))
            ids_here = b.rows.column(0).to_pylist()
            raw = [squeezed(x) for x in (row_keys(ids_here, hashes, w.counts), in_training(ids_here), w.counts, word_of, ids, np.diff(first))]
            raw.insert(4, keys.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([ids_here], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in raw)], names=[x.split()[0] for x in _BLOCK_SQL.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _BLOCK_SQL)


def row_keys(ids: list[int | None], hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A hash of each row's id and words; ``hashes`` are those of all words, ``counts`` how many of them a row has."""
    first = np.append(0, np.cumsum(counts))
    place = np.arange(len(hashes)) - np.repeat(first[:-1], counts)
    sums = np.append(np.uint64(0), np.cumsum(mix(hashes + mix(place.astype(np.uint64))), dtype=np.uint64))
    named = np.array([zlib.crc32(str(i).encode()) for i in ids], np.uint64) << np.uint64(32)
    return mix(named + sums[first[1:]] - sums[first[:-1]])


@lru_cache(maxsize=1)
def _codec() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def squeezed(x: np.ndarray) -> bytes:
    """Numbers from 0 in the narrowest type that holds them, compressed; the first byte tells the type's width."""
    top = int(x.max(initial=0))
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + _codec()[0].compress(x.astype(kind, copy=False).tobytes())


def unsqueezed(raw: bytes, kind: type = np.int64) -> np.ndarray:
    return np.frombuffer(_codec()[1].decompress(raw[1:]), f"<u{raw[0]}").astype(kind, copy=False)


class Coded:
    """A block row as arrays; columns that a step does not read may be missing. Words are in the order of their hashes."""

    def __init__(self, row: dict) -> None:
        of = lambda name: unsqueezed(row[name]) if name in row else None
        self.block, self.doc_ids = row.get("block"), row.get("doc_ids")
        self.keys = unsqueezed(row["keys"], np.uint64) if "keys" in row else None
        self.train = of("train").astype(bool)
        self.first = np.append(0, np.cumsum(of("n_words")))
        self.word_of, self.subwords, self.sizes = of("word_of"), of("subwords"), of("sizes")
        self.hashes = np.frombuffer(row["hashes"], np.uint64) if "hashes" in row else None

    def train_counts(self) -> np.ndarray:
        keep = np.repeat(self.train, np.diff(self.first))
        return np.bincount(self.word_of[keep], minlength=len(self.sizes) if self.hashes is None else len(self.hashes))

    def sequences(self, docs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Subword ids of the documents (all, or those numbered), each with its end, and where each begins."""
        first = self.first
        mine = self.word_of if docs is None else self.word_of[gather_spans(np.diff(first)[docs], first[docs])]
        counts = np.diff(first) if docs is None else np.diff(first)[docs]
        size = self.sizes[mine]
        ids = self.subwords[gather_spans(size, (np.cumsum(self.sizes) - self.sizes)[mine])]
        ends = np.append(0, np.cumsum(size))[np.cumsum(counts)]
        return np.insert(ids, ends, END), np.append(0, ends + np.arange(1, len(counts) + 1))


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Coded]:
    for rows in batches:
        for i in range(len(rows)):
            yield Coded(rows.slice(i, 1).to_pylist()[0])


def subword_counts(coded: DataFrame, size: int) -> np.ndarray:
    """How often each subword id occurs in the training documents; at most ``size`` rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for c in rows_of(batches):
            total += np.bincount(c.subwords, np.repeat(c.train_counts(), c.sizes), size).astype(np.int64)
            total[END] += int(c.train.sum())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    found = coded.select(*_TEXT).mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size, np.int64)
    out[found["id"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


def word_totals(coded: DataFrame, buckets: int) -> DataFrame:
    """block, bucket, totals: the training counts of the block's words of that bucket, in the order of its hashes.

    Rows without a block hold the number of distinct words and the sum of counts of a bucket.
    """
    schema = pa.schema([("block", pa.string()), ("bucket", pa.int32()), ("totals", pa.binary()), ("v", pa.int64()), ("n", pa.int64())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in rows_of(batches):
            hashes = np.append(np.uint64(END_HASH), c.hashes)
            counts = np.append(c.train.sum(), c.train_counts()).astype(np.uint32)
            group = bucket_of(hashes, buckets)
            parts = np.split(np.arange(len(group)), np.flatnonzero(np.diff(group)) + 1)
            yield pa.RecordBatch.from_arrays([
                pa.array([c.block] * len(parts)), pa.array([int(group[p[0]]) for p in parts], pa.int32()),
                pa.array([hashes[p].tobytes() for p in parts], pa.binary()), pa.array([squeezed(counts[p]) for p in parts], pa.binary()),
            ], names=["block", "bucket", "hashes", "counts"])

    def add(rows: pa.Table) -> pa.Table:
        hashes = [np.frombuffer(x, np.uint64) for x in rows.column("hashes").to_pylist()]
        counts = [unsqueezed(x) for x in rows.column("counts").to_pylist()]
        keys, _, which = distinct(np.concatenate(hashes))
        total = np.bincount(which, np.concatenate(counts), len(keys)).astype(np.int64)
        back = np.split(total[which], np.cumsum([len(h) for h in hashes])[:-1])
        n = len(hashes)
        bucket = rows.column("bucket").to_pylist()
        return pa.Table.from_arrays([
            pa.array([*rows.column("block").to_pylist(), None]), pa.array([*bucket, bucket[0]], pa.int32()),
            pa.array([*map(squeezed, back), None], pa.binary()), pa.array([0] * n + [int((total > 0).sum())]), pa.array([0] * n + [int(total.sum())]),
        ], schema=schema)

    sent = coded.select("block", "train", "n_words", "word_of", "hashes").mapInArrow(send, "block string, bucket int, hashes binary, counts binary")
    return sent.groupBy("bucket").applyInArrow(add, "block string, bucket int, totals binary, v long, n long")


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets in the order of the hashes."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def units(coded: DataFrame, vocabulary: A.Vocabulary, n: int, lo: int = 0, hi: int | None = None) -> DataFrame:
    """unit, keys, sizes, classes: the class ids of the training documents, dealt to n units by a hash of id and text; those of lo to hi.

    Rows of a unit come together from several blocks, POOL subwords at most and a document.
    """
    last = n if hi is None else hi

    def parted(units: list[np.ndarray], keys: list[np.ndarray], sizes: list[np.ndarray], classes: list[np.ndarray]) -> pa.RecordBatch:
        unit, key, size, of = map(np.concatenate, (units, keys, sizes, classes))
        order = np.lexsort((key, unit))
        same = np.diff(key[order], prepend=key[order[:1]] + np.uint64(1)) == 0
        new = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        key[order] += (np.arange(len(order)) - new).astype(np.uint64)  # equal rows part
        first = np.cumsum(size) - size
        cuts = np.flatnonzero(np.diff(unit[order])) + 1
        parts = [(int(unit[mine[0]]), squeezed(key[mine]), squeezed(size[mine]), squeezed(of[gather_spans(size[mine], first[mine])])) for mine in np.split(order, cuts)]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*parts, strict=True), (pa.int64(), *(pa.binary(),) * 3), strict=True)], names=["unit", "keys", "sizes", "classes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = vocabulary.of.astype(np.uint16)
        pool, held = ([], [], [], []), 0
        for c in rows_of(batches):
            unit = (mix(c.keys) % np.uint64(n)).astype(np.int64)
            docs = np.flatnonzero(c.train & (unit >= lo) & (unit < last))
            if len(docs) == 0:
                continue
            ids, first = c.sequences(docs)
            for kept, x in zip(pool, (unit[docs], c.keys[docs], np.diff(first), of[ids]), strict=True):
                kept.append(x)
            held += len(ids)
            if held >= POOL:
                yield parted(*pool)
                pool, held = ([], [], [], []), 0
        if held:
            yield parted(*pool)

    return coded.select("keys", *_TEXT).mapInArrow(run, "unit long, keys binary, sizes binary, classes binary")


def pair_counts(coded: DataFrame, vocabulary: A.Vocabulary) -> np.ndarray:
    """How often each class follows each other one in the training documents, which begin after the end's class."""
    k, start = A.CLASSES, int(vocabulary.of[END])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k, np.int64)
        for c in rows_of(batches):
            docs = np.flatnonzero(c.train)
            ids, first = c.sequences(docs)
            of = vocabulary.of[ids]
            before = np.append(0, of[:-1])[: len(of)]
            before[first[:-1]] = start
            total += np.bincount(before * k + of, minlength=k * k)
        at = np.flatnonzero(total)
        for lo in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[lo : lo + 100_000].astype(np.int32)), pa.array(total[at[lo : lo + 100_000]])], names=["pair", "n"])

    found = coded.select(*_TEXT).mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(k * k)
    out[found["pair"].to_numpy()] = found["n"].to_numpy(np.float64)
    return out.reshape(k, k)


def tiles(rows: pa.Table, start: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Batches of the windows that tile a unit's documents, in an order drawn by their keys: input classes and targets."""
    kinds = {"keys": np.uint64, "sizes": np.int64, "classes": np.uint16}
    parts = [[unsqueezed(x, kind) for x in rows.column(c).to_pylist()] for c, kind in kinds.items()]
    keys, sizes, classes = (np.concatenate(x) for x in parts)
    first = np.append(0, np.cumsum(sizes))
    n = -(-sizes // A.SPAN)
    doc = np.repeat(np.arange(len(sizes)), n)
    which = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    order = np.lexsort((which, mix(mix(keys)[doc] + which.astype(np.uint64))))
    for at in range(0, len(order), BATCH):
        mine = order[at : at + BATCH]
        begin, end = first[doc[mine]][:, None], first[doc[mine] + 1][:, None]
        place = begin + A.SPAN * which[mine][:, None] + np.arange(A.SPAN)
        wants = np.where(place < end, classes[np.minimum(place, len(classes) - 1)], A.PAD)
        before = np.where(place == begin, start, classes[np.clip(place - 1, 0, len(classes) - 1)])
        yield np.where(place < end, before, A.PAD).astype(np.int64), wants.astype(np.int64)


def flat(p: dict[str, np.ndarray]) -> bytes:
    return b"".join(p[k].astype(np.float32).tobytes() for k in sorted(p))


def shaped(raw: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = raw[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def train(coded: DataFrame, vocabulary: A.Vocabulary, per_round: int, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Average of the units' weights after each round, weighted by their windows; round r has the units r * per_round and on."""
    p = A.initial()
    start, sql = int(vocabulary.of[END]), "unit long, weight double, weights binary"

    def local(common: dict[str, np.ndarray], part: int) -> Callable:
        def run(rows: pa.Table) -> pa.Table:
            mine, seen = {k: w.copy() for k, w in common.items()}, 0
            adam = A.Adam(mine, RATE / (1 + part))
            for ids, wants in tiles(rows, start):
                adam.update(A.step(mine, vocabulary, ids, wants)[1])
                seen += len(ids)
            return pa.table({"unit": rows.column("unit").slice(0, 1), "weight": [float(seen)], "weights": pa.array([flat(mine)], pa.binary())})

        return run

    def average(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("unit")
        return pa.table({"unit": pa.array([rows.column("unit")[0].as_py() // FAN]), "weight": [sum(rows.column("weight").to_pylist())], "weights": pa.array([_mean(rows.column("weight").to_pylist(), rows.column("weights").to_pylist())], pa.binary())})

    for part in range(rounds):
        mine = units(coded, vocabulary, rounds * per_round, part * per_round, (part + 1) * per_round).withColumn("unit", F.col("unit") - part * per_round)
        made, n = mine.repartition(2 * per_round, "unit").groupBy("unit").applyInArrow(local(p, part), sql), per_round
        while n > FAN:
            made, n = made.groupBy(F.expr(f"unit div {FAN}")).applyInArrow(average, sql), -(-n // FAN)
        got = sorted(made.collect(), key=lambda r: r["unit"])
        if got:
            p = shaped(np.frombuffer(_mean([r["weight"] for r in got], [r["weights"] for r in got]), np.float32), p)
    return p


def _mean(weight: list[float], weights: list[bytes]) -> bytes:
    total = sum(w * np.frombuffer(x, np.float32).astype(np.float64) for w, x in zip(weight, weights, strict=True))
    return (total / sum(weight)).astype(np.float32).tobytes()


def blended(spelled: np.ndarray, count: np.ndarray, n: int, v: int) -> np.ndarray:
    """Natural log of a word's probability: discounted counts for one part, and for the rest (with what the discount freed) its subwords."""
    if n == 0:
        return spelled
    rest = np.log(1 - BLEND + BLEND * min(1.0, DISCOUNT * v / n)) + spelled
    counted = BLEND * np.maximum(count - DISCOUNT, 0) / n
    return np.where(counted > 0, np.log(np.where(counted > 0, counted + np.exp(rest), 1)), rest)


def score(coded: DataFrame, totals: DataFrame, vocabulary: A.Vocabulary, p: dict[str, np.ndarray], n: int, v: int, buckets: int) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score, blended_score."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("blended_score", pa.float64())])

    def run(mine: pa.Table, back: pa.Table) -> pa.Table:
        made = []
        known = {b: unsqueezed(t) for b, t in zip(back.column("bucket").to_pylist(), back.column("totals").to_pylist(), strict=True)}
        for c in rows_of(iter(mine.to_batches())):
            both = np.concatenate([known[b] for b in sorted(known)])  # buckets follow the hashes, and the end's is the least
            ends, count = both[0], both[1:]
            log, log_end = (np.log10((x + 0.1) / (n + 0.1 * (v + 1))) for x in (count, ends))
            docs = len(c.doc_ids)
            sums = np.add.reduceat(np.append(log[c.word_of], 0.0), c.first[:-1]) * (np.diff(c.first) > 0)
            base = sums + log_end
            seen = per_doc(c.first, count[c.word_of] > 0) + int(ends > 0)
            ids, first = c.sequences()
            slots, wants, (places, _) = A.layout(vocabulary.of[ids], first, vocabulary.of[END])
            logs = np.concatenate([A.log_probabilities(p, vocabulary, slots, wants, places[at : at + 512]) for at in range(0, len(places), 512)]) + vocabulary.share[ids]
            size = np.insert(c.sizes[c.word_of], c.first[1:], 1)
            spelled = np.add.reduceat(logs, np.cumsum(size) - size)
            whole = np.insert(count[c.word_of], c.first[1:], ends)
            total = [np.add.reduceat(x, c.first[:-1] + np.arange(docs)) / np.log(10) for x in (spelled, blended(spelled, whole, n, v))]
            made.append(pa.RecordBatch.from_arrays([pa.array(c.doc_ids, pa.int64()), pa.array(np.diff(c.first) + 1), pa.array(seen), pa.array(base), *map(pa.array, total)], schema=schema))
        return pa.Table.from_batches(made, schema=schema)

    mine = coded.select("block", "doc_ids", *_TEXT).groupBy("block")
    return mine.cogroup(totals.groupBy("block")).applyInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double, blended_score double")


def score_texts(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score and blended_score of every document."""
    size = int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    buckets = max(1, -(-size // BUCKET_BYTES))
    coded = staged(encoded(docs, tokenizer), "coded")
    coder = Subwords.shared(tokenizer)
    size = coder.tokenizer.get_vocab_size()
    begins = np.zeros(size, dtype=bool)
    for token, i in coder.tokenizer.get_vocab().items():
        begins[i] = token.startswith("Ġ") or i == END
    totals = staged(word_totals(coded, buckets), "word-totals")
    sums = totals.where("block is null").agg(F.sum("v"), F.sum("n")).first()
    v, n = (int(x or 0) for x in sums)
    counts = subword_counts(coded, size)
    vocabulary = A.Vocabulary.make(counts, begins)
    per_round = max(1, -(-int(counts.sum()) // (ROUNDS * UNIT)))
    vocabulary.learn(pair_counts(coded, vocabulary))
    p = train(coded, vocabulary, per_round)
    release(docs.sparkSession)  # what was shuffled for counts and rounds, before blocks are shuffled to their totals
    return score(coded, totals.where("block is not null"), vocabulary, p, n, v, buckets).withColumn("train_tokens", F.lit(n).cast("long"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_texts(read(spark, sf_dir, "documents"))
    held = F.coalesce(crc_bucket("doc_id", 10) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "blended_score")
