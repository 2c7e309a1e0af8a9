"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature of a text is cut into bins; cyclic boosting fits shallow trees to the logistic loss, one feature after
another, and adds each tree's leaves to that feature's lookup table. Pairs of features are then boosted on coarse grids
in the same way. Scoring looks the bins up and adds: no tree remains.

The model is fitted on at most ``MAX_ROWS`` labelled documents, the first in the order of a hash of doc_id; of rows that
share a labelled id, one is learned from, the one with the least features.

Defined results: null and empty texts have the features of an empty text and get a score like any other; without
labels of both kinds the score is the share of label 1 (0.5 without any label); repeated label rows of one document
count once, with the lowest mark; rows of the input are kept as they are; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkloom.llm.common import blocks, crc_bucket, named, read
from chunkloom.llm.text_stats import FEATURES, features

MAX_ROWS = 20_000
BINS, GRID, PAIRS = 48, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, RIDGE = 60, 30, 0.25, 2.0


@dataclass
class Additive:
    """intercept + sum of tables[j][bin j] + sum of grids[a, b][coarse a, coarse b] is the log odds of label 1."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray] = field(default_factory=list)
    grids: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]
        for b, t in zip(bins, self.tables, strict=True):
            total += t[b]
        for (a, b), g in self.grids.items():
            total += g[self.coarse[a][bins[a]], self.coarse[b][bins[b]]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """The gain of the best cut of the bins into two runs, and where the second run begins (0: no cut)."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if len(gl) == 0:
        return 0.0, 0
    total, weight = g.sum(), h.sum()
    gain = gl**2 / (hl + RIDGE) + (total - gl) ** 2 / (weight - hl + RIDGE) - total**2 / (weight + RIDGE)
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values over the bins of a tree of depth two."""
    out = np.zeros(len(g))
    gain, cut = _best_cut(g, h)
    cuts = [0, len(g)] if gain <= 0 else [0, cut, len(g)]
    for lo, hi in list(zip(cuts[:-1], cuts[1:], strict=True)):
        gain, cut = _best_cut(g[lo:hi], h[lo:hi])
        if gain > 0:
            cuts.append(lo + cut)
    cuts = sorted(set(cuts))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        out[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + RIDGE)
    return RATE * out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of a grid into four quadrants: its gain and its leaf values."""
    gs, hs = np.pad(g.cumsum(0).cumsum(1), ((1, 0), (1, 0))), np.pad(h.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    n, m = g.shape
    parts = lambda s: (s[1:n, 1:m], s[1:n, m:] - s[1:n, 1:m], s[n:, 1:m] - s[1:n, 1:m], s[n, m] - s[1:n, m:] - s[n:, 1:m] + s[1:n, 1:m])
    gain = sum(a**2 / (b + RIDGE) for a, b in zip(parts(gs), parts(hs), strict=True))
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.zeros_like(g)
    for rows in (slice(0, i + 1), slice(i + 1, n)):
        for cols in (slice(0, j + 1), slice(j + 1, m)):
            out[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + RIDGE)
    return float(gain[i, j]), RATE * out


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    share = float(y.mean()) if len(y) else 0.5
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(len(FEATURES))]
    clipped = min(max(share, 1e-6), 1 - 1e-6)
    model = Additive(float(np.log(clipped / (1 - clipped))), edges, [np.zeros(len(e) + 1) for e in edges])
    model.coarse = [np.minimum(np.arange(len(e) + 1) * GRID // (len(e) + 1), GRID - 1) for e in edges]
    if not 0 < share < 1:
        return model
    bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]
    total = np.full(len(x), model.intercept)

    def residual() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for b, t in zip(bins, model.tables, strict=True):
            g, h = residual()
            leaf = _tree(np.bincount(b, g, len(t)), np.bincount(b, h, len(t)))
            t += leaf
            total += leaf[b]
    cells = {(a, b): model.coarse[a][bins[a]] * GRID + model.coarse[b][bins[b]] for a in range(len(bins)) for b in range(a)}
    grid = lambda c, v: np.bincount(c, v, GRID * GRID).reshape(GRID, GRID)
    g, h = residual()
    best = sorted(cells, key=lambda k: (-_quadrants(grid(cells[k], g), grid(cells[k], h))[0], k))[:PAIRS]
    model.grids = {k: np.zeros((GRID, GRID)) for k in best}
    for _ in range(PAIR_ROUNDS):
        for k in best:
            g, h = residual()
            leaf = _quadrants(grid(cells[k], g), grid(cells[k], h))[1]
            model.grids[k] += leaf
            total += leaf.reshape(-1)[cells[k]]
    return model


def _with_features(docs: DataFrame, extra: str = "") -> DataFrame:
    names = ["doc_id", *extra.split()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            x = features(b)
            yield pa.RecordBatch.from_arrays([*(b.rows.column(k) for k in range(len(names))), *(pa.array(x[:, j]) for j in range(len(FEATURES)))], names=[*names, *FEATURES])

    kinds = dict(docs.dtypes)
    return docs.select(*names, "text").mapInArrow(run, ", ".join([*(f"{n} {kinds[n]}" for n in names), *(f"{f} double" for f in FEATURES)]))


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Additive:
    """Fit on at most ``max_rows`` of ``labels`` (doc_id, quality); the sample's size bounds what is broadcast and collected."""
    marks = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("label"))
    sample = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    once = _with_features(rows, "label").groupBy("doc_id", "label").agg(F.min(F.struct(*FEATURES)).alias("x")).select("doc_id", "label", "x.*")
    pdf = once.toPandas().sort_values("doc_id")
    return fit(pdf[list(FEATURES)].to_numpy(np.float64), pdf["label"].to_numpy(np.float64))


def score(docs: DataFrame, model: Additive) -> DataFrame:
    """All columns of ``docs`` and ``quality_score`` (replaced if there)."""
    rest = [c for c in docs.columns if c != "quality_score"]
    plain = ["text" if c == "text" else f"_{i}" for i, c in enumerate(rest)]  # Spark's functions over batches do not take dots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            yield pa.RecordBatch.from_arrays([*b.rows.columns, pa.array(model.score(features(b)))], names=[*plain, "quality_score"])

    rows = docs.select(*(c.alias(p) for c, p in zip(named(rest), plain, strict=True)))
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("quality_score", T.DoubleType())])).toDF(*rest, "quality_score")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    labels = read(spark, sf_dir, "labels").where(crc_bucket("doc_id", 4) != 2)
    model = learn(docs, labels)
    held = F.coalesce(crc_bucket("doc_id", 4) == 2, F.lit(False))
    lean = _scores(docs, model)
    return lean.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def _scores(docs: DataFrame, model: Additive) -> DataFrame:
    """doc_id and score only: the texts do not come back from Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            yield pa.RecordBatch.from_arrays([b.rows.column(0), pa.array(model.score(features(b)))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
