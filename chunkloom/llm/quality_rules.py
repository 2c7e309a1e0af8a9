"""Quality rules with risk-controlled thresholds.

A base rule rejects short and repetitive texts. Beyond it, each of six rules compares one ratio of the text with a
cutoff. The cutoffs of all rules move together along one sequence of settings, from lenient to strict: at a setting of
tail share q, a rule's cutoff is exceeded by at most a share q of the stratum's unlabelled texts (``SHARES``; taken from
counts over fine bins, so labels have no part in it). Along the sequence, the labelled good documents of the stratum are
held out: an exact binomial (Clopper-Pearson) test has to certify that all rules together reject at most ``alpha`` of
them. The last setting before the first failure is used (fixed-sequence testing needs no correction over settings); over
strata the level ``delta`` is divided (Bonferroni). With probability 1 - delta, no stratum then loses more than
``alpha`` of its good documents, counted among those that pass the base rule.

Strata (languages) with too few good labels to certify anything are pooled: they share one calibration, and the
guarantee holds for the pool. If even the pool has too few, it has no cutoffs.

Defined results: a null text is an empty one (base_failed); a null language is a stratum of its own; without certified
cutoffs whatever passes the base rule is kept; repeated label rows of one document count once, with the lowest mark;
rows of the input are kept as they are, repeats included; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.llm.common import blocks, read, staged
from chunkloom.llm.text_stats import COUNTS, stats

RULES = ("symbols_per_word", "upper_share", "bang_per_word", "dup_line_share", "repeat_share", "top_word_share")
#: Tail shares of the settings, tested in this order: a text is rejected if a ratio of it is above the rule's cutoff.
SHARES = (0.0, *(round(float(x), 5) for x in np.geomspace(0.002, 0.5, 24)))
ALPHA, DELTA = 0.05, 0.05
#: Ratios are counted in this many bins of equal logarithmic width between LEAST and MOST.
BINS, LEAST, MOST = 400, 1e-3, 10.0
EDGES = tuple(round(LEAST * (MOST / LEAST) ** (k / BINS), 9) for k in range(BINS + 1))
BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"
POOLED = "pooled"


def text_counts(docs: DataFrame) -> DataFrame:
    """doc_id, stratum, the base counts and the rules' ratios of every text."""
    out = pa.schema([("doc_id", pa.int64()), ("stratum", pa.string()), *((c, pa.int64()) for c in COUNTS), *((r, pa.float64()) for r in RULES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            s = stats(b)
            yield pa.RecordBatch.from_arrays([b.rows.column(0), b.rows.column(1), *(pa.array(s[c], pa.int64()) for c in COUNTS), *(pa.array(s[r], pa.float64()) for r in RULES)], schema=out)

    schema = "doc_id long, stratum string, " + ", ".join(f"{c} long" for c in COUNTS) + ", " + ", ".join(f"{r} double" for r in RULES)
    return docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string").alias("stratum"), F.col("text")).mapInArrow(run, schema)


def log_binomial_cdf(k: int, n: int, p: float) -> float:
    """log P(X <= k) for X ~ Binomial(n, p), 0 < p < 1, summed exactly term by term."""
    if k >= n:
        return 0.0
    i = np.arange(1, k + 1)
    logs = n * np.log1p(-p) + np.concatenate([[0.0], np.cumsum(np.log((n - i + 1) / i) + np.log(p / (1 - p)))])
    top = logs.max()
    return float(min(0.0, top + np.log(np.exp(logs - top).sum())))


def strictest(rejected: np.ndarray, n: int, alpha: float, delta: float) -> int:
    """How many of the cutoffs hold, given how many of the n good documents each rejects, lenient first."""
    for j, k in enumerate(rejected):
        if k > n * alpha or log_binomial_cdf(int(k), n, alpha) > np.log(delta):
            return j
    return len(rejected)


def least_good(alpha: float, delta: float) -> int:
    """How many good labels it takes to certify a setting that rejects none of them."""
    return int(np.ceil(np.log(delta) / np.log1p(-alpha)))


def bin_of(ratio: Column) -> Column:
    """The bin of a ratio: cutoff EDGES[k] is exceeded by the ratios of bin k + 1 and on."""
    place = F.ceil(F.log(ratio / LEAST) / float(np.log(MOST / LEAST) / BINS) - 1e-9)
    return F.when(ratio > LEAST, F.least(place, F.lit(BINS + 1))).otherwise(0).cast("int")


def settings(bins: pd.DataFrame) -> list[list[int]]:
    """For each share of SHARES, the edge of each rule's cutoff. bins: rule, bin, n of unlabelled texts."""
    out = []
    for r in RULES:
        per = bins[bins["rule"] == r]
        by = np.bincount(per["bin"].to_numpy(np.int64), weights=per["n"].to_numpy(), minlength=BINS + 2)
        above = by.sum() - np.cumsum(by)  # texts above the cutoff of each edge
        out.append([int(np.argmax(above[: BINS + 1] <= q * by.sum())) if above[BINS] <= q * by.sum() else BINS for q in SHARES])
    return [list(x) for x in zip(*out, strict=True)]


def cutoffs(counts: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum, part (the stratum or POOLED), setting (how many of SHARES hold) and each rule's certified edge (null: none).

    Settings are nested, so a good document counts by the number of settings that keep it; groups of rows never exceed
    rules x bins.
    """
    named = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q"))
    marked = counts.where(~F.expr(BASE_FAILED)).join(named, "doc_id", "left")
    binned = marked.select("stratum", "q", F.array(*(bin_of(F.col(r)) for r in RULES)).alias("bins"))
    each = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col("bins")[i].alias("bin")) for i, r in enumerate(RULES))))
    tails = staged(binned.where("q is null").select("stratum", each.alias("x")).groupBy("stratum", "x.rule", "x.bin").agg(F.count("*").alias("n")), "tails")
    good = binned.where("q = 1").select("stratum", "bins")
    enough = good.groupBy("stratum").agg(F.count("*").alias("good"))
    strata = counts.select("stratum").distinct().alias("s").join(enough.alias("g"), F.col("s.stratum").eqNullSafe(F.col("g.stratum")), "left")
    parts = staged(strata.select("s.stratum", F.coalesce("good", F.lit(0)).cast("long").alias("good")), "strata")
    level = delta / (parts.count() + 1)
    own = F.col("good") >= least_good(alpha, level)
    parts = parts.select("stratum", F.struct(own.alias("own"), F.when(own, F.col("stratum")).alias("name")).alias("part"))

    def of_parts(rows: DataFrame, *names: str) -> DataFrame:
        return rows.alias("r").join(parts.alias("p"), F.col("r.stratum").eqNullSafe(F.col("p.stratum"))).select("p.part", *(f"r.{n}" for n in names))

    def same(a: str, b: str) -> Column:
        return (F.col(f"{a}.part.own") == F.col(f"{b}.part.own")) & F.col(f"{a}.part.name").eqNullSafe(F.col(f"{b}.part.name"))

    def edges_of(pdf: pd.DataFrame) -> pd.DataFrame:
        part = pdf["part"].iloc[0]
        return pd.DataFrame([{"own": bool(part["own"]), "name": part["name"], "edges": settings(pdf)}], columns=["own", "name", "edges"])

    def certify(pdf: pd.DataFrame) -> pd.DataFrame:
        part = pdf["part"].iloc[0]
        by = np.bincount(pdf["level"].to_numpy(np.int64), weights=pdf["n"].to_numpy(), minlength=len(SHARES) + 1).astype(np.int64)
        return pd.DataFrame([{"own": bool(part["own"]), "name": part["name"], "setting": strictest(np.cumsum(by)[: len(SHARES)], int(by.sum()), alpha, level)}], columns=["own", "name", "setting"])

    cuts = of_parts(tails, "rule", "bin", "n").groupBy("part", "rule", "bin").agg(F.sum("n").alias("n")).groupBy("part").applyInPandas(edges_of, "own boolean, name string, edges array<array<int>>")
    cuts = staged(cuts.select(F.struct("own", "name").alias("part"), "edges"), "settings")
    passes = lambda e: reduce(Column.__and__, (F.col("g.bins")[i] <= e[i] for i in range(len(RULES))))
    levels = of_parts(good, "bins").alias("g").join(cuts.alias("c"), same("g", "c")).select("g.part", F.size(F.filter("c.edges", passes)).alias("level"))
    made = levels.groupBy("part", "level").agg(F.count("*").alias("n")).groupBy("part").applyInPandas(certify, "own boolean, name string, setting int")
    made = made.select(F.struct("own", "name").alias("part"), "setting")
    joined = parts.alias("p").join(made.alias("m"), same("p", "m"), "left").join(cuts.alias("c"), same("p", "c"), "left")
    setting = F.coalesce("m.setting", F.lit(0))
    edge = F.when(setting > 0, F.get("c.edges", setting - 1))
    return joined.select("p.stratum", F.when(F.col("p.part.own"), F.col("p.stratum")).otherwise(POOLED).alias("part"), setting.alias("setting"), *(edge[i].alias(f"max_{r}") for i, r in enumerate(RULES)))


def apply_rules(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The base counts and ratios of every document, base_failed, the rules it breaks, and kept."""
    counts = staged(text_counts(docs), "text-counts")
    limits = staged(cutoffs(counts, labels, alpha, delta), "cutoffs")
    joined = counts.alias("c").join(limits.alias("l"), F.col("c.stratum").eqNullSafe(F.col("l.stratum")), "left").drop(F.col("l.stratum"))
    broken = F.array_compact(F.array(*(F.when(bin_of(F.col(r)) > F.col(f"max_{r}"), F.lit(r)) for r in RULES)))
    return joined.withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("broken", broken).withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = apply_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", *COUNTS, "base_failed", "kept")
