"""Deltas between objects: what they could save, which ones the policy accepts, chains and reconstruction."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkloom.functions import codec
from chunkloom.functions.ranges import chunk_bodies, digest
from chunkloom.model import Policy, pct, saturating_sub, total
from chunkloom.operators import compare
from chunkloom.operators.lineage import closure, cut

EPSILON = 2.220446049250313e-16


def _with_bytes(rows: DataFrame, objects: DataFrame, key: str, name: str) -> DataFrame:
    return rows.join(objects.select(F.col("object").alias(key), F.col("data").alias(name)), key, "left")


def potential(pairs: DataFrame, chunks: DataFrame, objects: DataFrame, level: int = codec.LEVEL) -> DataFrame:
    """Per pair: compressed size of the changed chunks in full and as deltas on the left chunk of the same range."""
    changed = compare.aligned(pairs, chunks).where("left_object is not null and left_object <> object").select("pair", "object", "left_object", "size")
    both = _with_bytes(_with_bytes(changed, objects, "object", "data"), objects, "left_object", "base")
    fits = F.octet_length("data") == F.octet_length("base")
    sized = both.select("pair", "size", fits.alias("fits"), codec.zstd_size(level, sized=False)("data").alias("full"), codec.xor_size(level, sized=False)("base", "data").alias("delta"))
    pick = lambda c: total(F.when(F.col("fits"), F.col(c)).otherwise(0))
    sums = sized.groupBy("pair").agg(pick("full").alias("full_compressed_bytes"), pick("delta").alias("delta_compressed_bytes"), total(F.when(F.col("fits"), 1).otherwise(0)).alias("comparable_chunks"), total(F.when(F.col("fits"), 0).otherwise(F.col("size"))).alias("unequal_bytes"))
    out = compare.alignment(pairs, chunks).join(sums, "pair", "left").na.fill(0)
    out = out.withColumn("incomparable_bytes", F.col("incomparable_bytes") + F.col("unequal_bytes")).drop("unequal_bytes")
    saved = saturating_sub(F.col("full_compressed_bytes"), F.col("delta_compressed_bytes"))
    return out.withColumn("potential_savings_bytes", saved).withColumn("potential_savings_pct", pct(F.col("potential_savings_bytes"), F.col("full_compressed_bytes")))


def stored_state(representations: DataFrame) -> DataFrame:
    """object, loose (size), packed, depth, up (the base of its delta) of every stored object."""
    return representations.groupBy("object").agg(
        F.max(F.when(F.col("kind") == "loose", F.col("stored_size"))).alias("loose"), F.max(F.when(F.col("kind") == "pack", 1)).alias("packed"),
        F.coalesce(F.max(F.when(F.col("kind") == "delta", F.col("depth"))), F.lit(0)).cast("long").alias("depth"), F.max(F.when(F.col("kind") == "delta", F.col("base"))).alias("up"),
    )


def decide(candidates: DataFrame, state: DataFrame, most: int) -> DataFrame:
    """``candidates`` (pair, chunk_ix, target, base, before, after) with depth and reason (null: to be stored).

    Candidates are taken in the order of pair and place, over all pairs: a delta stored by an earlier one counts in the
    depth and in the chain of a later one. ``before`` and ``after`` are reasons that come before and after the checks of
    cycle and depth. Each round decides the candidates whose base no undecided earlier one may still change; only these
    small rows take part, no bytes. ``state``: object, depth, up.
    """
    edges = state.where("up is not null").select(F.col("object").alias("child_id"), F.col("up").alias("parent_id"))
    above = closure(edges, candidates.select(F.col("base").alias("root_id")).distinct()).where("root_id <> node_id").groupBy(F.col("root_id").alias("base")).agg(F.collect_set("node_id").alias("chain0"))
    first = state.select(F.col("object").alias("base"), F.col("depth").alias("depth0")).join(above, "base", "left")
    rows = candidates.withColumn("o", F.struct("pair", "chunk_ix")).join(first, "base", "left")
    pending = cut(rows.withColumn("depth0", F.coalesce("depth0", F.lit(0)).cast("long")).withColumn("chain0", F.coalesce("chain0", F.array().cast("array<string>"))))
    names, done, accepted = pending.columns, None, None
    while True:
        waits = pending.where("before is null and after is null").groupBy(F.col("target").alias("base")).agg(F.min("o").alias("next"))
        marked = pending.join(waits, "base", "left").withColumn("blocked", F.coalesce(F.col("next") < F.col("o"), F.lit(False)))
        ready = marked.where("not blocked").select(*names)
        if accepted is None:
            ready = ready.withColumn("depth1", F.col("depth0")).withColumn("chain", F.col("chain0"))
        else:
            a = accepted.select(F.col("target").alias("base"), F.col("o").alias("o1"), F.col("depth").alias("d"), F.col("chain").alias("c"))
            last = ready.join(a, "base").where(F.col("o1") < F.col("o")).groupBy("pair", "chunk_ix", "target").agg(F.max_by(F.struct("d", "c"), "o1").alias("s"))
            ready = ready.join(last, ["pair", "chunk_ix", "target"], "left").withColumn("depth1", F.coalesce("s.d", "depth0")).withColumn("chain", F.coalesce("s.c", "chain0"))
        free = F.col("before").isNull()
        cycle = free & (F.array_contains("chain", F.col("target")) | (F.col("base") == F.col("target")))
        depth = F.when(free & ~cycle, F.col("depth1") + 1).otherwise(0).cast("long")
        reason = F.coalesce("before", F.when(cycle, "cycle"), F.when(F.col("depth1") + 1 > most, "depth"), "after")
        step = cut(ready.select("pair", "chunk_ix", "target", "base", "o", depth.alias("depth"), reason.alias("reason"), F.concat(F.array("base"), "chain").alias("chain")))
        done = step if done is None else done.unionByName(step)
        accepted = done.where("reason is null")
        left = cut(marked.where("blocked").select(*names))
        if left.isEmpty():
            return done.select("pair", "chunk_ix", "target", "base", "depth", "reason")
        pending = left


def optimize(pairs: DataFrame, chunks: DataFrame, objects: DataFrame, representations: DataFrame, policy: Policy | None = None) -> DataFrame:
    """The verdict on every changed object of each pair, with the delta's record where it is accepted.

    Every candidate is encoded in a row of its own (a record's size does not depend on its depth); decide() then works on
    the sizes alone. Rows: pair, target, base, stored, full_bytes, delta_bytes,
    savings_pct, depth, reason, record.
    """
    policy = policy or Policy()
    candidates = compare.delta_candidates(pairs, chunks)
    state = cut(stored_state(representations))
    rows = candidates.join(state.select(F.col("object").alias("target"), F.col("loose").alias("full"), "packed"), "target", "left")
    rows = rows.join(state.select(F.col("object").alias("base"), F.lit(True).alias("based")), "base", "left")
    before = F.when(F.col("full").isNull(), "target is not loose").when(F.col("packed").isNotNull(), "target is also packed").when(F.col("based").isNull(), "base is not stored")
    rows = _with_bytes(_with_bytes(rows.withColumn("before", before), objects, "target", "data"), objects, "base", "base_data")
    level = policy.zstd_level

    @F.pandas_udf(T.BinaryType())
    def encode(target: pd.Series, base: pd.Series, base_id: pd.Series) -> pd.Series:
        one = lambda t, b, i: None if t is None or b is None or len(t) != len(b) else codec.encode_delta(bytes(t), bytes(b), i, 1, level)
        return pd.Series([one(*x) for x in zip(target, base, base_id, strict=True)], dtype=object)

    none = F.lit(None).cast("binary")
    made = rows.select("pair", "chunk_ix", "target", "base", "before", "full", encode(F.when(F.col("before").isNull(), F.col("data")).otherwise(none), "base_data", "base").alias("record"))
    n = F.octet_length("record").cast("long")
    saved = F.when(F.col("full") > 0, F.greatest(F.col("full") - n, F.lit(0)) / F.col("full") * 100).otherwise(0.0)
    after = F.when(F.col("record").isNull(), "sizes differ").when((n >= F.col("full")) | (saved + EPSILON < policy.delta_min_savings_pct), "savings below the policy")
    judged = cut(made.withColumn("delta_bytes", n).withColumn("savings_pct", saved).withColumn("after", after))
    verdicts = decide(judged.select("pair", "chunk_ix", "target", "base", "before", "after"), state, policy.max_delta_depth)
    out = judged.drop("base", "before", "after").join(verdicts.select("pair", "chunk_ix", "target", "base", "depth", "reason"), ["pair", "chunk_ix", "target"])
    tried = F.col("reason").isNull() | F.col("reason").startswith("savings")
    record = F.concat(F.substring(F.col("record"), 1, 68), F.unhex(F.lpad(F.hex("depth"), 2, "0")), F.expr("substring(record, 70)"))
    return out.select(
        F.col("pair").cast("long").alias("pair"), "target", "base", F.col("reason").isNull().alias("stored"), F.coalesce("full", F.lit(0)).cast("long").alias("full_bytes"),
        F.when(tried, F.col("delta_bytes")).otherwise(0).cast("long").alias("delta_bytes"), F.when(tried, F.col("savings_pct")).otherwise(0.0).alias("savings_pct"),
        "depth", "reason", F.when(F.col("reason").isNull(), record).alias("record"),
    )


def optimize_totals(verdicts: DataFrame) -> DataFrame:
    """Per pair: stored and skipped candidates, bytes saved, greatest depth."""
    stored = F.col("stored")
    return verdicts.groupBy("pair").agg(
        F.count("*").alias("candidates"), total(F.when(stored, 1).otherwise(0)).alias("stored"), total(F.when(stored, 0).otherwise(1)).alias("skipped"),
        total(F.when(stored, F.col("full_bytes")).otherwise(0)).alias("full_bytes"), total(F.when(stored, F.col("delta_bytes")).otherwise(0)).alias("delta_bytes"),
        F.coalesce(F.max(F.when(stored, F.col("depth"))), F.lit(0)).cast("long").alias("max_depth"),
    )


def reachable(chunks: DataFrame, representations: DataFrame) -> DataFrame:
    """object: all that manifests name, and the bases that their deltas need, directly or through other deltas."""
    named = chunks.select("object").distinct()
    edges = representations.where("kind = 'delta' and base is not null").select(F.col("object").alias("child_id"), F.col("base").alias("parent_id"))
    starts = named.join(edges.select(F.col("child_id").alias("object")).distinct(), "object", "left_semi")
    return named.unionByName(closure(edges, starts.select(F.col("object").alias("root_id"))).select(F.col("node_id").alias("object"))).distinct()


def reconstruct(full: DataFrame, deltas: DataFrame, hash: str = "blake3") -> DataFrame:
    """object, data, ok of every delta (object, base, depth, record), in the order of depth from the full objects (object, data).

    A delta whose base cannot be read, or whose bytes do not have its id, is not ok and carries none above it.
    """

    @F.pandas_udf(T.BinaryType())
    def apply(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        def one(record: bytes | None, base: bytes | None) -> bytes | None:
            try:
                return None if record is None or base is None else codec.apply_delta(bytes(record), bytes(base))
            except Exception:  # noqa: BLE001  any damage makes the object unreadable
                return None

        for record, base in parts:
            yield pd.Series([one(r, b) for r, b in zip(record, base, strict=True)], dtype=object)

    depth = int(deltas.agg(F.max("depth")).first()[0] or 0)
    known, done = full.select("object", "data"), None
    for d in range(1, depth + 1):
        rows = deltas.where(F.col("depth") == d).join(known.select(F.col("object").alias("base"), F.col("data").alias("base_data")), "base", "left")
        step = cut(rows.select("object", apply("record", "base_data").alias("data")))
        step = step.withColumn("ok", digest(F.col("data"), hash).eqNullSafe(F.col("object")))
        known = known.unionByName(step.where("ok").select("object", "data"))
        done = step if done is None else done.unionByName(step)
    return done if done is not None else full.where(F.lit(False)).select("object", "data").withColumn("ok", F.lit(True))


def simulate(pairs: DataFrame, bodies: DataFrame, sizes: list[int], thresholds: list[int], level: int = codec.LEVEL, hash: str = "sha256") -> DataFrame:
    """pair x chunk size x threshold: what a store of both artifacts would take if chunks became deltas at that saving.

    bodies: artifact_id, body. A chunk met before costs nothing; others cost the smaller of raw and zstd, or the delta on
    the left chunk of the same place and length, plus a header, where it saves at least the threshold.
    """
    from pyspark.sql import Window

    out = None
    limits = F.explode(F.array(*(F.lit(t) for t in thresholds))).alias("delta_threshold_pct")
    for size in sizes:
        rows = chunk_bodies(bodies, size, hash, keep_data=True).withColumn("full", F.least(codec.zstd_size(level)("data"), F.col("size")))
        left, right = compare.sided(pairs, rows, "left"), compare.sided(pairs, rows, "right")
        once = lambda t: t.withColumn("n", F.row_number().over(Window.partitionBy("pair", "object").orderBy("chunk_ix")))
        base = once(left).groupBy("pair").agg(total(F.when(F.col("n") == 1, F.col("full")).otherwise(0)).alias("left_bytes"), F.count("*").alias("left_chunks"))
        there = left.select("pair", "object").distinct().withColumn("there", F.lit(True))
        place = left.select("pair", "chunk_ix", "size", F.col("data").alias("base_data"))
        judged = once(right).join(there, ["pair", "object"], "left").join(place, ["pair", "chunk_ix", "size"], "left")
        shared = F.coalesce("there", F.lit(False)) | (F.col("n") > 1)
        judged = judged.select("pair", "full", shared.alias("shared"), (codec.xor_size(level)("base_data", "data") + codec.SIMULATED_HEADER).alias("delta"))
        saved = F.when(F.col("full") == 0, 0.0).otherwise(F.greatest(F.col("full") - F.col("delta"), F.lit(0)) / F.col("full") * 100)
        cost = F.when(F.col("shared"), 0).when(saved >= F.col("delta_threshold_pct"), F.least("full", "delta")).otherwise(F.col("full"))
        sums = judged.select("*", limits).groupBy("pair", "delta_threshold_pct").agg(total(cost).alias("right_cost"), F.count("*").alias("right_chunks"), total(F.when(F.col("shared"), 1).otherwise(0)).alias("shared_chunks"))
        length = bodies.select("artifact_id", F.octet_length("body").cast("long").alias("n"))
        logical = compare.sided(pairs, length, "left").unionByName(compare.sided(pairs, length, "right")).groupBy("pair").agg(F.sum("n").alias("logical"))
        grid = pairs.select("pair", F.lit(size).cast("long").alias("chunk_size"), limits)
        rows = grid.join(logical, "pair").join(base, "pair", "left").join(sums, ["pair", "delta_threshold_pct"], "left").na.fill(0)
        rows = rows.withColumn("estimated_physical_bytes", F.col("left_bytes") + F.col("right_cost"))
        rows = rows.select("pair", "chunk_size", F.col("delta_threshold_pct").cast("long").alias("delta_threshold_pct"), (F.col("left_chunks") + F.col("right_chunks")).alias("chunks"), "shared_chunks", "estimated_physical_bytes", pct(saturating_sub(F.col("logical"), F.col("estimated_physical_bytes")), F.col("logical")).alias("net_savings_pct"))
        out = rows if out is None else out.unionByName(rows)
    return out
