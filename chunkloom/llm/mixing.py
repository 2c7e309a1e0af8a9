"""Mixing sources to target weights, with DataFrame functions only.

Sizes are summed per source; targets share a total by weight, capped at a multiple of each source's size with the
excess shared again (water filling, solved in closed form by two windows over one row per source); a source's
repetition rate is target / size. Each document is taken floor(rate) times, and once more if a uniform number made
from a seeded hash of its id falls below the fraction.

Defined results: a null text has size 0; a null source is a source of its own, the last; a source without words has
target 0 and rate 0; repeated rows are documents of their own (those with the same id share one coin); an empty table
gives no rows; other columns are carried along, and those named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkloom.llm.common import WORD, read, staged

WEIGHTS = (3, 1, 2)
SHARE, CAP, SEED = 1.5, 2.0, 20240229
RESULT = ("size", "source_size", "target", "rate", "copies")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size -> source, source_size, target. ``sizes`` has one row per source.

    With sources in the order of cap * size / weight, the water level if all before the i-th are capped is
    (total - their caps) / (weights from i on); the first source that its own level does not fill sets the level.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    by_name = sizes.withColumn("w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((rank - 1) % len(weights) + 1).cast("int")))
    by_name = by_name.withColumn("most", F.lit(cap) * F.col("source_size"))
    order = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before, rest, everything = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(rest)
    leveled = by_name.withColumn("level", level).withColumn("level", F.min(F.when(F.col("level") * F.col("w") <= F.col("most"), F.struct(F.col("most") / F.col("w"), "level"))).over(everything)["level"])
    return leveled.select("source", "source_size", F.coalesce(F.least("most", F.col("level") * F.col("w")), "most").alias("target"))


def uniform(column: str, seed: int) -> Column:
    """A number in [0, 1) from a seeded hash of the column."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(column)), 11) / F.lit(float(1 << 53))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """``docs`` with size, source_size, target, rate and copies. Only ids, sources and sizes take part in the aggregation."""
    sized = docs.drop(*RESULT).withColumn("size", word_count(F.col("text")))
    return _planned(sized, weights, share, cap, seed)


def _planned(sized: DataFrame, weights: tuple[float, ...], share: float, cap: float, seed: int) -> DataFrame:
    goal = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    goal = goal.withColumn("rate", F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(cap))).otherwise(0.0))
    own = [F.col("d." + "`" + c.replace("`", "``") + "`") for c in sized.columns]
    joined = sized.alias("d").join(goal.alias("g"), F.col("d.source").eqNullSafe(F.col("g.source")), "left").select(*own, "g.source_size", "g.target", "g.rate")
    whole = F.floor("rate")
    return joined.withColumn("copies", whole + (uniform("doc_id", seed) < F.col("rate") - whole).cast("long"))


def emit(mixed: DataFrame) -> DataFrame:
    """Each document as many times as the mix takes it."""
    some = mixed.where("copies > 0")
    return some.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copy")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    mixed = _planned(staged(docs, "sizes"), WEIGHTS, SHARE, CAP, SEED)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
