"""Token counts kept up to date by deltas.

A batch of changes (inserts, deletes and revised counts of documents) becomes signed rows that are summed by source,
language and tokenizer version and written under the batch's id. Totals are the sum over all batches, so applying
changes in any order gives the same totals. A commit writes a new version of its batch beside the old one, which goes once
the new one is complete: repeating a commit, after a lost executor or driver, changes nothing, and a broken one leaves
the version before in force. ``compact`` folds all batches into one row set and keeps their ids, so that a batch that
comes again later is known; what cannot be read is an error.

Defined results: a null text counts 0 tokens and 1 document; null sources and languages are keys of their own; a change
without a tokenizer version is an error; keys whose totals are all zero are not reported; repeated rows count each time;
an empty batch is committed as empty; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.llm.common import read, shared_dir
from chunkloom.llm.mixing import word_count

KEYS = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long"
#: Counting functions by tokenizer version.
TOKENIZERS: dict[str, Callable[[Column], Column]] = {
    "utf8-bytes-1": lambda text: F.coalesce(F.octet_length(text), F.lit(0)).cast("long"),
    "words-1": word_count,
}


def counted(docs: DataFrame, tokenizers: tuple[str, ...] = tuple(TOKENIZERS)) -> DataFrame:
    """source, lang, tokenizer, tokens: one row for each document and tokenizer version."""
    each = F.array(*(F.struct(F.lit(t).alias("tokenizer"), TOKENIZERS[t](F.col("text")).alias("tokens")) for t in tokenizers))
    return docs.select("source", "lang", F.explode(each).alias("x")).select("source", "lang", "x.tokenizer", "x.tokens")


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(1).cast("long").alias("docs"), F.col("tokens").cast("long").alias("tokens"))


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(-1).cast("long").alias("docs"), (-F.col("tokens")).cast("long").alias("tokens"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Documents counted again: the old rows leave their keys and the new rows enter theirs."""
    return deletes(old).unionByName(inserts(new))


class Rollup:
    """Totals in a folder that all executors share: a folder per batch id and version, summed when read."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _versions(self, batch: str = "*") -> dict[str, list[int]]:
        """The complete versions of each batch."""
        fs, at = self._fs(f"{self.path}/batch={batch}/v=*/_SUCCESS")
        out: dict[str, list[int]] = {}
        for status in fs.globStatus(at) or ():
            *_, name, version, _ = status.getPath().toString().split("/")
            out.setdefault(name.removeprefix("batch="), []).append(int(version.removeprefix("v=")))
        return {k: sorted(v) for k, v in out.items()}

    def _folded(self) -> DataFrame | None:
        fs, at = self._fs(f"{self.path}/_folded/_SUCCESS")
        return self.spark.read.schema("batch string").parquet(f"{self.path}/_folded") if fs.exists(at) else None

    def commit(self, batch_id: str, changes: DataFrame) -> None:
        """Sum ``changes`` by key and put them in the place of whatever this batch id held; nothing if a snapshot holds the batch."""
        if not batch_id.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"a batch id is made of letters, digits, - and _: {batch_id!r}")
        folded = self._folded()
        if folded is not None and not folded.where(F.col("batch") == batch_id).isEmpty():
            return
        rows = changes.select(*(F.col(k).cast("string").alias(k) for k in KEYS), "docs", "tokens")
        rows = rows.withColumn("tokenizer", F.when(F.col("tokenizer").isNull(), F.raise_error(F.lit("a change without a tokenizer version"))).otherwise(F.col("tokenizer")))
        totals = rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        old = self._versions(batch_id).get(batch_id, [])
        totals.where("docs <> 0 or tokens <> 0").write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}/v={max(old, default=0) + 1}")
        for v in old:
            fs, at = self._fs(f"{self.path}/batch={batch_id}/v={v}")
            fs.delete(at, True)

    def _log(self) -> DataFrame:
        paths = [f"{self.path}/batch={b}/v={v[-1]}" for b, v in sorted(self._versions().items())]
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*paths)

    def totals(self) -> DataFrame:
        rows = self._log().groupBy(*KEYS).agg(F.sum("docs").cast("long").alias("docs"), F.sum("tokens").cast("long").alias("tokens"))
        return rows.where("docs <> 0 or tokens <> 0")

    def compact(self, into: str) -> Rollup:
        """A rollup in a new folder that holds the totals as its only batch and knows all batch ids; this one stays until it is dropped."""
        out = Rollup(self.spark, into)
        ids = self.spark.createDataFrame([(b,) for b in self._versions()], "batch string")
        folded = self._folded()
        out.commit("snapshot", self.totals())
        (ids if folded is None else ids.unionByName(folded)).where("batch <> 'snapshot'").distinct().write.mode("overwrite").parquet(f"{out.path}/_folded")
        return out


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents arrive in four batches; one is counted as the wrong language first and revised, one is sent twice, one is deleted and inserted again."""
    import uuid

    counts = read(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    part = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4, F.lit(0))
    batch = [counts.where(part == k) for k in range(4)]
    store = Rollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    guess = counted(batch[1].withColumn("lang", F.lit("und")))
    store.commit("b0", inserts(counted(batch[0])))
    store.commit("b1", inserts(guess))
    store.commit("b1-revised", revisions(guess, counted(batch[1])))
    store.commit("b2", inserts(counted(batch[2])))
    store.commit("b2", inserts(counted(batch[2])))
    store.commit("b3", reduce(DataFrame.unionByName, [inserts(counted(batch[3])), deletes(counted(batch[3])), inserts(counted(batch[3]))]))
    return store.totals()
