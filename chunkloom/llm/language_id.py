"""Language of web pages by Bayesian evidence fusion.

The likelihood of a page's text comes from hashed byte trigrams, counted by language over all labelled documents. It is
multiplied with the likelihoods of the page's declared markup language and of its address suffix, both estimated by
grouped sums of text posteriors, and with the prior of the page's host: the host's own sums, smoothed towards those of
its domain, which are smoothed towards all pages. A page's own posterior is taken out of all these sums, so that its
text does not count twice.

Driver and tasks hold one table of languages x ``BUCKETS`` numbers; more than ``MAX_LANGUAGES`` labels are an error.

Defined results: a page without usable text rests on the other evidence; a missing declaration, suffix or host is a
value of its own; a page without any evidence gets the most likely language overall (ties: the first by name); null
labels do not train; without any label there is no row; repeated rows are pages of their own; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.llm.common import Block, blocks, lowered, read, staged

BUCKETS, MAX_LANGUAGES = 1 << 14, 200
#: A text counts as at most so many independent trigrams; pseudo-counts of trigrams, declarations and priors.
EVIDENCE, SMOOTH, PSEUDO, TRUST = 60.0, 0.5, 1.0, 8.0
_SECTIONS = ("script", "style", "nav", "header", "footer", "aside")
_SECTION = re.compile(rf"(?i)<({'|'.join(_SECTIONS)})\b")
_CLOSING = {name: re.compile(rf"(?i)</{name}\s*>") for name in _SECTIONS}


def trigrams(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Document and bucket of every byte trigram of the lower-cased texts that touches no digit or markup sign."""
    low = lowered(block)
    data = low.data.astype(np.uint32)
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    plain = (low.data == 32) | ((low.data >= 97) & (low.data <= 122)) | (low.data >= 128)
    keep = plain[:-2] & plain[1:-1] & plain[2:]
    doc = np.repeat(np.arange(len(block)), np.diff(block.off))
    keep &= doc[:-2] == doc[2:]
    key = (data[:-2] << 16 | data[1:-1] << 8 | data[2:])[keep]
    return doc[:-2][keep], (key * np.uint32(2654435761) >> np.uint32(18)).astype(np.int64)


def trigram_counts(docs: DataFrame) -> DataFrame:
    """lang, bucket, n over all documents with a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in blocks(batches):
            doc, bucket = trigrams(b)
            names = b.rows.column(1).dictionary_encode()
            which = names.indices.to_numpy()[doc]
            for i, name in enumerate(names.dictionary.to_pylist()):
                total[name] = total.get(name, 0) + np.bincount(bucket[which == i], minlength=BUCKETS)
        for name, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], names=["lang", "bucket", "n"])

    rows = docs.where("lang is not null").select("text", "lang").mapInArrow(run, "lang string, bucket int, n long")
    return rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def likelihoods(counts: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages by name, and log P(bucket | language); its size is bounded by MAX_LANGUAGES and BUCKETS."""
    counts = staged(counts, "trigrams")
    names = sorted(r["lang"] for r in counts.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    pdf = counts.toPandas()
    table = np.full((len(names), BUCKETS), SMOOTH)
    table[np.searchsorted(names, pdf["lang"].to_numpy(str)), pdf["bucket"].to_numpy()] += pdf["n"].to_numpy()
    return names, np.log(table / table.sum(1, keepdims=True)).astype(np.float32)


def visible(source: str | None) -> str:
    """The text outside of tags, comments and sections of scripts and navigation, in one pass.

    What is opened and never closed is an ordinary tag, or text if no tag ends after it. Once a closing mark is not found
    it is not looked for again, so that the time is that of the page's length whatever it holds.
    """
    page, at, out = source or "", 0, []
    missing: set[str] = set()

    def after(mark: str, start: int) -> int:
        if mark in missing:
            return -1
        found = _CLOSING[mark].search(page, start) if mark in _CLOSING else None
        end = found.end() if found else page.find(mark, start) + len(mark) if mark not in _CLOSING and page.find(mark, start) >= 0 else -1
        if end < 0:
            missing.add(mark)
        return end

    while True:
        begin = page.find("<", at)
        if begin < 0:
            break
        section = _SECTION.match(page, begin)
        end = after(section.group(1).lower(), begin) if section else after("-->", begin + 4) if page.startswith("<!--", begin) else -1
        end = after(">", begin) if end < 0 else end
        if end < 0:
            break
        out += [page[at:begin], " "]
        at = end
    out.append(page[at:])
    return html.unescape("".join(out))


def text_evidence(pages: DataFrame, table: np.ndarray) -> DataFrame:
    """``pages`` (.., html) with logs: the tempered log likelihood of the visible text by language."""
    names = [c for c in pages.columns if c != "html"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts = pa.RecordBatch.from_arrays([pa.array([visible(x) for x in rows.column(rows.schema.get_field_index("html")).to_pylist()])], names=["text"])
            logs = []
            for b in blocks(iter([texts])):
                doc, bucket = trigrams(b)
                n = np.bincount(doc, minlength=len(b))
                total = np.stack([np.bincount(doc, w[bucket], len(b)) for w in table], axis=1)
                logs += (total * np.minimum(1.0, EVIDENCE / np.maximum(n, 1))[:, None]).tolist()
            yield pa.RecordBatch.from_arrays([*(rows.column(rows.schema.get_field_index(c)) for c in names), pa.array(logs, pa.list_(pa.float64()))], names=[*names, "logs"])

    return pages.select(*names, "html").mapInArrow(run, ", ".join([*(f"{c} {t}" for c, t in pages.select(*names).dtypes), "logs array<double>"]))


def address(url: Column) -> dict[str, Column]:
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    host = F.coalesce(F.nullif(host, F.lit("")), F.lit("-"))
    parts = F.split(host, r"\.")
    return {"host": host, "domain": F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), "."), "suffix": F.element_at(parts, -1)}


def declared(source: Column) -> Column:
    tag = F.regexp_extract(source, r"(?i)<html\b([^>]*)", 1)  # apart, so that each pattern matches at its first try
    lang = F.regexp_extract(tag, r"(?i)\slang\s*=\s*[\"']?([a-z]+)", 1)
    return F.coalesce(F.nullif(F.lower(lang), F.lit("")), F.lit("-"))


def _normal(values: list[Column]) -> list[Column]:
    total = sum(values[1:], values[0])
    return [v / total for v in values]


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, host, suffix, declared, text_lang, lang and posterior of every row of ``pages`` (page_id, url, html)."""
    names, table = likelihoods(trigram_counts(docs))
    if not names:
        return pages.where(F.lit(False)).selectExpr("page_id", "'' host", "'' suffix", "'' declared", "'' text_lang", "'' lang", "0d posterior")
    span = range(len(names))
    known = pages.select("page_id", *(c.alias(k) for k, c in address(F.col("url")).items()), declared(F.col("html")).alias("declared"), "html")
    rows = staged(text_evidence(known, table), "page-evidence")
    top = F.array_max("logs")
    rows = rows.withColumn("raw", F.transform("logs", lambda x: F.exp(x - top)))
    rows = rows.withColumn("total", F.aggregate("raw", F.lit(0.0), lambda a, x: a + x)).withColumn("p", F.transform("raw", lambda x: x / F.col("total"))).drop("raw", "total")
    sums = lambda *by: rows.groupBy(*by).agg(*(F.sum(F.col("p")[i]).alias(f"{'_'.join(by) or 'all'}_{i}") for i in span))
    joined = rows
    for by in (("host", "domain"), ("domain",), ("suffix",), ("declared",)):
        named = sums(*by)
        joined = joined.join(named, list(by), "left")
    joined = joined.withColumn("one", F.lit(1)).join(F.broadcast(sums().withColumn("one", F.lit(1))), "one")  # of one row
    col = lambda k, i: F.col(f"{k}_{i}")
    every = _normal([col("all", i) + PSEUDO for i in span])
    less = lambda k: [F.greatest(col(k, i) - F.col("p")[i], F.lit(0.0)) for i in span]
    domain = _normal([a + TRUST * b for a, b in zip(less("domain"), every, strict=True)])
    prior = _normal([a + TRUST * b for a, b in zip(less("host_domain"), domain, strict=True)])
    clue = lambda k, i: (less(k)[i] + PSEUDO) / (less("all")[i] + PSEUDO * 10)
    fused = [F.col("logs")[i] + F.log(prior[i]) + F.log(clue("declared", i)) + F.log(clue("suffix", i)) for i in span]
    best = lambda values: F.array_max(F.array(*(F.struct(v.alias("v"), F.lit(-i).alias("i")) for i, v in enumerate(values))))
    lang = lambda of: F.element_at(F.array(*map(F.lit, names)), 1 - of["i"])
    out = joined.withColumn("fused", F.array(*fused)).withColumn("best", best([F.col("fused")[i] for i in span]))
    posterior = 1 / F.aggregate("fused", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("best")["v"]))
    return out.select("page_id", "host", "suffix", "declared", lang(best([F.col("logs")[i] for i in span])).alias("text_lang"), lang(F.col("best")).alias("lang"), posterior.alias("posterior"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "pages"), read(spark, sf_dir, "documents"))
