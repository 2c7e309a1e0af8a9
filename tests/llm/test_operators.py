"""Operators against brute force on the small data set and on made-up tables with the awkward cases."""

from __future__ import annotations

import math
from collections import Counter
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from chunkloom.llm import attention as A
from chunkloom.llm import components, language_id, lm_scoring, mixing, near_copies, packing, quality_classifier, quality_rules, simhash, substring_dedup, subwords, token_counts, topk_search
from chunkloom.llm.common import Block, as_block, blocks, words
from tests.helpers import SF, duck_table, spark_table
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 997}x{i % 13}" for i in range(30_000))
AWKWARD = [
    None, "", " \n\t ", "one", "Two words", " 　", "a b c a b c a b c", "line\nline\n\nline\n", "ÀÉ ñandú 日本 語 \U0001f600 x", "it's don't 'tis '' 's 're", "#*$ %& |<> x|y", LONG, LONG + " tail", "x" * 70_000,
    "A b C d E f", "a B c D e F", "\x0b\x0c\r a", "zero​width", "nul\x00byte here", "pass " * 60, "same same", "same same",
]


def table(spark, texts, first=0):
    langs, sources = ["en", "fr", None], ["s1", "s0", None, "s2"]
    rows = [(first + i, t, langs[i % 3], sources[i % 4], None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def small(spark):
    return [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]


@pytest.fixture(scope="module")
def awkward(spark):
    return table(spark, AWKWARD).cache()


def by_id(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def run(spark, name):
    return entry.queries()[name](spark, SF)


# Shared blocks


def test_words_agree_with_the_pattern():
    b = as_block(pa.RecordBatch.from_pydict({"text": pa.array(AWKWARD, pa.string())}))
    w = words(b)
    got = [[b.data[s:e].tobytes().decode() for s, e in zip(w.starts[lo:hi], w.ends[lo:hi], strict=True)] for lo, hi in zip(w.first[:-1], w.first[1:], strict=True)]
    assert got == [brute.split(t) for t in AWKWARD]
    parts = list(blocks(iter([b.rows]), max_bytes=100))
    assert sum(len(p) for p in parts) == len(AWKWARD) and b"".join(p.data.tobytes() for p in parts) == b.data.tobytes()


# 1 Quality rules


def test_base_counts(spark, small, awkward):
    got = by_id(run(spark, "op1_quality_rules"))
    assert {d: x[:6] for d, x in got.items()} == {d: brute.base_counts(t) for d, t, _ in small}
    assert all(not kept or not failed for *_, failed, kept in got.values())
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.apply_rules(awkward, none).collect()}
    assert got == {i: brute.base_counts(t) for i, t in enumerate(AWKWARD)}
    assert quality_rules.apply_rules(awkward.where("false"), none).count() == 0


def test_binomial_bounds_are_exact():
    for n, p in ((10, 0.3), (50, 0.02), (200, 0.5)):
        for k in range(0, n + 1, 7):
            want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
            assert math.isclose(math.exp(quality_rules.log_binomial_cdf(k, n, p)), want, rel_tol=1e-9)
    assert quality_rules.strictest(np.array([0, 0, 40]), 1000, 0.01, 0.01) == 2
    assert quality_rules.strictest(np.array([0, 0]), 20, 0.01, 0.01) == 0  # too few labels certify nothing
    assert quality_rules.strictest(np.array([50, 0]), 1000, 0.01, 0.01) == 0  # the sequence ends at its first failure


def test_cutoffs_reject_junk_but_few_good_documents(spark):
    rng = random.Random(3)
    clean = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(900)) for _ in range(80)) for _ in range(1200)]
    junk = [" ".join(f"{w}***" for w in t.split()) for t in clean[:100]]
    plain = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(900)) for _ in range(80)) for _ in range(900)]
    docs = table(spark, clean + plain + junk).withColumn("lang", F.lit("en"))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1200)] + [(2100, 0, 0), (5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id: r.kept for r in quality_rules.apply_rules(docs, labels).collect()}
    assert sum(not kept[i] for i in range(1200)) <= 0.05 * 1200 and not any(kept[i] for i in range(2100, 2200))


def test_kept_is_that_of_brute_force(spark):
    """Settings, tests and verdicts of the query on sf0.01, computed again from its ratios."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = quality_rules.apply_rules(docs, labels).toPandas()
    marks = {r.doc_id: r.quality for r in labels.collect()}
    rows = got[~got["base_failed"]]
    strata = sorted(got["stratum"].unique())
    good = rows[rows["doc_id"].map(marks) == 1]
    plain = rows[~rows["doc_id"].isin(marks)]
    level = quality_rules.DELTA / (len(strata) + 1)
    part = {s: s if (good["stratum"] == s).sum() >= math.log(level) / math.log(1 - quality_rules.ALPHA) else "pooled" for s in strata}
    limit = {}
    for p in set(part.values()):
        mine = good[good["stratum"].map(part) == p]
        tail = plain[plain["stratum"].map(part) == p]
        for q in quality_rules.SHARES:
            cut = {r: next((e for e in quality_rules.EDGES if (tail[r] > e + 1e-12).sum() <= q * len(tail)), quality_rules.EDGES[-1]) for r in quality_rules.RULES}
            k = int(np.logical_or.reduce([mine[r] > cut[r] + 1e-12 for r in quality_rules.RULES]).sum())
            risk = sum(math.comb(len(mine), i) * quality_rules.ALPHA**i * (1 - quality_rules.ALPHA) ** (len(mine) - i) for i in range(k + 1))
            if k > quality_rules.ALPHA * len(mine) or risk > level:
                break
            limit[p] = cut
    assert "en" in limit
    keep = [not f and all(x[r] <= limit.get(part[x["stratum"]], {}).get(r, math.inf) + 1e-12 for r in quality_rules.RULES) for f, (_, x) in zip(got["base_failed"], got.iterrows(), strict=True)]
    assert keep == got["kept"].tolist()
    assert (got["kept"] < ~got["base_failed"]).sum() > 0
    bad = rows[rows["doc_id"].map(marks) == 0]
    assert bad["kept"].mean() < good["kept"].mean()


# 2 Quality classifier


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = entry.queries()["op2_quality_classifier"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert got["held_out"].tolist() == [brute.crc(d) % 4 == 2 for d in got["doc_id"]]
    assert got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.7)).all()
    held = got[got["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() >= 0.95


def test_scores_are_table_lookups(spark, awkward):
    rng = np.random.default_rng(0)
    x = rng.random((2000, len(quality_classifier.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # only a pair tells
    model = quality_classifier.fit(x, y)
    assert ((model.score(x) > 0.5) == y).mean() > 0.9
    total = model.intercept + sum(t[np.searchsorted(e, x[0, j], side="right")] for j, (e, t) in enumerate(zip(model.edges, model.tables, strict=True)))
    for (a, b), g in model.grids.items():
        i, j = (np.searchsorted(model.edges[k], x[0, k], side="right") for k in (a, b))
        total += g[model.coarse[a][i], model.coarse[b][j]]
    assert math.isclose(model.score(x[:1])[0], 1 / (1 + math.exp(-total)))
    for y in (np.zeros(5), np.ones(5), np.zeros(0)):
        assert np.all((quality_classifier.fit(x[: len(y)], y).score(x[:3]) >= 0) & (quality_classifier.fit(x[: len(y)], y).score(x[:3]) <= 1))
    out = quality_classifier.score(awkward.withColumn("quality_score", F.lit("clash")), model)
    assert out.where("quality_score between 0 and 1").count() == len(AWKWARD)


# 3 Mixing


def test_mixing(spark, small, awkward):
    got = by_id(run(spark, "op3_mixing"))
    sizes = {}
    for _, t, s in small:
        sizes[s] = sizes.get(s, 0) + len(brute.split(t))
    goal = brute.mix_targets(sizes)
    for d, t, s in small:
        size, of, target, taken = got[d]
        assert (size, of) == (len(brute.split(t)), sizes[s]) and math.isclose(target, goal[s], rel_tol=1e-9) and 0 <= taken <= 2 * size
    assert got == by_id(run(spark, "op3_mixing"))
    mixed = mixing.mix_sources(awkward.withColumn("copies", F.lit("clash")))
    assert sorted(r.doc_id for r in mixing.emit(mixed).collect()) == sorted(r.doc_id for r in mixed.collect() for _ in range(r.copies))
    assert mixing.mix_sources(awkward.where("false")).count() == 0
    assert {r.target for r in mixing.mix_sources(awkward.where("doc_id < 3")).collect()} == {0.0}


@pytest.mark.parametrize("seed", range(6))
def test_targets_are_water_filling(spark, seed):
    rng = random.Random(seed)
    sizes = {None if i == 0 else f"s{i}": rng.choice([0, 1, 10, 1000, 100000]) * rng.randrange(1, 9) for i in range(rng.randrange(1, 12))}
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(rows).collect()}
    assert got == pytest.approx(brute.mix_targets(sizes))


def test_taken_words_come_near_the_targets(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"))
    for r in mixing.mix_sources(docs).groupBy("source").agg(F.first("target").alias("t"), F.sum(F.col("size") * F.col("copies")).alias("n")).collect():
        assert abs(r.n / r.t - 1) < 0.03


# 4 Token counts


def test_token_counts(spark, awkward, tmp_path):
    assert spark_table(run(spark, "op4_token_counts")) == duck_table(entry.oracle_sql()["op4_token_counts"])
    store = token_counts.Rollup(spark, str(tmp_path / "rollup"))
    assert store.totals().count() == 0
    counts = token_counts.counted(awkward, ("words-1",))
    for _ in range(2):
        store.commit("a", token_counts.inserts(counts))
    store.commit("empty", token_counts.inserts(counts.where("false")))
    total = lambda s: {tuple(r)[:3]: tuple(r)[3:] for r in s.totals().collect()}
    want = {}
    for i, t in enumerate(AWKWARD):
        key = (["s1", "s0", None, "s2"][i % 4], ["en", "fr", None][i % 3], "words-1")
        docs, tokens = want.get(key, (0, 0))
        want[key] = (docs + 1, tokens + len(brute.split(t)))
    assert total(store) == want
    revised = counts.withColumn("tokens", F.col("tokens") * 2)
    store.commit("b", token_counts.revisions(counts, revised))
    assert total(store) == {k: (d, 2 * n) for k, (d, n) in want.items()}
    compacted = store.compact(str(tmp_path / "compact"))
    assert total(compacted) == total(store)
    compacted.commit("a", token_counts.inserts(counts))  # known, though its rows are in the snapshot
    assert total(compacted) == total(store)
    again = compacted.compact(str(tmp_path / "again"))
    again.commit("b", token_counts.revisions(counts, revised))
    again.commit("new", token_counts.inserts(counts))
    assert total(again) == {k: (2 * d, 3 * n) for k, (d, n) in want.items()}
    half = tmp_path / "rollup" / "batch=b" / "v=9"  # a commit that broke off
    half.mkdir()
    (half / "part-0.parquet").write_bytes(b"torn")
    assert total(store) == {k: (d, 2 * n) for k, (d, n) in want.items()}
    store.commit("c", token_counts.deletes(revised))
    assert total(store) == {}
    with pytest.raises(ValueError):
        store.commit("../x", counts)
    for part in (tmp_path / "rollup" / "batch=c" / "v=1").glob("part-*"):
        part.write_bytes(b"torn")
    with pytest.raises(Exception):  # noqa: B017
        store.totals().collect()


# 5 Packing


def piece_rows(spark, df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="module")
def coder():
    return subwords.Subwords()


def test_subwords_equal_the_tokenizer(coder):
    rng = random.Random(1)
    alphabet = [*"ab's tredlv'm \n\t 12!é 日x_", " ", "'re", "'ll", " 's", "  ", "\r\n", "½", "\U0001f600"]
    texts = [*AWKWARD, *("".join(rng.choice(alphabet) for _ in range(rng.randrange(50))) for _ in range(3000)), "<|endoftext|> in a text"]
    at = 0
    for b in blocks(iter([pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})]), max_bytes=50_000):
        ids, first = coder.ids(b)
        for i in range(len(b)):
            assert coder.tokenizer.encode(texts[at] or "", add_special_tokens=False).ids == ids[first[i] : first[i + 1]].tolist()
            at += 1


def check_pieces(rows, texts, coder, capacity=2048):
    sequences, docs = {}, {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append(r)
        docs.setdefault(r["doc_id"], []).append(r)
    assert set(docs) == set(texts)
    for d, parts in docs.items():
        ids = np.array([*coder.tokenizer.encode(texts[d] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(parts, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    used = []
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
        used.append(at)
    return used


def test_packing(spark, small, awkward, coder):
    used = check_pieces(piece_rows(spark, run(spark, "op5_packing")), {d: t for d, t, _ in small}, coder)
    assert 2048 * len(used) <= 1.03 * sum(used)
    check_pieces(piece_rows(spark, packing.packed(awkward)), dict(enumerate(AWKWARD)), coder)
    assert packing.packed(awkward.where("false")).count() == 0


def test_sequences_hold_the_ids(spark, coder):
    docs = table(spark, ["a b c", None, "x " * 3000])
    rows = packing.sequences(docs).collect()
    want = sorted(i for t in ("a b c", "", "x " * 3000) for i in [*coder.tokenizer.encode(t, add_special_tokens=False).ids, 1])
    flat = sorted(i for r in rows for i in r.ids if i)
    assert flat == [i for i in want if i] and all(len(r.ids) == 2048 or len(r.ids) & (len(r.ids) - 1) == 0 for r in rows)


@pytest.mark.parametrize("total", [1, 15, 32, 33, 683, 1024, 1025, 2031, 2032, 2047, 2048, 2049, 7000])
def test_piece_lengths(total):
    made = packing.piece_lengths(total)
    assert sum(made) == total and all(0 < n <= 2048 for n in made)
    assert all(2048 // n >= packing.CLASSES or 2048 // (2048 // n) - n <= packing.SLACK for n in made)


# 6 SimHash


def test_simhash(spark, small, awkward):
    got = by_id(run(spark, "op6_simhash"))
    marks = {d: brute.fingerprint(t) for d, t, _ in small}
    assert {d: x[0] for d, x in got.items()} == {d: f"{f:016x}" for d, f in marks.items()}
    assert {d: x[1] for d, x in got.items()} == brute.near_components(list(marks.items()))
    marks = {i: brute.fingerprint(t) for i, t in enumerate(AWKWARD)}
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(awkward).collect()}
    assert got == {i: (f, brute.near_components(list(marks.items()))[i]) for i, f in marks.items()}
    assert simhash.near_duplicates(awkward.where("false")).count() == 0


def test_trees_find_what_a_scan_finds():
    rng = random.Random(5)
    values = [rng.getrandbits(64) for _ in range(40)]
    values += [v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for v in values * 6]
    values = list(dict.fromkeys(values))
    values = np.array(values, np.uint64)
    tree = simhash.BKTree(values)
    for node, edge in zip(*np.nonzero(tree.child >= 0), strict=True):  # edges are distances to the parent
        assert int(values[node] ^ values[tree.child[node, edge]]).bit_count() == edge
    q, at, visited = tree.within(values, 2)
    want = {(i, j) for i in range(len(values)) for j in range(len(values)) if int(values[i] ^ values[j]).bit_count() <= 2}
    assert set(zip(q.tolist(), at.tolist(), strict=True)) == want and len(q) == len(want)
    assert len(values) < visited < 0.6 * len(values) ** 2  # other edges are not followed
    assert len(simhash.BKTree(values[:0]).within(values, 2)[0]) == 0


def test_shards_hold_trees_of_many_members(spark):
    rng = np.random.default_rng(3)
    marks = rng.integers(-(1 << 63), 1 << 63, 6000)
    df = spark.createDataFrame([(int(m),) for m in marks], "fp long")
    sizes = [r["count"] for r in simhash.shards(df).groupBy("mask", "key").count().collect()]
    assert sum(sizes) == 3 * 6000 and 500 < np.median(sizes) < 2 * simhash.TREE
    few = simhash.shards(df.limit(500)).groupBy("mask", "key").count().collect()
    assert [r["count"] for r in few] == [500]


@pytest.mark.parametrize("limit", [1, 4096])
def test_links_survive_small_shards(spark, limit):
    rng = random.Random(8)
    hub = rng.getrandbits(64)
    marks = {hub} | {hub ^ (1 << a) ^ (1 << b) for a in range(0, 64, 5) for b in range(0, 64, 7)} | {rng.getrandbits(64) for _ in range(50)}
    df = spark.createDataFrame([(simhash._signed(m),) for m in marks], "fp long")
    roots = {r.node: r.root for r in components.components(simhash.links(df, limit=limit)).collect()}
    want = brute.near_components([(simhash._signed(m), m) for m in marks])
    groups = {}
    for m in want:
        groups.setdefault(want[m], set()).add(m)
    for members in groups.values():
        if len(members) > 1:
            assert {roots[m] for m in members} == {min(members)}
        else:
            assert not members & set(roots)


def test_components_of_chains_rings_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(200, 201), (201, 202), (202, 200), (7, 7)]
    rng = random.Random(2)
    rng.shuffle(edges)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200, 202: 200}


def test_one_of_each_group_stays(spark):
    docs = table(spark, ["alpha beta gamma delta", "Alpha beta  gamma delta", "something else here now", "", None])
    docs = docs.unionByName(docs.where("doc_id = 0")).unionByName(docs.where("doc_id = 1").withColumn("doc_id", F.lit(None).cast("long")))
    assert sorted(str(r.doc_id) for r in simhash.keep_one(docs).collect()) == ["0", "2", "3"]


def test_near_copies_come_from_trees_of_fingerprints(monkeypatch):
    rng = random.Random(4)
    texts = []
    for n in (9, 30, 120, 400):
        plain = [f"{n}w{rng.randrange(10**6)}" for _ in range(n)]
        for _ in range(12):
            plain = [w if rng.random() > 4 / n else f"new{rng.randrange(10**6)}" for w in plain]
            texts += [" ".join(plain), " ".join(plain[1:])]
    block = as_block(pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["key", "text"]))
    hashes, first = near_copies.shingle_sets(block)
    sets = [hashes[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
    marks = simhash.set_fingerprints(hashes, first, near_copies.WORDS)
    for s, m in zip(sets, marks.tolist(), strict=True):  # a bit is 1 in over half of the set
        h = simhash.mix(s + np.uint64(0x9E3779B97F4A7C15))
        assert m[0] == sum(1 << b for b in range(64) if 2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > len(s))
    apart = np.array([[int(simhash.distance(a[None], b[None])[0]) for b in marks] for a in marks])
    values = np.unique(marks, axis=0)
    q, at, _ = simhash.BKTree(values).within(marks, near_copies.RADIUS)
    assert {(i, tuple(v)) for i, v in zip(q.tolist(), values[at].tolist(), strict=True)} == {(i, tuple(marks[j].tolist())) for i, j in zip(*np.nonzero(apart <= near_copies.RADIUS), strict=True)}
    like = {(i, j) for i in range(len(sets)) for j in range(len(sets)) if near_copies.alike(sets[i], sets[j])}
    assert len(like) > 2 * len(sets) and max(apart[i, j] for i, j in like) <= near_copies.RADIUS < np.median(apart)
    _, _, sketch = near_copies.sketches(hashes, first)
    lead = max(range(len(sets)), key=lambda i: sum(a == i for a, _ in like))
    rows = pa.table({"lead": [lead] * len(sets), "vertex": range(len(sets)), "sketch": [x.tobytes() for x in sketch], "shingles": [(x >> np.uint64(32)).astype(np.uint32).tobytes() for x in sets]})
    assert {(lead, v) for v in near_copies.star(rows).column("v").to_pylist()} == {(i, j) for i, j in like if i == lead != j}
    monkeypatch.setattr(near_copies.BKTree, "within", lambda self, queries, radius: (np.zeros(0, int), np.zeros(0, int), 0))
    assert len(near_copies.star(rows)) == 0  # no other way leads to a link


def test_near_copies_are_those_of_brute_force(spark, small, monkeypatch):
    import corpus_pipeline as pipeline

    rng = random.Random(3)
    texts = [t for _, t, _ in small] + ["", " ", None, "one two", "One  two"]
    for n in (12, 40, 100, 300):
        for changes in (1, 2, 3, 5, 6, 9, 12):
            plain = [f"{n}q{changes}q{rng.randrange(10**6)}" for _ in range(n)]
            texts.append(" ".join(plain))
            for _ in range(4):  # also a chain: each from the one before
                plain = list(plain)
                for at in rng.sample(range(n), min(n, changes)):
                    plain[at] = f"new{rng.randrange(10**6)}"
                texts.append(" ".join(plain))
    sets, up = [], list(range(len(texts)))
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    near = 0
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 10 * both >= 8 * (len(sets[i]) + len(sets[j]) - both):
                near += sets[i] != sets[j]
                a, b = sorted((top(i), top(j)))
                up[b] = a
    want = {i: top(i) for i in range(len(texts))}
    assert near > 20
    docs = table(spark, texts)
    assert {r.key: r.component_id for r in near_copies.near_copies(docs).collect()} == want
    monkeypatch.setattr(near_copies, "TILE", 3)  # components in many tiles
    assert {r.key: r.component_id for r in near_copies.near_copies(docs).collect()} == want
    monkeypatch.undo()
    assert {r.doc_id for r in pipeline.near_duplicates(spark, docs, SF).collect()} == set(want.values())
    assert pipeline.near_duplicates(spark, docs.where("false"), SF).count() == 0
    same = docs.where("doc_id < 3").withColumn("doc_id", F.lit(5).cast("long"))  # three texts of one id, and rows without any
    odd = same.unionByName(same).unionByName(docs.where("doc_id < 2").withColumn("doc_id", F.lit(None).cast("long"))).unionByName(docs.where("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long")))
    groups = {want[i] for i in range(4)}
    assert sorted(str(r.doc_id) for r in pipeline.near_duplicates(spark, odd, SF).collect()) == sorted(["5"] * len({want[i] for i in range(3)}) + ["None"] * (len(groups) - len({want[i] for i in range(3)})))


# 7 Language


def test_language_evidence(spark):
    out = run(spark, "op7_language_id").toPandas()
    assert len(out) == spark.read.parquet(f"{SF}/pages.parquet").count()
    assert (out["lang"] == out["text_lang"]).mean() > 0.9 and out["posterior"].between(0, 1).all()


def test_visible_text_takes_time_in_proportion():
    import re
    import time

    old = re.compile(r"(?is)<(script|style|nav|header|footer|aside)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")
    rng = random.Random(4)
    marks = ["<!--", "-->", "<script>", "</script >", "<NAV x=1>", "</nav>", "<b", ">", "<", "text ", "&amp;", "</style>", "<style", "\n"]
    for _ in range(3000):
        page = "".join(rng.choice(marks) for _ in range(rng.randrange(12)))
        assert language_id.visible(page) == __import__("html").unescape(old.sub(" ", page)), page
    for mark in ("<!--", "<script>", "<script", "<", "<nav></nav", "<!-- -->"):
        began = time.time()
        language_id.visible(mark * (1_000_000 // len(mark)))
        assert time.time() - began < 3, mark


def test_languages_of_labelled_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 200")
    held = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    pages = docs.where(held).select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://h"), F.col("doc_id") % 7, F.lit(".example.com/")).alias("url"), F.concat(F.lit("<p>"), "text", F.lit("</p>")).alias("html"))
    got = language_id.identify(pages, docs.where(~held)).join(docs.select(F.col("doc_id").alias("page_id"), F.col("lang").alias("truth")), "page_id").toPandas()
    assert len(got) > 300 and (got["lang"] == got["truth"]).mean() > 0.95


def test_language_fusion_matches_a_plain_version(spark):
    docs = spark.createDataFrame([(1, "the and with from that this", "en"), (2, "der und mit von das nicht", "de"), (3, None, "en"), (4, "x", None)], "doc_id long, text string, lang string")
    html = lambda body, lang="": f"<html lang='{lang}'><nav>the with</nav><p>{body}</p><script>und</script></html>" if lang else f"<p>{body}</p>"
    pages = [
        (1, "http://a.example.de/x", html("der und mit", "de")), (2, "http://a.example.de/y", html("", "de")), (3, "https://b.example.com", html("the and", "en-GB")), (4, None, None), (5, "http://a.example.de/z", ""),
        (5, "http://a.example.de/z", ""), (None, "no address", html("with that")),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("lang", F.lit("clash"))
    got = sorted((str(r.page_id), r.host, r.declared, r.lang, round(r.posterior, 6)) for r in language_id.identify(df, docs).collect())
    names, table_ = language_id.likelihoods(language_id.trigram_counts(docs))
    rows = []
    for pid, url, source in pages:
        text = language_id.visible(source).encode()
        doc, bucket = language_id.trigrams(Block(None, np.frombuffer(text, np.uint8), np.array([0, len(text)])))
        logs = table_[:, bucket].astype(float).sum(1) * min(1.0, language_id.EVIDENCE / max(1, len(bucket)))
        p = np.exp(logs - logs.max())
        host = {1: "a.example.de", 2: "a.example.de", 3: "b.example.com", 5: "a.example.de"}.get(pid, "-")
        declared = {1: "de", 2: "de", 3: "en"}.get(pid, "-")
        rows.append((pid, host, ".".join(host.split(".")[-2:]), host.split(".")[-1], declared, logs, p / p.sum()))
    want = []
    norm = lambda v: v / v.sum()
    for pid, host, domain, suffix, declared, logs, p in rows:
        mass = lambda k, v: sum(r[6] for r in rows if r[k] == v)
        every = sum(r[6] for r in rows)
        of_domain = norm(np.maximum(mass(2, domain) - p, 0) + language_id.TRUST * norm(every + language_id.PSEUDO))
        prior = norm(np.maximum(mass(1, host) - p, 0) + language_id.TRUST * of_domain)
        fused = logs + np.log(prior)
        for k, v in ((4, declared), (3, suffix)):
            fused = fused + np.log((np.maximum(mass(k, v) - p, 0) + language_id.PSEUDO) / (np.maximum(every - p, 0) + 10 * language_id.PSEUDO))
        best = int(np.argmax(fused))
        want.append((str(pid), host, declared, names[best], round(float(1 / np.exp(fused - fused[best]).sum()), 6)))
    assert got == sorted(want)
    assert language_id.identify(df, docs.where("false")).count() == 0


# Clashing and dotted column names, repeated ids


def test_columns_of_any_name_are_carried_along(spark):
    docs = table(spark, ["alpha beta gamma " * 20, "one two three", None, ""])
    odd = docs.withColumn("_source", F.lit("clash")).withColumn("_home", F.lit(7)).withColumn("_key", F.lit("k")).withColumn("a.b", F.lit(1))
    names = odd.columns
    cut = substring_dedup.remove_repeats(odd)
    assert set(names) <= set(cut.columns) and cut.count() == 4 and {r["a.b"] for r in cut.collect()} == {1}
    mixed = mixing.mix_sources(odd)
    assert set(names) <= set(mixed.columns) and mixed.count() == 4 and {r["_source"] for r in mixed.collect()} == {"clash"}
    x = np.random.default_rng(1).random((40, len(quality_classifier.FEATURES)))
    scored = quality_classifier.score(odd, quality_classifier.fit(x, (x[:, 0] > 0.5).astype(float)))
    assert set(names) <= set(scored.columns) and scored.count() == 4 and {r["_key"] for r in scored.collect()} == {"k"}


def test_classifier_takes_one_row_of_each_id(spark):
    docs = table(spark, [f"text {i} " * (i + 1) for i in range(30)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    many = docs
    for _ in range(3):
        many = many.unionByName(docs)
    a, b = quality_classifier.learn(docs, labels), quality_classifier.learn(many.repartition(5), labels)
    assert a.intercept == b.intercept and all(np.array_equal(x, y) for x, y in zip(a.tables, b.tables, strict=True))


def test_homes_agree_and_spread(spark):
    ids = [0, 1, -5, 8, 16, 24, 1 << 40, -(1 << 63), (1 << 63) - 1] + [64 * k for k in range(200)]
    rows = spark.createDataFrame([(i,) for i in ids], "k long").select("k", substring_dedup.home_column("k", 8).alias("h")).collect()
    assert [r.h for r in rows] == substring_dedup.home_of(np.array([r.k for r in rows]), 8).tolist()
    assert len(set(substring_dedup.home_of(np.arange(0, 64 * 200, 64), 8).tolist())) == 8


# 8 Language model


def made_up_vocabulary(rng):
    counts = rng.integers(0, 50, 2500)
    vocabulary = A.Vocabulary.make(counts, rng.random(2500) < 0.5)
    vocabulary.learn(rng.poisson(0.05, (A.CLASSES, A.CLASSES)))
    return vocabulary


def test_model_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(4)
    vocabulary = made_up_vocabulary(rng)
    p = {k: w.astype(np.float64) + rng.normal(0, 0.05, w.shape) for k, w in A.initial().items()}
    ids = rng.integers(0, A.PAD, (3, A.SPAN))
    wants = rng.integers(0, A.PAD, (3, A.SPAN))
    ids[0, 30:], wants[0, 29:] = A.PAD, A.PAD
    _, grad = A.step(p, vocabulary, ids, wants)
    for k, w in p.items():
        flat = w.reshape(-1)
        for i in rng.choice(len(flat), 4, replace=False) if k != "E" else (int(ids[1, 5]) * A.WIDTH + 2, int(ids[2, 0]) * A.WIDTH):
            old, e = flat[i], 1e-4
            flat[i] = old + e
            up = A.step(p, vocabulary, ids, wants)[0]
            flat[i] = old - e
            down = A.step(p, vocabulary, ids, wants)[0]
            flat[i] = old
            assert grad[k].reshape(-1)[i] == pytest.approx((up - down) / (2 * e), rel=2e-2, abs=2e-5), k


def test_probabilities_add_up_and_see_no_future():
    rng = np.random.default_rng(1)
    vocabulary = made_up_vocabulary(rng)
    assert np.allclose(np.bincount(vocabulary.of, np.exp(vocabulary.share), A.PAD)[np.bincount(vocabulary.of, minlength=A.PAD) > 0], 1)
    p = A.initial()
    p = {k: (w + rng.normal(0, 0.3, w.shape)).astype(np.float32) for k, w in p.items()}
    text = rng.integers(0, A.PAD, 100)

    def logs(seq):
        slots, wants, (places, _) = A.layout(np.asarray(seq), np.array([0, len(seq)]), 3)
        return A.log_probabilities(p, vocabulary, slots, wants, places)

    base = logs(text)
    assert len(base) == 100
    assert sum(math.exp(logs([*text[:70], c])[70]) for c in range(A.PAD)) == pytest.approx(1, abs=1e-3)
    changed = text.copy()
    changed[80:] = (changed[80:] + 1) % A.PAD
    assert np.allclose(logs(changed)[:80], base[:80], atol=1e-5)
    slots, wants, (places, owner) = A.layout(np.concatenate([text, text[:5]]), np.array([0, 100, 105]), 3)
    both = A.log_probabilities(p, vocabulary, slots, wants, places)
    assert np.allclose(both[:100], base, atol=1e-4) and np.allclose(both[100:], base[:5], atol=1e-4) and owner.tolist() == [0, 0, 0, 0, 1]


def test_lm_scores(spark, small, awkward):
    got = by_id(run(spark, "op8_lm_scoring"))
    want = brute.base_scores([(d, t) for d, t, _ in small])
    assert set(got) == set(want)
    for d, (held, n, known, total, base) in want.items():
        assert got[d][:4] == (held, n, known, total) and got[d][4] == pytest.approx(base, rel=1e-9)
        assert math.isfinite(got[d][5]) and got[d][5] < 0
    out = by_id(lm_scoring.score_texts(awkward).select("doc_id", "n_tokens", "n_known", "base_score", "score"))
    base = brute.base_scores(list(enumerate(AWKWARD)))
    for i, (n, known, b, s) in out.items():
        assert (n, known) == base[i][1:3] and b == pytest.approx(base[i][4]) and math.isfinite(s)
    assert lm_scoring.score_texts(awkward.where("false")).count() == 0


def test_model_beats_word_counts_on_held_out_texts(spark):
    """The attention model alone (no word counts blended in) against the smoothed word frequencies."""
    rows = entry.queries()["op8_lm_scoring"](spark, "/root/testdata/sf0.1").where("held_out").toPandas()
    assert rows["score"].sum() > rows["base_score"].sum()
    assert rows["blended_score"].sum() > rows["base_score"].sum()


def test_lm_does_not_depend_on_partitions(spark, small):
    docs = spark.createDataFrame([(d, t) for d, t, _ in small], "doc_id long, text string")
    one, eight = (by_id(lm_scoring.score_texts(docs.repartition(n)).select("doc_id", "score", "blended_score")) for n in (1, 8))
    assert one.keys() == eight.keys()
    for d in one:
        assert eight[d] == pytest.approx(one[d], rel=1e-6)


def test_scoring_begins_without_the_shuffle_files_of_training(spark, small, monkeypatch):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {x for x in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in x}
    docs = spark.createDataFrame([(d, t) for d, t, _ in small], "doc_id long, text string")
    old, trained, left, train, score = files(), [], [], lm_scoring.train, lm_scoring.score

    def training(*args):
        out = train(*args)
        trained.append(files() - old)
        return out

    def scoring(*args):
        left.append(files() - old)
        return score(*args)

    monkeypatch.setattr(lm_scoring, "train", training)
    monkeypatch.setattr(lm_scoring, "score", scoring)
    assert lm_scoring.score_texts(docs).count() == len(small)
    assert trained[0] and left == [set()]


def test_training_windows_tile_every_document(spark, small):
    docs = [(d, t) for d, t, _ in small[:40]] + [(10**6, LONG), (10**6 + 1, ""), (10**6 + 3, "one"), (3, "a row twice"), (3, "a row twice")]
    vocabulary = A.Vocabulary.make(np.ones(50257, np.int64), np.zeros(50257, dtype=bool))
    coded = lm_scoring.staged(lm_scoring.encoded(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)), "coded")
    want, n, start = [], 0, int(vocabulary.of[lm_scoring.END])
    for row in coded.collect():
        c = lm_scoring.Coded(row.asDict())
        ids, first = c.sequences(np.flatnonzero(c.train))
        for a, z in zip(first[:-1], first[1:], strict=True):
            seq = [start, *vocabulary.of[ids[a:z]].tolist()]
            want += zip(seq[:-1], seq[1:], strict=True)
            n += -(-(len(seq) - 1) // A.SPAN)
    units = lm_scoring.staged(lm_scoring.units(coded, vocabulary, 7), "units")
    got, windows = [], 0
    for unit in range(7):
        rows = units.where(f"unit = {unit}").toArrow()
        for slots, wants in lm_scoring.tiles(rows, start) if len(rows) else ():
            assert len(slots) <= lm_scoring.BATCH
            windows += len(slots)
            got += zip(slots[wants != A.PAD].tolist(), wants[wants != A.PAD].tolist(), strict=True)
    assert sorted(got) == sorted(want) and windows == n
    pairs = lm_scoring.pair_counts(coded, vocabulary)
    assert pairs.sum() == len(want) and all(pairs[a, b] == k for (a, b), k in Counter(want).items())


# 9 Substrings


def test_substring_dedup(spark, small, awkward):
    assert by_id(run(spark, "op9_substring_dedup")) == brute.substring_dedup([(d, t) for d, t, _ in small])
    got = by_id(substring_dedup.remove_repeats(awkward, digest_only=True))
    assert got == brute.substring_dedup(list(enumerate(AWKWARD)))
    full = {r.doc_id: r for r in substring_dedup.remove_repeats(awkward.withColumn("n_removed", F.lit("clash"))).collect()}
    assert all(full[i].text == t for i, t in enumerate(AWKWARD) if got[i][1] == 0) and full[12].text.endswith("tail")
    assert substring_dedup.remove_repeats(awkward.where("false"), digest_only=True).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_random_texts_lose_the_same_words(spark, seed, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 300)
    monkeypatch.setattr(substring_dedup, "HOME_BYTES", 700)
    rng = random.Random(seed)
    texts = ["".join(rng.choice(["a ", "b\n"]) for _ in range(rng.randrange(0, 120))) for _ in range(60)]
    ids = rng.sample(range(-50, 1000), 60)
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(5)
    assert by_id(substring_dedup.remove_repeats(docs, 5, digest_only=True)) == brute.substring_dedup(list(zip(ids, texts, strict=True)), 5)


def test_rows_of_one_id_are_documents_of_their_own(spark):
    said = " ".join(f"said{i}" for i in range(30))
    one, other = (" ".join(f"{name}{i}" for i in range(60)) for name in ("one", "other"))
    rows = [(i, t) for i in (None, 7) for t in (one if i else other, f"{said} clean {i}")] + [(7, f"{said} clean 7"), (7, f"{said} tail"), (9, one)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id or 0, r.text, r.n_removed) for r in substring_dedup.remove_repeats(docs).collect())
    assert {x for x in got if x[0] == 0} == {(0, other, 0), (0, f"{said} clean None", 0)}
    assert {x for x in got if x[0] == 7 and "one0" in x[1]} == {(7, one, 0)}
    assert sorted(x[1:] for x in got if x[0] == 7 and x[1] != one) == [("", 32), ("7", 31), ("tail", 30)]
    assert [x for x in got if x[0] == 9] == [(9, "", 60)]


def test_packed_places_round_trip():
    rng = np.random.default_rng(0)
    ids = np.sort(rng.integers(-(2**60), 2**60, 50)).repeat(rng.integers(1, 30, 50))
    places = np.concatenate([np.sort(rng.choice(10**6 if i % 2 else 300, n, replace=False)) for i, n in enumerate(np.unique(ids, return_counts=True)[1])])
    got = substring_dedup._unpacked(*substring_dedup._packed(ids, places))
    assert (got[0] == ids).all() and (got[1] == places).all()
    h = rng.integers(0, 2**63, 20, dtype=np.uint64)
    assert (substring_dedup._from_seven(substring_dedup._seven(h)) == h & np.uint64((1 << 56) - 1)).all()


# 10 Search


def test_top_k(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert {tuple(r) for r in run(spark, "op10_topk_search").collect()} == brute.top_scores(rows)


def test_top_k_of_awkward_vectors(spark):
    rng = random.Random(0)
    rows = [(i, [rng.gauss(0, 1 if i % 3 else 40) for _ in range(6)]) for i in range(700)]
    rows[20:40] = [(i, [0.5] * 6) for i in range(20, 40)]
    rows += [(1000, None), (1020, [1.0, None, 2.0, 0.0, 0.0, 0.0]), (1040, [float("nan")] * 6), (1060, [float("inf")] * 6), (1080, [1e6] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select(F.col("vec_id").alias("id"), topk_search.quantised(F.col("embedding")).alias("v"))
    got = {tuple(r) for r in topk_search.top_k(df.where("id % 20 = 0"), df, shard=150, block=20).collect()}
    assert got == brute.top_scores(rows)
    few = df.where("id in (0, 20, 21)")
    assert topk_search.top_k(few.where("id % 20 = 0"), few).count() == 4
    assert topk_search.top_k(df.where("false"), df.where("false")).count() == 0


def test_lists_stop_early_on_clustered_vectors():
    rng = np.random.default_rng(3)
    centres = rng.integers(-60, 60, (40, 16))
    x = np.repeat(centres, 50, axis=0) + rng.integers(-2, 3, (2000, 16))
    lists = topk_search.SortedLists(np.arange(2000), x)
    resolved = []
    plain = lists._resolve
    lists._resolve = lambda rows, *a: resolved.append(len(rows)) or plain(rows, *a)
    got = lists.top(x[:30], np.arange(30), 20)
    for i, (rows, scores) in enumerate(got):
        every = x @ x[i]
        best = sorted((-every[j], j) for j in range(2000) if j != i)[:20]
        assert [(-s, j) for s, j in zip(scores, lists.ids[rows], strict=True)] == [(s, j) for s, j in best]
    assert max(resolved) < 1000


# The pipeline


def test_pipeline_stages_take_effect(spark, small):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == list(pipeline.COLUMNS), name
        before, docs = docs, out.cache()
        counts.append(docs.count())
        if name == "repeated_passages":
            cut = brute.substring_dedup([(r.doc_id, r.text) for r in before.collect()])
            assert {r.doc_id: len(brute.split(r.text)) for r in docs.collect()} == {d: n - gone for d, (n, gone, _) in cut.items() if gone == 0 or gone < n}
            assert docs.where("n_chars <> length(text)").count() == 0
    assert counts[0] > counts[1] > counts[2] >= counts[3] and counts[4] != counts[3]
    final = pipeline.STAGES[-1][1](spark, docs, SF)
    assert final.agg(F.sum("length")).first()[0] == sum(r.doc_tokens for r in final.where("start = 0").collect())


def test_queries_of_the_subpackage_are_registered():
    names = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert os.path.exists(entry.__file__)


@pytest.mark.parametrize("name", ["op4_token_counts", "op9_substring_dedup", "op10_topk_search"])
def test_queries_agree_with_their_sql(spark, name):
    assert spark_table(run(spark, name)) == duck_table(entry.oracle_sql()[name])
