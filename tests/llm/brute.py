"""Plain-Python versions of the operators' contracts, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def split(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def crc(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode())


def base_counts(text: str | None) -> tuple:
    words = split(text)
    windows = defaultdict(list)
    for i in range(len(words) - 2):
        windows[tuple(words[i : i + 3])].append(i)
    cover = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if split(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(cover), n < 50 or 100 * len(cover) > 50 * n


def fingerprint(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    k = min(3, len(words))
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def near_components(rows: list[tuple], radius: int = 2) -> dict:
    """[(doc_id, fingerprint)] -> {doc_id: smallest doc_id reachable}."""
    least = {}
    for d, f in rows:
        least[f] = min(d, least.get(f, d))
    marks = sorted(least)
    up = {f: f for f in marks}

    def top(f):
        while up[f] != f:
            f = up[f]
        return f

    for i, a in enumerate(marks):
        for b in marks[:i]:
            if (a ^ b).bit_count() <= radius:
                up[top(a)] = top(b)
    roots = defaultdict(list)
    for f in marks:
        roots[top(f)].append(least[f])
    return {d: min(roots[top(f)]) for d, f in rows}


def substring_dedup(rows: list[tuple], k: int = 20) -> dict:
    """[(doc_id, text)] with distinct ids -> {doc_id: (n_words, n_removed, sha256)}."""
    rows = sorted(rows)
    words = {d: split(t) for d, t in rows}
    first = {}
    gone = defaultdict(set)
    for d, _ in rows:
        for i in range(len(words[d]) - k + 1):
            key = tuple(words[d][i : i + k])
            if key in first:
                gone[d].update(range(i, i + k))
            else:
                first[key] = (d, i)
    return {d: (len(w), len(gone[d]), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone[d]).encode()).hexdigest()) for d, w in words.items()}


def mix_targets(sizes: dict, weights=(3, 1, 2), share=1.5, cap=2.0) -> dict:
    """{source: size} -> {source: target}, by resharing the excess until none is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, left = set(), share * sum(sizes.values())
    while True:
        rest = sum(w[s] for s in names if s not in full)
        over = [s for s in names if s not in full and left * w[s] / rest > cap * sizes[s]]
        if not over:
            return {s: cap * sizes[s] if s in full else left * w[s] / rest for s in names}
        full |= set(over)
        left = share * sum(sizes.values()) - sum(cap * sizes[s] for s in full)


def base_scores(rows: list[tuple]) -> dict:
    """[(doc_id, text)] -> {doc_id: (held_out, n_tokens, n_known, train_tokens, base_score)}."""
    tokens = {d: split("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) + [None] for d, t in rows}
    count = Counter(x for d, ts in tokens.items() if crc(d) % 10 for x in ts)
    n, v = sum(count.values()), len(count)
    return {d: (crc(d) % 10 == 0, len(ts), sum(count[x] > 0 for x in ts), n, sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in ts)) for d, ts in tokens.items()}


def top_scores(rows: list[tuple], k: int = 20) -> set:
    """[(vec_id, vector of floats)] -> {(query_id, rank, vec_id, score)}."""
    vecs = {i: [math.floor(64 * x) for x in v] for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q in vecs:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(vecs[q], vecs[c], strict=True)), c) for c in vecs if c != q)[:k]
            out |= {(q, r, c, -s) for r, (s, c) in enumerate(best, 1)}
    return out
