"""Content-defined chunking by the FastCDC (2020) rule with normalised masks.

The gear hash of a place depends on at most 64 bytes, so it is computed for all places of a value at once; only the
choice of cuts walks from chunk to chunk.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

#: The judgement masks by their number of one bits (5 to 25).
MASKS = {
    5: 0x0000000001804110, 6: 0x0000000001803110, 7: 0x0000000018035100, 8: 0x0000001800035300, 9: 0x0000019000353000,
    10: 0x0000590003530000, 11: 0x0000D90003530000, 12: 0x0000D90103530000, 13: 0x0000D90303530000, 14: 0x0000D90313530000,
    15: 0x0000D90F03530000, 16: 0x0000D90303537000, 17: 0x0000D90703537000, 18: 0x0000D90707537000, 19: 0x0000D91707537000,
    20: 0x0000D91747537000, 21: 0x0000D91767537000, 22: 0x0000D93767537000, 23: 0x0000D93777537000, 24: 0x0000D93777577000,
    25: 0x0000DB3777577000,
}


@lru_cache(maxsize=1)
def gear() -> np.ndarray:
    """One 64-bit number per byte value: the head of the MD5 of 64 such bytes."""
    return np.array([int.from_bytes(hashlib.md5(bytes([b]) * 64).digest()[:8], "big") for b in range(256)], np.uint64)


def sizes(avg: int) -> tuple[int, int, int]:
    """Minimum, average and maximum length of a chunk."""
    avg = max(avg, 64)
    return max(avg // 4, 64), avg, max(4 * avg, avg)


def chunks(data: bytes, avg: int) -> list[tuple[int, int]]:
    """(offset, length) of the chunks of ``data``; no data, no chunks."""
    least, mean, most = sizes(avg)
    bits = int(np.floor(np.log2(mean) + 0.5))
    strict, loose = np.uint64(MASKS[bits + 1]), np.uint64(MASKS[bits - 1])
    g = gear()[np.frombuffer(data, np.uint8)]
    rolled = g.copy()
    for width in (1, 2, 4, 8, 16, 32):
        rolled[width:] += rolled[:-width] << np.uint64(width)
    out, at = [], 0
    hits = {m: np.flatnonzero(rolled & m == 0) for m in (strict, loose)}
    while at < len(data):
        left = len(data) - at
        cut = left
        if left > least:
            left = min(left, most)
            centre = min(mean, left)
            cut = _cut(g[at : at + left], {m: h for m, h in hits.items()}, at, least // 2 * 2, centre // 2 * 2, left // 2 * 2, strict, loose)
            cut = left if cut is None else cut
        out.append((at, cut))
        at += cut
    return out


def _cut(g: np.ndarray, hits: dict[np.uint64, np.ndarray], at: int, least: int, centre: int, end: int, strict: np.uint64, loose: np.uint64) -> int | None:
    """The first place from ``least`` whose hash has no bit of the mask in force there; the hash starts empty at ``least``."""
    h, young = 0, min(end, least + 64)
    for i in range(least, young):
        h = (2 * h + int(g[i])) & 0xFFFFFFFFFFFFFFFF
        if h & int(strict if i < centre else loose) == 0:
            return i
    for mask, lo, hi in ((strict, young, centre), (loose, max(young, centre), end)):
        k = np.searchsorted(hits[mask], at + lo)
        if lo < hi and k < len(hits[mask]) and hits[mask][k] < at + hi:
            return int(hits[mask][k]) - at
    return None


def cdc_chunks(avg: int):
    """A UDF from binary to array<struct<offset: long, len: long>>."""

    @F.pandas_udf("array<struct<offset: long, len: long>>")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: [] if v is None else [{"offset": a, "len": n} for a, n in chunks(v, avg)])

    return run
