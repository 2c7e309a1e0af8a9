"""BLAKE3 in numpy: all chunks of a batch of values are compressed side by side, one lane each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of BLAKE3: initial state, message permutation, domain flags.
IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
PERMUTATION = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8

_U = np.uint32


def _rotate(x: np.ndarray, by: int) -> np.ndarray:
    return (x >> _U(by)) | (x << _U(32 - by))


def _mix(s: list[np.ndarray], a: int, b: int, c: int, d: int, x: np.ndarray, y: np.ndarray) -> None:
    s[a] = s[a] + s[b] + x
    s[d] = _rotate(s[d] ^ s[a], 16)
    s[c] = s[c] + s[d]
    s[b] = _rotate(s[b] ^ s[c], 12)
    s[a] = s[a] + s[b] + y
    s[d] = _rotate(s[d] ^ s[a], 8)
    s[c] = s[c] + s[d]
    s[b] = _rotate(s[b] ^ s[c], 7)


def _compress(chain: np.ndarray, words: np.ndarray, counter: np.ndarray, length: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """chain (8, lanes), words (16, lanes) -> next chain (8, lanes)."""
    full = lambda v: np.full(chain.shape[1], v, _U)
    s = [*chain, *(full(v) for v in IV[:4]), (counter & 0xFFFFFFFF).astype(_U), (counter >> 32).astype(_U), length.astype(_U), flags.astype(_U)]
    m = list(words)
    for turn in range(7):
        for i in range(4):
            _mix(s, i, 4 + i, 8 + i, 12 + i, m[2 * i], m[2 * i + 1])
        for i in range(4):
            _mix(s, i, 4 + (i + 1) % 4, 8 + (i + 2) % 4, 12 + (i + 3) % 4, m[8 + 2 * i], m[9 + 2 * i])
        if turn < 6:
            m = [m[p] for p in PERMUTATION]
    return np.stack([s[i] ^ s[i + 8] for i in range(8)])


def blake3_many(values: list[bytes]) -> list[str]:
    """Lower-case hex BLAKE3 of each value."""
    if not values:
        return []
    size = np.array([len(v) for v in values], np.int64)
    chunks = np.maximum(1, -(-size // 1024))
    owner = np.repeat(np.arange(len(values)), chunks)
    index = np.arange(len(owner)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    data = np.zeros((len(owner), 1024), np.uint8)
    at = 0
    for v, n in zip(values, chunks.tolist(), strict=True):
        data[at : at + n].reshape(-1)[: len(v)] = np.frombuffer(v, np.uint8)
        at += n
    length = np.minimum(1024, size[owner] - 1024 * index)
    blocks = np.maximum(1, -(-length // 64))
    alone = chunks[owner] == 1
    chain = np.repeat(np.array(IV, _U)[:, None], len(owner), axis=1)
    words = data.view("<u4").reshape(len(owner), 16, 16)
    for b in range(int(blocks.max())):
        on = np.flatnonzero(blocks > b)
        last = blocks[on] == b + 1
        flags = CHUNK_START * (b == 0) + CHUNK_END * last + ROOT * (last & alone[on])
        chain[:, on] = _compress(chain[:, on], words[on, b].T, index[on], np.clip(length[on] - 64 * b, 0, 64), flags)
    while len(owner) > len(values):  # join neighbours; an odd last one goes up as it is
        count = np.bincount(owner, minlength=len(values))
        first = np.cumsum(count) - count
        place = np.arange(len(owner)) - np.repeat(first, count)
        left = np.flatnonzero((place % 2 == 0) & (place + 1 < count[owner]))
        flags = PARENT + ROOT * (count[owner[left]] == 2)
        zero = np.zeros(len(left), np.int64)
        made = _compress(np.repeat(np.array(IV, _U)[:, None], len(left), axis=1), np.concatenate([chain[:, left], chain[:, left + 1]]), zero, zero + 64, flags)
        stay = place % 2 == 0
        chain[:, left] = made
        chain, owner = chain[:, stay], owner[stay]
    raw = np.ascontiguousarray(chain.T).astype("<u4").tobytes()
    return [raw[32 * i : 32 * i + 32].hex() for i in range(len(values))]


@F.pandas_udf(T.StringType())
def blake3_hex(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """BLAKE3 of a binary column; null stays null."""
    for part in values:
        known = part.notna()
        out = pd.Series([None] * len(part), dtype=object)
        out[known.to_numpy()] = blake3_many(part[known].tolist())
        yield out
