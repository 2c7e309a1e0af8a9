"""Subword ids of whole texts, a block of documents at a time.

The byte-level tokenizer first cuts a text into words by a pattern and then merges inside each word. Cutting is done
with array operations on a block's code points; each distinct word of the block is given to the tokenizer once, and
known ones are taken from a bounded cache, so that the ids equal the tokenizer's own on the whole text.
"""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import chain

import numpy as np

from chunkloom.llm.common import Block, distinct, gather_spans, span_hashes

DEFAULT = "byte_bpe_50k.json"
CACHE = 200_000
OTHER, LETTER, NUMBER, SPACE = range(4)
#: The code points with the Unicode property White_Space.
WHITE_SPACE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    import regex

    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            a, b = (x if x < 0xD800 else x + 0x800 for x in (m.start(), m.end() - 1))
            out[a : b + 1] = kind
    out[list(WHITE_SPACE)] = SPACE
    return out


def cuts(points: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where the tokenizer's words begin, in code points; they tile every document.

    A run of letters, of numbers or of other signs is a word, with one blank before it if there is one. White space
    before a word leaves its last character out, which begins a word of its own unless it is that blank. An apostrophe
    with s, t, m, d, re, ve or ll after it is a word.
    """
    n = len(points)
    if n == 0:
        return np.zeros(0, np.int64)
    kind = _classes()[points]
    head = np.zeros(n + 1, dtype=bool)
    head[off] = True
    begin = head[:n].copy()
    begin[1:] |= kind[1:] != kind[:-1]
    space, blank = kind == SPACE, points == 32
    follows = begin & ~space & ~head[:n]
    runs = begin.copy()
    joined = np.zeros(n, dtype=bool)
    joined[1:] = follows[1:] & blank[:-1]
    begin &= ~joined
    last = np.flatnonzero(follows[1:] & space[:-1])
    begin[last] = True
    quote = np.flatnonzero((points[:-1] == 39) & begin[:-1] & (kind[1:] == LETTER) & ~head[1:n]) if n > 1 else np.zeros(0, np.int64)
    quote = quote[runs[quote]]
    if len(quote):
        padded = np.append(points, [0, 0, 0])
        inside = np.append(head, [True, True])
        a, b = padded[quote + 1], np.where(inside[quote + 2], 0, padded[quote + 2])
        size = np.where(np.isin(a, [ord(c) for c in "stmd"]), 2, 0)
        for x, y in ("re", "ve", "ll"):
            size[(a == ord(x)) & (b == ord(y))] = 3
        quote, size = quote[size > 0], size[size > 0]
        begin[quote + 1] = False
        after = quote + size
        ok = after < n
        quote, after = quote[ok], after[ok]
        begin[after[(kind[after] == LETTER) & ~head[after]]] = True
    return np.flatnonzero(begin)


def _byte_names() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable ones name themselves, the others follow from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    names = {chr(b): b for b in own}
    return names | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}


class Subwords:
    """ids of blocks by one tokenizer file; strings of special tokens in a text are ordinary text.

    Where the ids of merged tokens follow the order of the merges, as is checked, merging inside a word by least id gives
    the same ids as the tokenizer and is done by the faster of the two libraries; other vocabularies go to the tokenizer.
    """

    def __init__(self, path: str | None = None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or default_path())
        self.tokenizer.encode_special_tokens = True
        self.cache: dict[int, list[int]] = {}
        self.merge = self._merger()

    @classmethod
    @lru_cache(maxsize=1)
    def shared(cls, path: str | None = None) -> Subwords:
        """One instance per process, so that the tasks of a worker share its cache."""
        return cls(path)

    def _merger(self):
        import json

        import tiktoken

        model = json.loads(self.tokenizer.to_str())["model"]
        names, vocabulary = _byte_names(), model["vocab"]
        merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        ranks = [vocabulary.get(m, -1) for m in merges]
        if ranks != sorted(set(ranks)) or -1 in ranks or any(vocabulary.get(n, 1 << 30) > min(ranks) for n in names):
            return None
        table = {bytes(names[c] for c in token): vocabulary[token] for token in [*names, *merges]}
        coder = tiktoken.Encoding("words", pat_str=r"(?s).+", mergeable_ranks=table, special_tokens={})
        return coder._core_bpe.encode_single_piece if hasattr(coder._core_bpe, "encode_single_piece") else None

    def encode(self, words: list[str]) -> list[list[int]]:
        if self.merge is not None:
            return [self.merge(w.encode()) for w in words]
        return [e.ids for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]

    def ids(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the block's texts one after another, and where each document's begin (one entry more than documents)."""
        text = block.data.tobytes().decode("utf-8", errors="replace")
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        byte_starts = np.flatnonzero((block.data & 0xC0) != 0x80)
        off = np.searchsorted(byte_starts, block.off) if len(byte_starts) == len(points) else _offsets(block)
        starts = cuts(points, off)
        ends = np.append(starts[1:], len(points))
        keys, where, which = distinct(span_hashes(points, starts, ends))
        if len(self.cache) > CACHE:
            self.cache.clear()
        names, cache = keys.tolist(), self.cache
        new = [i for i, key in enumerate(names) if key not in cache]
        lo, hi = starts[where].tolist(), ends[where].tolist()
        for i, got in zip(new, self.encode([text[lo[i] : hi[i]] for i in new]), strict=True):
            cache[names[i]] = got
        found = [cache[key] for key in names]
        size = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum()))
        each = size[which]
        ids = flat[gather_spans(each, (np.cumsum(size) - size)[which])]
        first = np.append(0, np.cumsum(each))[np.searchsorted(starts, off)]
        return ids, first


def _offsets(block: Block) -> np.ndarray:
    """Code points before each document of a block with broken UTF-8."""
    size = [len(block.data[a:b].tobytes().decode("utf-8", errors="replace")) for a, b in zip(block.off[:-1], block.off[1:], strict=True)]
    return np.append(0, np.cumsum(size)).astype(np.int64)
