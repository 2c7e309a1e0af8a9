"""Counts of each whole text, made a block of documents at a time."""

from __future__ import annotations

import numpy as np

from chunkloom.llm.common import SPACE, Block, Words, per_doc, span_hashes, window_hashes, window_places, words

_CLASS = {name: np.zeros(256, dtype=bool) for name in ("symbol", "upper", "lower", "digit", "bang", "bar", "stop", "comma", "high")}
for _name, _chars in {"symbol": b"#*$%&|<>", "bang": b"!", "bar": b"|", "stop": b".?", "comma": b",;:", "digit": b"0123456789"}.items():
    _CLASS[_name][list(_chars)] = True
_CLASS["upper"][65:91] = True
_CLASS["lower"][97:123] = True
_CLASS["high"][0xC2:0xF5] = True
_CONTINUATION = np.zeros(256, dtype=bool)
_CONTINUATION[0x80:0xC0] = True


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which of the keys occur more than once."""
    if len(keys) == 0:
        return np.zeros(0, dtype=bool)
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(len(keys), dtype=bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    return twice


def _doc_salt(doc: np.ndarray) -> np.ndarray:
    return (doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9FB21C651E98DF25)


def repeat_words(w: Words, hashes: np.ndarray, k: int = 3) -> np.ndarray:
    """Words of each document in windows of k words that its text has twice or more."""
    inside = window_places(w.first, k)
    cover = np.zeros(len(hashes) + 1, np.int64)
    if inside.any():
        places = np.flatnonzero(inside)
        keys = window_hashes(hashes, k)[places] ^ _doc_salt(w.doc[places])
        at = places[_repeated(keys)]
        np.add.at(cover, at, 1)
        np.add.at(cover, at + k, -1)
    return per_doc(w.first, np.cumsum(cover)[:-1] > 0)


def duplicate_lines(block: Block, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word of each document, and those of them that equal an earlier line."""
    data, off = block.data, block.off
    n = len(off) - 1
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([breaks + 1, off[:-1]]))
    ends = np.sort(np.concatenate([breaks, off[1:]]))
    doc = np.repeat(np.arange(n), np.bincount(np.searchsorted(off, breaks, side="right") - 1, minlength=n) + 1 if len(breaks) else np.ones(n, np.int64))
    full = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
    starts, ends, doc = starts[full], ends[full], doc[full]
    keys = span_hashes(data, starts, ends) ^ _doc_salt(doc)
    lines = np.bincount(doc, minlength=n)
    distinct = np.bincount(doc[np.unique(keys, return_index=True)[1]], minlength=n) if len(keys) else np.zeros(n, np.int64)
    return lines, lines - distinct


#: The inputs of the quality classifier, in this order.
FEATURES = (
    "log_words", "chars_per_word", "symbols_per_word", "upper_share", "bang_per_word", "bar_per_word", "digit_share",
    "stop_per_word", "comma_per_word", "high_share", "dup_line_share", "repeat_share", "distinct_share", "words_per_line", "top_word_share",
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def stats(block: Block) -> dict[str, np.ndarray]:
    """COUNTS (integers) and FEATURES (doubles) of each document; an empty text has zeros."""
    w = words(block)
    data, off, doc = block.data, block.off, w.doc
    hashes = span_hashes(data, w.starts, w.ends)
    lines, dup = duplicate_lines(block, w)
    n, chars = np.maximum(w.counts, 1), per_doc(off, ~_CONTINUATION[data])
    spaces = per_doc(off, SPACE[data])
    count = {k: per_doc(off, mask[data]) for k, mask in _CLASS.items()}
    letters = np.maximum(count["upper"] + count["lower"], 1)
    repeat = repeat_words(w, hashes)
    distinct, top = np.zeros(len(block)), np.zeros(len(block))
    if len(hashes):
        _, at, times = np.unique(hashes ^ _doc_salt(doc), return_index=True, return_counts=True)
        distinct = np.bincount(doc[at], minlength=len(block))
        np.maximum.at(top, doc[at], times)
    return {
        "n_words": w.counts.astype(np.int64), "word_chars": chars - spaces, "n_symbols": count["symbol"], "n_dup_lines": dup.astype(np.int64), "n_repeat_words": repeat,
        "log_words": np.log1p(w.counts), "chars_per_word": chars / n, "symbols_per_word": count["symbol"] / n, "upper_share": count["upper"] / letters,
        "bang_per_word": count["bang"] / n, "bar_per_word": count["bar"] / n, "digit_share": count["digit"] / np.maximum(chars, 1),
        "stop_per_word": count["stop"] / n, "comma_per_word": count["comma"] / n, "high_share": count["high"] / np.maximum(chars, 1),
        "dup_line_share": dup / np.maximum(lines, 1), "repeat_share": repeat / n, "distinct_share": distinct / n,
        "words_per_line": w.counts / np.maximum(lines, 1), "top_word_share": top / n,
    }


def features(block: Block) -> np.ndarray:
    """FEATURES of each document as columns."""
    s = stats(block)
    return np.column_stack([s[name].astype(np.float64) for name in FEATURES])
