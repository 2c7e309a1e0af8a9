"""A small causal self-attention model of subword ids in numpy: one layer, trained by Adam, scored in windows.

Ids fall into classes (the frequent ones have their own) and classes into groups. The next id's probability is that of
its group and of its class within the group, times the id's share of its class in the training counts; sums of
probabilities over all ids are one. The logits begin as the log probabilities of a class after another, counted over all
training text and not trained further; the layer learns what the rest of the window adds to them. Its input at a slot is
the embedding of the slot's class and, weighted, that of the class before; every slot attends to all slots up to it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

GROUPS, MEMBERS, WIDTH = 32, 32, 16
#: A window scores STRIDE ids and sees CONTEXT more before them.
STRIDE, CONTEXT = 32, 16
SPAN = STRIDE + CONTEXT
CLASSES = PAD = GROUPS * MEMBERS
#: Pseudo-counts of an id, and of the overall shares among the counts after a class.
SMOOTH, BACK_OFF = 0.1, 3.0
_BACK = np.arange(SPAN)[:, None] - np.arange(SPAN)


@dataclass
class Vocabulary:
    """The class of each id, the log of its share of the class, and the log probabilities of groups and classes after each class."""

    of: np.ndarray
    share: np.ndarray
    total: np.ndarray
    group_after: np.ndarray
    class_after: np.ndarray

    @classmethod
    def make(cls, counts: np.ndarray, begins: np.ndarray) -> Vocabulary:
        """``begins``: which ids begin a word; these and the others use separate groups."""
        of = np.zeros(len(counts), np.int64)
        half = CLASSES // 2
        rare = GROUPS
        for side, mask in enumerate((begins, ~begins)):
            order = np.flatnonzero(mask)[np.argsort(-counts[mask], kind="stable")]
            rank = np.arange(len(order))
            place = np.where(rank < half - rare, rank, half - rare + rank % rare)
            of[order] = side * half + (place % (GROUPS // 2)) * MEMBERS + place // (GROUPS // 2)
        total = np.maximum(np.bincount(of, counts + SMOOTH, CLASSES), SMOOTH)
        out = cls(of, np.log((counts + SMOOTH) / total[of]), total, *(np.zeros(0),) * 2)
        out.learn(np.zeros((CLASSES, CLASSES)))
        return out

    def learn(self, pairs: np.ndarray) -> None:
        """Take ``pairs``, how often a class follows another (columns after rows); PAD is followed by the overall shares."""
        share = self.total / self.total.sum()
        p = (pairs + BACK_OFF * share) / (pairs.sum(1, keepdims=True) + BACK_OFF)
        p = np.vstack([p, share]).reshape(CLASSES + 1, GROUPS, MEMBERS)
        group = p.sum(2)
        self.group_after, self.class_after = np.log(group).astype(np.float32), np.log(p / group[:, :, None]).astype(np.float32)


def initial(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    return {
        "E": draw(PAD + 1, WIDTH, scale=0.5), "F": np.full(WIDTH, 0.5, np.float32), "A": draw(WIDTH, WIDTH, scale=0.02), "V": draw(WIDTH, WIDTH, scale=0.2),
        "R": np.zeros(SPAN, np.float32), "G": draw(WIDTH, GROUPS, scale=0.02), "C": draw(GROUPS, WIDTH, MEMBERS, scale=0.02),
    }


def _sums(x: np.ndarray) -> np.ndarray:
    """Sums over the last axis."""
    return x @ np.ones(x.shape[-1], x.dtype)


def _exp(x: np.ndarray, top: float) -> None:
    """exp in place, of at most ``top``."""
    if x.size and x.max() > top:
        np.minimum(x, top, out=x)
    np.exp(x, out=x)


def _attend(p: dict[str, np.ndarray], ids: np.ndarray, queries: int) -> tuple[np.ndarray, ...]:
    """States of the last ``queries`` slots of windows of class ids, and what the gradient needs.

    The weights ``a`` are not divided by their sums ``total``.
    """
    x = p["E"].take(ids, axis=0)
    x[:, 1:] += (p["E"] * p["F"]).take(ids[:, :-1], axis=0)
    q = x[:, SPAN - queries :] @ p["A"]
    a = q @ x.transpose(0, 2, 1)
    back = _BACK[SPAN - queries :]
    a += np.where(back >= 0, p["R"][np.maximum(back, 0)], a.dtype.type(-1e9))
    empty = np.flatnonzero((ids == PAD).any(1))
    if len(empty):
        a[empty] += np.where(ids[empty] == PAD, a.dtype.type(-1e9), a.dtype.type(0))[:, None]
    _exp(a, 40)
    total = _sums(a)[:, :, None]
    total += a.dtype.type(1e-30)
    seen = a @ x
    seen /= total
    return x[:, SPAN - queries :] + seen @ p["V"], x, q, a, total, seen


def _outcome(p: dict[str, np.ndarray], v: Vocabulary, rows: np.ndarray, before: np.ndarray, want: np.ndarray) -> tuple:
    """Log probabilities of the classes ``want`` (in the order of their groups) after states and classes, and what the gradient needs."""
    group = want // MEMBERS
    z = rows @ p["G"]
    z += v.group_after.take(before, axis=0)
    y = v.class_after.reshape(-1, MEMBERS).take(before * GROUPS + group, axis=0).astype(z.dtype, copy=False)
    ends = np.cumsum(np.bincount(group, minlength=GROUPS))
    spans = [(g, lo, hi) for g, (lo, hi) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)) if hi > lo]
    for g, lo, hi in spans:
        y[lo:hi] += rows[lo:hi] @ p["C"][g]
    at = np.arange(len(want))
    logs = z[at, group] + y[at, want % MEMBERS]
    for s in (z, y):
        _exp(s, 60)
    zs, ys = _sums(z), _sums(y)
    return logs - np.log(zs) - np.log(ys), z, y, zs, ys, spans


def _by_group(want: np.ndarray) -> np.ndarray:
    """Places of the targets that are not PAD, in the order of their groups."""
    keep = np.flatnonzero(want != PAD)
    return keep[np.argsort((want[keep] // MEMBERS).astype(np.uint8), kind="stable")]


def step(p: dict[str, np.ndarray], v: Vocabulary, ids: np.ndarray, targets: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss over the targets (PAD: none) that follow each slot of full windows, and its gradient."""
    h, x, q, a, total, seen = _attend(p, ids, SPAN)
    flat = lambda z: z.reshape(-1, WIDTH)
    keep = _by_group(targets.reshape(-1))
    want, rows = targets.reshape(-1)[keep], flat(h)[keep]
    n = max(1, len(want))
    logs, z, y, zs, ys, spans = _outcome(p, v, rows, ids.reshape(-1)[keep], want)
    at = np.arange(len(want))
    part = z.dtype.type(1 / n)
    z *= (part / zs)[:, None]
    y *= (part / ys)[:, None]
    z[at, want // MEMBERS] -= part
    y[at, want % MEMBERS] -= part
    d = {"G": rows.T @ z, "C": np.zeros_like(p["C"])}
    dr = z @ p["G"].T
    for g, lo, hi in spans:
        d["C"][g] = rows[lo:hi].T @ y[lo:hi]
        dr[lo:hi] += y[lo:hi] @ p["C"][g].T
    dh = np.zeros((ids.size, WIDTH), h.dtype)
    dh[keep] = dr
    d["V"] = flat(seen).T @ dh
    ds = (dh @ p["V"].T).reshape(h.shape)
    ds /= total
    da = ds @ x.transpose(0, 2, 1)
    da -= _sums(ds * seen)[:, :, None]
    da *= a
    by = da.sum(0)
    d["R"] = np.bincount(_BACK[_BACK >= 0], by[_BACK >= 0], SPAN).astype(h.dtype)
    dq = da @ x
    dx = a.transpose(0, 2, 1) @ ds
    dx += da.transpose(0, 2, 1) @ q
    dx += dh.reshape(h.shape)
    dx += (flat(dq) @ p["A"].T).reshape(h.shape)
    d["A"] = flat(x).T @ flat(dq)
    d["F"] = _sums(flat(dx[:, 1:] * p["E"].take(ids[:, :-1], axis=0)).T)
    dx[:, :-1] += dx[:, 1:] * p["F"]
    order = ids.reshape(-1).astype(np.uint16).argsort(kind="stable")
    seen_ids = ids.reshape(-1)[order]
    new = np.flatnonzero(np.diff(seen_ids, prepend=-1))
    d["E"] = np.zeros_like(p["E"])
    d["E"][seen_ids[new]] = np.add.reduceat(flat(dx).take(order, axis=0), new, axis=0)
    return -float(logs.sum()) / n, d


class Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float = 0.02) -> None:
        self.p, self.rate, self.t = p, rate, 0
        self.m, self.s = ({k: np.zeros_like(w) for k, w in p.items()} for _ in range(2))

    def update(self, grad: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grad.items():
            self.m[k] += np.float32(0.1) * (g - self.m[k])
            self.s[k] += np.float32(0.01) * (g * g - self.s[k])
            size = np.sqrt(self.s[k] * np.float32(1 / (1 - 0.99**self.t))) + np.float32(1e-6)
            self.p[k] -= np.float32(self.rate / (1 - 0.9**self.t)) * self.m[k] / size


def layout(classes: np.ndarray, first: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows over documents of class ids (each ends with its end id): input slots, targets, and each window's document.

    Document i is classes[first[i]:first[i + 1]]; the input at its first target is ``start``. A window's last STRIDE
    slots are inputs whose targets it scores; each target belongs to one window.
    """
    size = np.diff(first)
    windows = -(-size // STRIDE)
    room = CONTEXT + STRIDE * windows
    begin = np.cumsum(room) - room
    slots = np.full(int(room.sum()) + 1, PAD, np.int64)
    wants = np.full(int(room.sum()) + 1, PAD, np.int64)
    doc = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(classes)) - np.repeat(first[:-1], size) + CONTEXT + begin[doc]
    wants[at] = classes
    slots[at[1:]] = classes[:-1]
    slots[(begin + CONTEXT)[size > 0]] = start
    owner = np.repeat(np.arange(len(size)), windows)
    places = begin[owner] + STRIDE * (np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows))
    return slots, wants, np.stack([places, owner])


def log_probabilities(p: dict[str, np.ndarray], v: Vocabulary, slots: np.ndarray, wants: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Natural logs of the class probabilities of the windows' targets, in their order."""
    ids = slots[places[:, None] + np.arange(SPAN)]
    want = wants[places[:, None] + np.arange(CONTEXT, SPAN)].reshape(-1)
    h = _attend(p, ids, STRIDE)[0]
    order = _by_group(want)
    out = np.zeros(len(want))
    out[order] = _outcome(p, v, h.reshape(-1, WIDTH)[order], ids[:, CONTEXT:].reshape(-1)[order], want[order])[0]
    return out[want != PAD]
