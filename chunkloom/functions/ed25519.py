"""Ed25519 signatures after RFC 8032, on Python's integers: slow, and meant for one signature per manifest.

Not constant-time; keep private keys where timing cannot be observed.
"""

from __future__ import annotations

import hashlib

#: Fixed values of the curve: the field's prime, the group's order, the curve's constant.
P = 2**255 - 19
ORDER = 2**252 + 27742317777372353535851937790883648493
D = -121665 * pow(121666, -1, P) % P

Point = tuple[int, int, int, int]  # X, Y, Z, T with x = X / Z, y = Y / Z, x y = T / Z
ZERO: Point = (0, 1, 1, 0)


def _add(a: Point, b: Point) -> Point:
    s, t = (a[1] - a[0]) * (b[1] - b[0]) % P, (a[1] + a[0]) * (b[1] + b[0]) % P
    u, v = 2 * D * a[3] * b[3] % P, 2 * a[2] * b[2] % P
    e, f, g, h = t - s, v - u, v + u, t + s
    return e * f % P, g * h % P, f * g % P, e * h % P


def _times(k: int, a: Point) -> Point:
    out = ZERO
    while k:
        if k & 1:
            out = _add(out, a)
        a = _add(a, a)
        k >>= 1
    return out


def _same(a: Point, b: Point) -> bool:
    return (a[0] * b[2] - b[0] * a[2]) % P == 0 and (a[1] * b[2] - b[1] * a[2]) % P == 0


def _x(y: int, odd: int) -> int | None:
    """The x of a point of the curve with this y, or None."""
    if y >= P:
        return None
    square = (y * y - 1) * pow(D * y * y + 1, -1, P) % P
    x = pow(square, (P + 3) // 8, P)
    if (x * x - square) % P:
        x = x * pow(2, (P - 1) // 4, P) % P
    if (x * x - square) % P or (x == 0 and odd):
        return None
    return P - x if x & 1 != odd else x


_Y = 4 * pow(5, -1, P) % P
BASE: Point = (_x(_Y, 0), _Y, 1, _x(_Y, 0) * _Y % P)


def _pack(a: Point) -> bytes:
    z = pow(a[2], -1, P)
    return (a[1] * z % P | (a[0] * z % P & 1) << 255).to_bytes(32, "little")


def _unpack(raw: bytes) -> Point | None:
    n = int.from_bytes(raw, "little")
    y = n & (1 << 255) - 1
    x = _x(y, n >> 255)
    return None if x is None else (x, y, 1, x * y % P)


def _number(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little") % ORDER


def _expand(secret: bytes) -> tuple[int, bytes]:
    if len(secret) != 32:
        raise ValueError("a private key has 32 bytes")
    raw = hashlib.sha512(secret).digest()
    n = int.from_bytes(raw[:32], "little")
    return n & (1 << 254) - 8 | 1 << 254, raw[32:]


def public_key(secret: bytes) -> bytes:
    return _pack(_times(_expand(secret)[0], BASE))


def sign(secret: bytes, message: bytes) -> bytes:
    a, prefix = _expand(secret)
    r = _number(prefix, message)
    head = _pack(_times(r, BASE))
    k = _number(head, _pack(_times(a, BASE)), message)
    return head + ((r + k * a) % ORDER).to_bytes(32, "little")


def verify(public: bytes, message: bytes, signature: bytes) -> bool:
    if len(public) != 32 or len(signature) != 64:
        return False
    a, r, s = _unpack(public), _unpack(signature[:32]), int.from_bytes(signature[32:], "little")
    if a is None or r is None or s >= ORDER:
        return False
    return _same(_times(s, BASE), _add(r, _times(_number(signature[:32], public, message), a)))
