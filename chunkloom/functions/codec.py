"""Physical encodings of objects: zstd with a choice of the smaller form, XOR deltas, and the two envelopes."""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import functions as F

#: Fixed values of the formats: envelope marks and the length of a delta's header.
LOOSE_MAGIC, DELTA_MAGIC = b"MVZ1", b"MVD1"
DELTA_HEADER = 4 + 64 + 1 + 8
#: What the policy simulation adds to a delta's size.
SIMULATED_HEADER = 64
LEVEL = 3


@lru_cache(maxsize=32)
def _compressor(level: int, sized: bool) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=level, write_content_size=sized)


def zstd(data: bytes, level: int = LEVEL, sized: bool = False) -> bytes:
    """A zstd frame; ``sized`` frames carry their content size (bulk form), the others do not (stream form)."""
    return _compressor(level, sized).compress(data)


def unzstd(data: bytes, expected: int) -> bytes:
    """The content, which must have exactly the expected length; never more than one byte beyond it is decoded."""
    with zstandard.ZstdDecompressor().stream_reader(data) as r:
        out = r.read(expected + 1)
    if len(out) != expected:
        raise ValueError(f"decoded length differs from {expected}")
    return out


def xor(a: bytes, b: bytes) -> bytes:
    if len(a) != len(b):
        raise ValueError("base and target sizes differ")
    return np.bitwise_xor(np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)).tobytes()


def encode_loose(data: bytes, compression: str, level: int = LEVEL) -> bytes:
    return data if compression == "none" else LOOSE_MAGIC + struct.pack("<Q", len(data)) + zstd(data, level)


def decode_loose(stored: bytes) -> bytes:
    if stored[:4] != LOOSE_MAGIC:
        return stored
    if len(stored) < 12:
        raise ValueError("truncated envelope")
    return unzstd(stored[12:], struct.unpack("<Q", stored[4:12])[0])


def encode_pack(data: bytes, level: int = LEVEL) -> tuple[str, bytes]:
    """The encoding's name and the payload: zstd only where it is smaller."""
    packed = zstd(data, level)
    return ("zstd", packed) if len(packed) < len(data) else ("raw", data)


def decode_pack(encoding: str, payload: bytes, size: int) -> bytes:
    if encoding == "zstd":
        return unzstd(payload, size)
    if len(payload) != size:
        raise ValueError("raw payload of another size")
    return payload


def encode_delta(target: bytes, base: bytes, base_id: str, depth: int, level: int = LEVEL) -> bytes:
    return DELTA_MAGIC + base_id.encode("ascii") + bytes([depth]) + struct.pack("<Q", len(target)) + zstd(xor(base, target), level)


def parse_delta(record: bytes) -> dict:
    """base, depth, size and payload of a delta record; raises on a malformed one."""
    if len(record) < DELTA_HEADER or record[:4] != DELTA_MAGIC:
        raise ValueError("not a delta record")
    base, depth = record[4:68].decode("ascii").lower(), record[68]
    if any(c not in "0123456789abcdef" for c in base) or depth == 0:
        raise ValueError("malformed delta header")
    return {"base": base, "depth": depth, "size": struct.unpack("<Q", record[69:77])[0], "payload": record[77:]}


def apply_delta(record: bytes, base: bytes) -> bytes:
    parsed = parse_delta(record)
    return xor(base, unzstd(parsed["payload"], parsed["size"]))


def zstd_size(level: int = LEVEL, sized: bool = True):
    """A UDF: the length of the zstd frame of a binary value."""

    @F.pandas_udf("long")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else len(zstd(v, level, sized))).astype("Int64")

    return run


def xor_size(level: int = LEVEL, sized: bool = True):
    """A UDF: the length of the zstd frame of the XOR of two binary values; null where lengths differ."""

    @F.pandas_udf("long")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        both = [None if x is None or y is None or len(x) != len(y) else len(zstd(xor(x, y), level, sized)) for x, y in zip(a, b, strict=True)]
        return pd.Series(both, dtype="Int64")

    return run
