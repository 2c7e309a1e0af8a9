import os
import random
import zlib

import pytest
from pyspark.sql import functions as F

from chunkloom.functions import cdc, codec, scalars
from chunkloom.functions.hashing import blake3_hex, blake3_many
from chunkloom.functions.ranges import chunk_tensors, ranges


def lcg(n, state=0x4D564344):
    out = bytearray()
    for _ in range(n):
        state = (state * 6364136223846793005 + 1) & 0xFFFFFFFFFFFFFFFF
        out.append(state >> 56)
    return bytes(out)


#: Chunk lengths of a 512 KiB stream at an average of 16 KiB.
LENGTHS = [
    23787, 14730, 10877, 32811, 12609, 17298, 9310, 20720, 25403, 18616, 23741, 19928, 23804, 15484, 24900, 9339, 10303, 7764, 11990, 8374, 18821,
    10292, 11836, 17495, 27015, 12689, 16589, 50762, 17001,
]


def test_cdc_boundaries_of_a_known_stream():
    made = cdc.chunks(lcg(512 * 1024), 16 * 1024)
    assert [n for _, n in made] == LENGTHS
    assert [o for o, _ in made] == [sum(LENGTHS[:i]) for i in range(len(LENGTHS))]


@pytest.mark.parametrize("data", [b"", b"x", bytes([42]) * (256 * 1024), lcg(5000), lcg(100_000)])
@pytest.mark.parametrize("avg", [1, 256, 16384])
def test_cdc_covers_without_gaps(data, avg):
    at = 0
    least, _, most = cdc.sizes(avg)
    made = cdc.chunks(data, avg)
    for i, (offset, n) in enumerate(made):
        assert offset == at and 0 < n <= most
        assert n >= least or i == len(made) - 1
        at += n
    assert at == len(data)


def test_cdc_agrees_with_a_byte_by_byte_walk():
    def walk(data, avg):
        least, mean, most = cdc.sizes(avg)
        bits = mean.bit_length() - 1
        strict, loose, gear, out, at = cdc.MASKS[bits + 1], cdc.MASKS[bits - 1], [int(x) for x in cdc.gear()], [], 0
        while at < len(data):
            left = min(len(data) - at, most)
            cut = left
            if len(data) - at > least:
                h = 0
                for i in range(least // 2 * 2, left // 2 * 2):
                    h = (2 * h + gear[data[at + i]]) & (2**64 - 1)
                    if h & (strict if i < min(mean, left) // 2 * 2 else loose) == 0:
                        cut = i
                        break
            out.append((at, cut))
            at += cut
        return out

    for seed in range(5):
        data = random.Random(seed).randbytes(6000 + seed)
        assert cdc.chunks(data, 256) == walk(data, 256)


def test_blake3_agrees_with_the_jvm(spark):
    assert blake3_many([b""]) == ["af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"]
    jvm = spark.sparkContext._jvm.org.apache.commons.codec.digest.Blake3
    values = [random.Random(n).randbytes(n) for n in (1, 63, 64, 65, 1023, 1024, 1025, 2048, 3072, 3073, 5000, 16384, 20001)]
    assert blake3_many(values) == [bytes(b & 255 for b in jvm.hash(bytearray(v))).hex() for v in values]
    got = spark.createDataFrame([(bytearray(v),) for v in values[:3]] + [(None,)], "v binary").select(blake3_hex("v")).collect()
    assert [r[0] for r in got] == [*blake3_many(values[:3]), None]


@pytest.mark.parametrize(("n", "size", "want"), [(10, 4, [(0, 4), (4, 4), (8, 2)]), (0, 4, []), (4, 4, [(0, 4)]), (1, 9, [(0, 1)])])
def test_fixed_ranges(spark, n, size, want):
    row = spark.range(1).select(ranges(F.lit(n), size)).first()[0]
    assert [tuple(r) for r in row] == want
    with pytest.raises(ValueError):
        ranges(F.lit(1), 0)


def test_tensor_ranges_stay_inside(spark):
    rows = spark.createDataFrame([("a", "t", 100, bytearray(10)), ("a", "empty", 110, bytearray())], "artifact_id string, name string, start long, payload binary")
    got = [(r.offset, r.size, r.chunk_ix) for r in chunk_tensors(rows, 4).orderBy("offset").collect()]
    assert got == [(100, 4, 0), (104, 4, 1), (108, 2, 2)]


def test_encodings_round_trip_and_are_bounded():
    small, noise = b"A" * 4096, os.urandom(4096)
    assert (len(codec.zstd(small)), len(codec.zstd(small, sized=True))) == (18, 19)
    assert codec.encode_pack(small)[0] == "zstd" and codec.encode_pack(noise) == ("raw", noise)
    for data in (small, noise, b""):
        for mode in ("none", "zstd"):
            assert codec.decode_loose(codec.encode_loose(data, mode)) == data
        assert codec.decode_pack(*codec.encode_pack(data), len(data)) == data
    bomb = codec.LOOSE_MAGIC + (10).to_bytes(8, "little") + codec.zstd(bytes(1 << 20))
    with pytest.raises(ValueError):
        codec.decode_loose(bomb)
    with pytest.raises(ValueError):
        codec.decode_pack("raw", b"abc", 4)


def test_delta_records():
    base = os.urandom(1000)
    target = bytes([base[0] ^ 1]) + base[1:]
    record = codec.encode_delta(target, base, "a" * 64, 1)
    parsed = codec.parse_delta(record)
    assert (parsed["base"], parsed["depth"], parsed["size"], len(record) - len(parsed["payload"])) == ("a" * 64, 1, 1000, codec.DELTA_HEADER)
    assert codec.apply_delta(record, base) == target
    for broken in (record[:50], b"XXXX" + record[4:], record[:68] + b"\0" + record[69:]):
        with pytest.raises(ValueError):
            codec.parse_delta(broken)
    with pytest.raises(ValueError):
        codec.xor(b"a", b"ab")


def test_scalars(spark):
    oid = "ab" * 32
    row = spark.range(1).select(
        scalars.object_path(F.lit(oid)), scalars.delta_path(F.lit(oid)), scalars.canonical_key_id(F.lit(f"pre/objects/ab/{oid[2:]}")), scalars.canonical_key_id(F.lit(f"pre/objects/AB/{oid[2:]}")),
        scalars.little_endian(F.unhex(F.lit("0100000000000080"))).cast("string"), scalars.snapshot_revision(F.lit("/c/snapshots/abc123/model.bin")), scalars.snapshot_revision(F.lit("/c/other/x")),
        scalars.insecure_endpoint(F.lit("http://store.example")), scalars.insecure_endpoint(F.lit("http://127.0.0.1:9000")), scalars.insecure_endpoint(F.lit("https://store.example")),
        scalars.mib_per_second(F.lit(1048576.0), F.lit(500)), scalars.mib_per_second(F.lit(1.0), F.lit(0)), scalars.is_object_id(F.lit("xyz")),
        scalars.provenance(F.lit("org/model"), F.lit("main"), F.lit("/c/snapshots/abc123/model.bin"), F.lit("model.bin"))["source_uri"],
    ).first()
    assert list(row) == [
        f"objects/ab/{oid[2:]}", f"deltas/ab/{oid[2:]}.mvdelta", oid, None, str(2**63 + 1), "abc123", None, True, False, False, 2.0, 0.0, False, "hf://org/model@abc123/model.bin",
    ]
    assert zlib.crc32(b"") == 0
