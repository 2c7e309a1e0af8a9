"""Signed statements about manifests: a digest of the manifest's compact JSON, signed with Ed25519."""

from __future__ import annotations

import base64
import os

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkloom.functions import ed25519
from chunkloom.functions.hashing import blake3_hex

VERSION, ALGORITHM, MAX_KEY_ID = 1, "ed25519", 128
_FIELDS = ("version", "artifact_id", "format", "source_name", "logical_size", "chunk_size", "provenance", "lineage", "chunks", "tensors")


def key_pair() -> tuple[str, str]:
    """A new private and public key in base64."""
    secret = os.urandom(32)
    return base64.b64encode(secret).decode(), base64.b64encode(ed25519.public_key(secret)).decode()


def _key(text: str) -> bytes:
    raw = base64.b64decode(text.strip(), validate=True)
    if len(raw) != 32:
        raise ValueError("a key is 32 bytes in base64")
    return raw


def digests(manifests: DataFrame) -> DataFrame:
    """``manifests`` with manifest_blake3, the BLAKE3 of their compact JSON (fields in order; nulls and empty lists left out)."""
    some = lambda c: F.when(F.size(c) > 0, F.col(c)) if c in ("lineage", "tensors") else F.col(c)
    return manifests.withColumn("manifest_blake3", blake3_hex(F.encode(F.to_json(F.struct(*(some(c).alias(c) for c in _FIELDS))), "UTF-8")))


def attest(manifests: DataFrame, private_key: str, key_id: str) -> DataFrame:
    """One attestation per manifest."""
    if not key_id.strip() or len(key_id.encode()) > MAX_KEY_ID:
        raise ValueError(f"a key id has 1 to {MAX_KEY_ID} bytes")
    secret = _key(private_key)

    @F.pandas_udf(T.StringType())
    def signed(values: pd.Series) -> pd.Series:
        return values.map(lambda v: base64.b64encode(ed25519.sign(secret, v.encode())).decode())

    rows = digests(manifests)
    return rows.select(F.lit(VERSION).alias("version"), F.lit(ALGORITHM).alias("algorithm"), F.lit(key_id.strip()).alias("key_id"), "artifact_id", "manifest_blake3", signed("manifest_blake3").alias("signature"))


def verify(attestations: DataFrame, manifests: DataFrame, public_key: str) -> DataFrame:
    """artifact_id, error (null: the statement holds) of every attestation."""
    public = _key(public_key)

    @F.pandas_udf(T.BooleanType())
    def holds(digest: pd.Series, signature: pd.Series) -> pd.Series:
        def one(d: str, s: str) -> bool:
            try:
                return ed25519.verify(public, d.encode(), base64.b64decode(s, validate=True))
            except ValueError:
                return False

        return pd.Series([one(d, s) for d, s in zip(digest, signature, strict=True)])

    known = digests(manifests).select(F.lower("artifact_id").alias("_id"), F.col("manifest_blake3").alias("_digest"))
    rows = attestations.join(known, F.lower("artifact_id") == F.col("_id"), "left")
    error = (
        F.when(F.col("version") != VERSION, "unsupported version").when(F.col("algorithm") != ALGORITHM, "unsupported algorithm").when(F.col("_id").isNull(), "no such manifest")
        .when(F.col("manifest_blake3") != F.col("_digest"), "digest differs").when(~holds("manifest_blake3", "signature"), "signature does not verify")
    )
    return rows.select("artifact_id", error.alias("error"))
