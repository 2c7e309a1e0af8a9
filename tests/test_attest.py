import pytest
from pyspark.sql import functions as F

from chunkloom.functions import ed25519
from chunkloom.operators import attest, ingest
from tests.helpers import files

#: Test vectors of RFC 8032, section 7.1 (secret, public, message, signature).
VECTORS = [
    (
        "9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60", "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a", "",
        "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b",
    ),
    (
        "4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb", "3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c", "72",
        "92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00",
    ),
]


@pytest.mark.parametrize("vector", VECTORS)
def test_signatures_of_the_standard(vector):
    secret, public, message, signature = map(bytes.fromhex, vector)
    assert ed25519.public_key(secret) == public and ed25519.sign(secret, message) == signature
    assert ed25519.verify(public, message, signature)
    assert not ed25519.verify(public, message + b"x", signature)
    assert not ed25519.verify(public, message, signature[:32] + bytes(32)) and not ed25519.verify(public, message, b"")


def test_attestations(spark):
    arts, chunks, _ = ingest.raw(files(spark, {"a": b"1" * 100, "b": b"2" * 100}), 64)
    m = ingest.manifests(arts, chunks).cache()
    private, public = attest.key_pair()
    made = attest.attest(m, private, " release ").cache()
    assert [r.key_id for r in made.collect()] == ["release"] * 2
    errors = lambda a, m=m, key=public: {r.error for r in attest.verify(a, m, key).collect()}
    assert errors(made) == {None}
    assert errors(made, key=attest.key_pair()[1]) == {"signature does not verify"}
    assert errors(made, m.withColumn("source_name", F.lit("other"))) == {"digest differs"}
    assert errors(made, m.where("false")) == {"no such manifest"}
    assert errors(made.withColumn("version", F.lit(2))) == {"unsupported version"}
    for bad in ("", "x" * 129):
        with pytest.raises(ValueError):
            attest.attest(m, private, bad)
