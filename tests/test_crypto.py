"""Encrypted columns against the published vectors of GCM with 256-bit keys, and what must not open."""

import pytest
from pyspark.sql import functions as F

from veil.functions import crypto

#: A key, nonce, plain text and ciphertext of the mode's specification.
KEY = bytes.fromhex("feffe9928665731c6d6a8f9467308308feffe9928665731c6d6a8f9467308308")
NONCE = "cafebabefacedbaddecaf888"
PLAIN = "d9313225f88406e5a55909c5aff5269a86a7a9531534f7da2e4c303d8a318a721c3c0c95956809532fcf0e2449a6b525b16aedf5aa0de657ba637b39"
CIPHER = "522dc1f099567d07f47f37a32a84427d643a8cdcbfe5c0c97598a2bd2555d1aa8cb08e48590dbb3da7b08b1056828838c5f61e6393ba7a0abcc9f662"
ZERO_CIPHER = "cea7403d4d606b6e074ec5d3baf39d18"


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_known_answers(spark):
    index, counter = int(NONCE[:16], 16) - 2**64, int(NONCE[16:], 16)
    at = crypto.nonce(F.lit(index), counter)
    plain = F.unhex(F.lit(PLAIN))
    row = one(spark, F.hex(at).alias("n"), F.hex(crypto.ctr(plain, KEY, at)).alias("c"), F.hex(crypto.seal(plain, KEY, F.lit(index), counter)).alias("s"), F.hex(crypto.ctr(F.unhex(F.lit("00" * 16)), bytes(32), F.unhex(F.lit("00" * 12)))).alias("z"))
    assert row.n.lower() == NONCE and row.c.lower() == CIPHER and row.z.lower() == ZERO_CIPHER
    assert row.s.lower()[: len(NONCE + CIPHER)] == NONCE + CIPHER and len(row.s) == len(NONCE + CIPHER) + 32


def test_nonces_never_repeat(spark):
    cases = [(i, c) for i in (0, 1, -1, 2**40, 2**63 - 1) for c in (0, 1, 2**28, 2**31, 2**32 - 1)]
    rows = spark.createDataFrame(cases, "i long, c long").select(F.hex(crypto.nonce(F.col("i"), F.col("c"))).alias("n")).collect()
    assert len({r.n for r in rows}) == len(cases) and {len(r.n) for r in rows} == {24}
    for counter in (2**32, -1):
        with pytest.raises(Exception, match="write counter"):
            one(spark, crypto.seal(F.lit("x"), KEY, F.lit(1), counter))


def test_what_must_not_open(spark):
    sealed = crypto.seal(F.lit("value"), KEY, F.lit(7), 3)
    flipped = F.concat(F.substring(sealed, 1, 15), F.unhex(F.lit("00")), F.substring(sealed, 17, 100))
    row = one(
        spark, crypto.unseal(sealed, KEY, F.lit(7), 3).cast("string").alias("ok"), crypto.unseal(sealed, KEY, F.lit(7), 2).alias("replayed"), crypto.unseal(sealed, KEY, F.lit(8), 3).alias("moved"),
        crypto.unseal(flipped, KEY, F.lit(7), 3).alias("flipped"), crypto.unseal(sealed, bytes(32), F.lit(7), 3).alias("key"), crypto.seal(F.lit(None).cast("string"), KEY, F.lit(7)).alias("null"),
    )
    assert row.ok == "value" and row.replayed is row.moved is row.flipped is row.key is row.null is None


def test_random_nonces_and_equality(spark):
    a, b = crypto.seal_random(F.lit("x"), KEY), crypto.seal_random(F.lit("x"), KEY)
    row = one(spark, a.alias("a"), b.alias("b"), crypto.sealed_equal(a, b, KEY).alias("same"), crypto.sealed_equal(a, crypto.seal_random(F.lit("y"), KEY), KEY).alias("other"))
    assert row.a != row.b and row.same is True and row.other is False


def test_records_with_a_sealed_part(spark):
    df = spark.createDataFrame([(1, "a", None, 2.5), (2, None, 7, None)], "id long, name string, n int, x double")
    sealed = crypto.seal_columns(df, ["name", "n"], KEY, "id", 9)
    assert sealed.columns == ["id", "x", "sealed"] and sealed.filter(F.contains(F.col("sealed"), F.encode(F.lit("name"), "utf-8"))).count() == 0
    assert sorted(tuple(r) for r in crypto.unseal_columns(sealed, "name string, n int", KEY, "id", 9).collect()) == [(1, 2.5, "a", None), (2, None, None, 7)]
    assert {(r.name, r.n) for r in crypto.unseal_columns(sealed, "name string, n int", KEY, "id", 8).collect()} == {(None, None)}
