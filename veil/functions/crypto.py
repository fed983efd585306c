"""Encrypted columns: AES-GCM and AES-CTR. Keys come from the caller; results match, side channels aren't hidden."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IV_BYTES, TAG_BYTES = 12, 16


def _counter(counter: Column | int) -> Column:
    return (F.lit(counter) if isinstance(counter, int) else counter).cast("long")


def nonce(index: Column, counter: Column | int = 0) -> Column:
    """A 12-byte nonce: a row's index in 64 bits, then its write counter in 32; never reuse both under one key.

    Raises an error for a counter that doesn't fit, since a truncated one would repeat another's nonce.
    """
    number = _counter(counter)
    fits = F.when(number.between(0, 2**32 - 1), number).otherwise(F.raise_error(F.lit("write counter outside 32 bits")).cast("long"))
    return F.unhex(F.concat(F.lpad(F.hex(index.cast("long")), 16, "0"), F.lpad(F.hex(fits), 8, "0")))


def _bound(index: Column, counter: Column | int) -> Column:
    return F.concat_ws(":", index.cast("string"), _counter(counter).cast("string"))


def seal(value: Column, key: bytes, index: Column, counter: Column | int = 0) -> Column:
    """Ciphertext bound to the row's index and counter, so a page replayed from another write doesn't open."""
    return F.aes_encrypt(value.cast("binary"), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), nonce(index, counter), _bound(index, counter))


def unseal(value: Column, key: bytes, index: Column, counter: Column | int = 0) -> Column:
    """The plain bytes; null if the ciphertext, index or counter was changed."""
    return F.try_aes_decrypt(value, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), _bound(index, counter))


def seal_random(value: Column, key: bytes) -> Column:
    """Ciphertext with a random nonce of its own, kept before it."""
    return F.aes_encrypt(value.cast("binary"), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"))


def unseal_random(value: Column, key: bytes) -> Column:
    """The plain bytes of seal_random(); null if the ciphertext was changed."""
    return F.try_aes_decrypt(value, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"))


def sealed_equal(a: Column, b: Column, key: bytes) -> Column:
    """Whether two values of seal_random() hold equal plain bytes; null if one doesn't open."""
    return unseal_random(a, key) == unseal_random(b, key)


def ctr(value: Column, key: bytes, iv: Column) -> Column:
    """AES in counter mode with a 12-byte nonce and a block counter that starts at 2; applied twice, the value again.

    No tag, so changes aren't noticed. GCM encrypts in just this mode: its ciphertext is taken without nonce and tag.
    """
    sealed = F.aes_encrypt(value.cast("binary"), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), iv)
    return F.substring(sealed, F.lit(IV_BYTES + 1), F.length(sealed) - (IV_BYTES + TAG_BYTES))


def seal_columns(df: DataFrame, private: Sequence[str], key: bytes, index: str, counter: Column | int = 0, sealed: str = "sealed") -> DataFrame:
    """Records of a public and a private part: the private columns become one sealed column, the others stay."""
    public = [c for c in df.columns if c not in private]
    return df.select(*public, seal(F.to_json(F.struct(*private), {"ignoreNullFields": "false"}), key, F.col(index), counter).alias(sealed))


def unseal_columns(df: DataFrame, schema: str, key: bytes, index: str, counter: Column | int = 0, sealed: str = "sealed") -> DataFrame:
    """The records of seal_columns(), whose private columns have this schema; null ones where it doesn't open."""
    opened = F.from_json(unseal(F.col(sealed), key, F.col(index), counter).cast("string"), schema)
    return df.withColumn("_private", opened).select(*[c for c in df.columns if c != sealed], "_private.*")
