"""Column encryption, key rotation and redacted exports."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanworks.functions import privacy

KEY_BYTES = 32


def _check(keys: dict[int, bytes]) -> None:
    for version, key in keys.items():
        if len(key) != KEY_BYTES:
            raise ValueError(f"key version {version} must have {KEY_BYTES} bytes")


def _key(keys: dict[int, bytes], version: int) -> Column:
    """A key as a scalar subquery over a key table: its bytes are data, so no plan, log or page of the UI shows them."""
    table = SparkSession.active().createDataFrame(pa.table({"version": list(keys), "key": pa.array(list(keys.values()), pa.binary())}))
    return table.where(F.col("version") == version).select("key").scalar()


def _key_for(version: Column, keys: dict[int, bytes]) -> Column:
    chosen = F.lit(None).cast("binary")
    for number in keys:
        chosen = F.when(version == number, _key(keys, number)).otherwise(chosen)
    return chosen


def encrypt(df: DataFrame, column: str, keys: dict[int, bytes], version: int, bind: Column,
            name: str | None = None) -> DataFrame:
    """AES-256-GCM with a fresh random vector per value.

    ``bind`` (say, the row key) is authenticated with the value, so a ciphertext moved
    to another row does not decrypt. Adds ``key_version``.
    """
    _check(keys)
    sealed = F.aes_encrypt(
        F.encode(F.col(column).cast("string"), "UTF-8"), _key(keys, version),
        F.lit("GCM"), F.lit("DEFAULT"), F.lit(bytearray()), F.encode(bind.cast("string"), "UTF-8"),
    )
    return df.withColumn(name or column, sealed).withColumn("key_version", F.lit(version))


def decrypted(column: str, keys: dict[int, bytes], bind: Column, strict: bool = False) -> Column:
    """Plain text by each row's key version. Wrong key or binding: null, or an error if strict."""
    _check(keys)
    open_value = F.aes_decrypt if strict else F.try_aes_decrypt
    plain = open_value(
        F.col(column), _key_for(F.col("key_version"), keys), F.lit("GCM"), F.lit("DEFAULT"),
        F.encode(bind.cast("string"), "UTF-8"),
    )
    return F.decode(plain, "UTF-8")


def rotate(df: DataFrame, column: str, keys: dict[int, bytes], current: int, bind: Column) -> DataFrame:
    """Re-encrypt rows of older key versions; rows already current pass through untouched.

    Adds ``rotated``. A row that does not decrypt fails the job rather than losing its value.
    """
    old = F.col("key_version") < current
    plain = decrypted(column, keys, bind, strict=True)
    sealed = F.aes_encrypt(
        F.encode(plain, "UTF-8"), _key(keys, current), F.lit("GCM"), F.lit("DEFAULT"),
        F.lit(bytearray()), F.encode(bind.cast("string"), "UTF-8"),
    )
    return df.select(
        *[
            F.when(old, sealed).otherwise(F.col(c)).alias(c) if c == column
            else F.when(old, F.lit(current)).otherwise(F.col(c)).alias(c) if c == "key_version"
            else F.col(c)
            for c in df.columns
        ],
        old.alias("rotated"),
    )


def redacted(df: DataFrame, columns: list[str], spans_only: bool = False) -> DataFrame:
    """Copy for export with personal data masked in the named text columns."""
    mask = privacy.redact_spans if spans_only else privacy.mask_value
    return df.withColumns({name: mask(F.col(name)) for name in columns})
