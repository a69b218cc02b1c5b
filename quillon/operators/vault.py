"""The vault: placeholders and originals per document, encrypted at rest with AES-256-GCM."""

from __future__ import annotations

import hashlib
import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS, LEAST_PASSWORD, SALT = 600_000, 16, 16
ENTRIES = "array<struct<placeholder:string,original:string>>"


class VaultError(ValueError):
    """A wrong password or a damaged payload."""


def derived_key(password: str, salt: bytes) -> bytes:
    """PBKDF2-HMAC-SHA256, 600,000 rounds, 32 bytes."""
    if len(password) < LEAST_PASSWORD:
        raise VaultError(f"a password has {LEAST_PASSWORD} characters or more")
    return hashlib.pbkdf2_hmac("sha256", password.encode(), salt, ROUNDS, 32)


def rows(masked: DataFrame) -> DataFrame:
    """doc_id, placeholder, original."""
    return masked.select("doc_id", F.explode_outer("vault").alias("e")).where("e IS NOT NULL").select("doc_id", F.col("e.placeholder").alias("placeholder"), F.col("e.original").alias("original"))


def _key_column(spark: SparkSession, key: bytes):
    """The key as a scalar subquery over a local row, so no plan text shows it."""
    return spark.createDataFrame([(bytearray(key),)], "key binary").select("key").scalar()


def _keys(salts: DataFrame, password: str) -> DataFrame:
    """salt, key: one derivation for each distinct salt, on the workers."""
    if len(password) < LEAST_PASSWORD:
        raise VaultError(f"a password has {LEAST_PASSWORD} characters or more")

    def run(batches):
        for b in batches:
            found = [derived_key(password, s) for s in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], names=["salt", "key"])

    # a derivation takes about half a second, so salts are spread over tasks
    return salts.where("salt IS NOT NULL").repartition("salt").mapInArrow(run, "salt binary, key binary")


def encrypt(masked: DataFrame, password: str) -> DataFrame:
    """doc_id, version, salt, payload: one payload per document, a fresh salt per call and a fresh nonce per row."""
    salt = os.urandom(SALT)
    key = _key_column(masked.sparkSession, derived_key(password, salt))
    return masked.select(
        "doc_id", F.lit(1).alias("version"), F.lit(bytearray(salt)).alias("salt"), F.aes_encrypt(F.to_json("vault").cast("binary"), key, F.lit("GCM"), F.lit("DEFAULT")).alias("payload")
    )


def decrypt(stored: DataFrame, password: str) -> DataFrame:
    """doc_id and vault. Raises where a payload does not open; any number of salts is joined to their keys."""
    keys = _keys(stored.select("salt").distinct(), password)
    opening = F.try_aes_decrypt("payload", "key", F.lit("GCM"), F.lit("DEFAULT")).cast("string")
    out = stored.join(keys, "salt", "left").select("doc_id", opening.alias("plain"))
    opened = F.when(F.col("plain").isNull(), F.raise_error(F.lit("wrong password or damaged vault"))).otherwise(F.col("plain"))
    return out.select("doc_id", F.from_json(opened, ENTRIES).alias("vault"))


def original_of(vault, placeholder):
    """The original a placeholder stands for, or null."""
    return F.get(F.filter(vault, lambda e: e["placeholder"] == placeholder), F.lit(0))["original"]


def placeholder_of(vault, original):
    return F.get(F.filter(vault, lambda e: e["original"] == original), F.lit(0))["placeholder"]
