"""Synthetic key-value pairs: zero-padded decimal keys and one repeating value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ALPHABET = "abcdefghijklmnopqrstuvwxyz"
KEY_SIZE = 16


def pairs(spark: SparkSession, n: int, value_size: int, key_size: int = KEY_SIZE) -> DataFrame:
    value = (ALPHABET * (value_size // len(ALPHABET) + 1))[:value_size]
    return spark.range(n).select(_key(F.col("id"), key_size).alias("key"), F.lit(value).cast("binary").alias("value"))


def read_keys(spark: SparkSession, n: int, reads: int, seed: int = 1, key_size: int = KEY_SIZE) -> DataFrame:
    """Keys of ``reads`` pseudo-random reads; the same for the same seed."""
    return spark.range(reads).select(_key(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)), key_size).alias("key"))


def _key(column, size: int):
    return F.lpad(column.cast("string"), size, "0").cast("binary")
