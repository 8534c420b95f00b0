"""Column helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = r"[\x20\x09-\x0D]+"                                       # between words of quality, LM, SimHash
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"            # between words of decontamination


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """The given columns of a driver table (all columns when none is named)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` has a fast path for pure ASCII, where both agree."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def split_words(text: Column, separators: str = SPACES) -> Column:
    """Words between runs of separators; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def text_key(text: Column) -> list[Column]:
    """Two 64-bit hashes that together name a text: rows with equal texts share them.

    Results that depend on the text alone are joined back by this key, so repeated
    ids and repeated rows need no row numbers (which a recomputed scan could change).
    """
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(1), t, F.length(t)).alias("k2")]


def id_bucket(doc_id: Column, buckets: int) -> Column:
    """crc32 of the id as text, modulo ``buckets`` (null for a null id)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % buckets
