"""Reading the Parquet tables and the current state of the chunk table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.session import ensure_importable

CHUNK_KEY = ("repo", "branch", "id")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ensure_importable(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def current_seqs(chunks: DataFrame, key: tuple[str, ...] = CHUNK_KEY) -> DataFrame:
    """One column seq: the highest seq of every key, nulls in the key being values.

    Only the key columns and seq are shuffled, never text or vectors. Rows whose
    seq is null are never current.
    """
    return chunks.filter(F.col("seq").isNotNull()).groupBy(*key).agg(F.max("seq").alias("seq")).select("seq")


def current_rows(chunks: DataFrame, wide: DataFrame | None = None, key: tuple[str, ...] = CHUNK_KEY) -> DataFrame:
    """The current rows of chunks, or those of wide (a narrower or filtered view of chunks with seq).

    seq is unique, so filters and projections of wide commute with the semi join.
    """
    wide = chunks if wide is None else wide
    return wide.join(current_seqs(chunks, key), "seq", "left_semi")
