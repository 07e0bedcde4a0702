"""Readers for Parquet tables that lie side by side in one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder``; a file and a folder of part files read alike."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
