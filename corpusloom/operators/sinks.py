"""Idempotent writes on plain tables: insert-if-absent, latest per key, quarantine of what fails."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """The last row of each key by ``version``; ties by the other columns, so that it is the same each time. One partial aggregation, no sort."""
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(*version, *(c for c in rest if c not in version))
    got = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r"))
    return got.select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest)).select(*df.columns)


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """Both tables as one, of each key the latest row."""
    return latest(existing.unionByName(new), keys, version)


def insert_absent(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key ``existing`` hasn't; a row that is there is never changed, and a key new twice comes once."""
    return new.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def new_files(files: DataFrame, loaded: DataFrame) -> DataFrame:
    """Files (content) whose bytes were not loaded before, by their hash, with the hash beside them."""
    hashed = files.withColumn("content_hash", F.sha2("content", 256))
    return insert_absent(loaded, hashed, ["content_hash"])


def unknown_codes(rows: DataFrame, column: str, known: DataFrame, key: str) -> DataFrame:
    """Values of a column that a small table doesn't know, with their number: a load stops if there are any."""
    return rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).join(known.select(F.col(key).alias(column)), column, "left_anti")


def changed_texts(chunks: DataFrame, canonical: Callable, fold: Callable) -> DataFrame:
    """Rows that cleaning would change, with their new texts."""
    target = chunks.withColumn("new_text", canonical(F.col("text"))).withColumn("new_fold", fold(F.col("new_text")))
    return target.where((F.col("text") != F.col("new_text")) | ~F.col("text_ascii_fold").eqNullSafe(F.col("new_fold")))


def pending(chunks: DataFrame, version: str) -> DataFrame:
    """Children whose context is missing or of another version."""
    return chunks.where(~F.col("is_parent") & ~F.col("context_version").eqNullSafe(F.lit(version)))


def save_collection(df: DataFrame, name: str, recreate: bool = False) -> bool:
    """A collection as a table of the catalogue: created if absent, replaced if asked for; whether it was written."""
    spark: SparkSession = df.sparkSession
    if spark.catalog.tableExists(name) and not recreate:
        return False
    df.write.mode("overwrite").saveAsTable(name)
    return True


def each_batch(df: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str, continue_on_error: bool = True) -> DataFrame:
    """``work`` on each batch; a batch that fails becomes rows with the error beside them instead of ending the job. The schema gains ``error STRING``."""
    names = [f.split()[0] for f in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            try:
                yield work(f).assign(error=None)
            except Exception as e:
                if not continue_on_error:
                    raise
                yield f.reindex(columns=names).assign(error=f"{type(e).__name__}: {e}"[:300])

    return df.mapInPandas(run, f"{schema}, error STRING")
