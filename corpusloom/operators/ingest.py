"""Ingest: files to works, expressions, instances and chunks, once per content."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import chunking, sinks
from corpusloom.sources import files


@dataclass
class Loaded:
    """New rows for each table, and how many files were new and were known."""

    works: DataFrame
    expressions: DataFrame
    instances: DataFrame
    chunks: DataFrame
    counts: dict[str, int]


def stable_id(*parts: F.Column | str) -> F.Column:
    """An id made of what it stands for, so that loading again gives the same one."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 32)


def load_segments(spark: SparkSession, root: str, instances: DataFrame, languages: DataFrame, works: DataFrame | None = None, tradition: str = "early", license: str = "unknown", collection: str | None = None, authors: DataFrame | None = None) -> Loaded:
    """Translations of a tree of segment files.

    A file whose bytes an instance has already is skipped. A language the table
    ``languages`` (code) doesn't know, or an author that ``authors`` (slug)
    doesn't, raises before anything is made. Works get the title of the root
    text as their Pali title where the tree has one. Works that
    are there stay as they are. Texts are brought to one form and empty segments
    left out before they are chunked; the sequence of an instance runs through
    parents and their children.
    """
    found = files.segment_files(spark, root, kind="translation", collection=collection).withColumn("language_code", X.language_code(F.col("language")))
    unknown = found.where(F.col("language_code").isNull()).select(F.col("language").alias("code")).unionByName(sinks.unknown_codes(found, "language_code", languages, "code").select(F.col("language_code").alias("code"))).distinct().limit(20).collect()
    if unknown:
        raise ValueError(f"unknown languages: {sorted(r['code'] for r in unknown)}")
    if authors is not None:
        strangers = sinks.unknown_codes(found, "author", authors, "slug").limit(20).collect()
        if strangers:
            raise LookupError(f"unknown authors: {sorted(r['author'] for r in strangers)}")
    fresh = sinks.new_files(found, instances.select("content_hash"))
    roots = files.root_titles(fresh, files.segment_files(spark, root, kind="root", language="pli", author="ms"))
    titled = files.titles(files.segments(fresh))
    rows = fresh.join(titled.drop("uid"), "path").join(roots.drop("uid"), "path").withColumn("work_id", stable_id(F.col("uid"))).withColumn("expression_id", stable_id(F.col("uid"), F.col("author"), F.col("language_code"))).withColumn("instance_id", stable_id(F.col("content_hash")))
    new_works = rows.select(F.col("work_id").alias("id"), F.col("uid").alias("canonical_id"), "title", F.col("root_title").alias("title_pali"), F.lit(tradition).alias("tradition_code"), F.lit("canonical").alias("source_type"), F.to_json(F.struct("collection")).alias("metadata_json"))
    if works is not None:
        new_works = sinks.insert_absent(works.select("canonical_id"), new_works, ["canonical_id"])
    expressions = rows.select(F.col("expression_id").alias("id"), "work_id", F.col("author").alias("author_id"), "language_code", "title", F.lit(license).alias("license")).dropDuplicates(["id"])
    made = rows.select(F.col("instance_id").alias("id"), "expression_id", F.col("path").alias("source_url"), F.lit("json").alias("source_format"), F.current_timestamp().alias("retrieved_at"), "content_hash")
    clean = files.segments(fresh).withColumn("text", X.canonical(F.col("text"))).join(rows.select("path", "instance_id"), "path")
    chunks = chunking.chunk_documents(clean.select(F.col("instance_id").alias("document"), "ord", "segment_id", "text"))
    return Loaded(new_works.dropDuplicates(["canonical_id"]), expressions, made, _identified(chunks), _counts(found, fresh))


def load_talks(spark: SparkSession, root: str, metadata: DataFrame | None, instances: DataFrame, teacher: str, teacher_name: str, tradition: str = "forest", license: str = "unknown") -> Loaded:
    """Transcripts of talks, skipped by the hash of their body; children carry a sentence about where they come from, talks no segment ids."""
    talks = files.transcripts(spark, root, metadata)
    fresh = talks.withColumnRenamed("body_hash", "content_hash")
    fresh = sinks.insert_absent(instances.select("content_hash"), fresh, ["content_hash"])
    rows = fresh.withColumn("canonical_id", F.concat_ws("_", F.lit(teacher), "talk_id")).withColumn("work_id", stable_id(F.col("canonical_id"))).withColumn("expression_id", stable_id(F.col("canonical_id"), F.lit(teacher))).withColumn("instance_id", stable_id(F.col("content_hash")))
    works = rows.select(F.col("work_id").alias("id"), "canonical_id", F.substring("title", 1, 512).alias("title"), F.lit(tradition).alias("tradition_code"), F.lit("talk").alias("source_type"), F.to_json(F.struct("date")).alias("metadata_json")).dropDuplicates(["canonical_id"])
    expressions = rows.select(F.col("expression_id").alias("id"), "work_id", F.lit(teacher).alias("author_id"), F.lit("eng").alias("language_code"), "title", F.lit(license).alias("license"), X.year_of(F.col("date")).alias("publication_year")).dropDuplicates(["id"])
    made = rows.select(F.col("instance_id").alias("id"), "expression_id", F.lit(None).cast("string").alias("source_url"), F.lit("txt").alias("source_format"), F.current_timestamp().alias("retrieved_at"), "content_hash")
    chunks = _identified(chunking.chunk_talks(rows.select(F.col("instance_id").alias("document"), F.col("body").alias("text"))))
    said = rows.select("instance_id", X.talk_context(F.col("title"), F.lit(teacher_name), F.col("date"), F.lit(None).cast("string")).alias("said"))
    chunks = chunks.join(said, "instance_id").withColumn("context_text", F.when(~F.col("is_parent"), F.col("said"))).drop("said")
    return Loaded(works, expressions, made, chunks, _counts(talks, fresh))


def _identified(chunks: DataFrame) -> DataFrame:
    parent = F.when(F.col("parent_sequence").isNotNull(), stable_id(F.col("document"), F.col("parent_sequence").cast("string")))
    return chunks.select(stable_id(F.col("document"), F.col("sequence").cast("string")).alias("id"), F.col("document").alias("instance_id"), parent.alias("parent_chunk_id"), "sequence", "is_parent", "token_count", "segment_id", "segment_ids", "text", X.ascii_fold(F.col("text")).alias("text_ascii_fold"), F.to_json(F.struct("segment_ids", "position")).alias("metadata_json"))


def _counts(all_: DataFrame, fresh: DataFrame) -> dict[str, int]:
    n, m = all_.count(), fresh.count()
    return {"files": n, "loaded": m, "skipped": n - m}


def rechunk(chunks: DataFrame) -> DataFrame:
    """Parents and children for instances that have flat chunks only; instances with a parent are left alone. Flat chunks are the segments, in their sequence."""
    done = chunks.groupBy("instance_id").agg(F.bool_or("is_parent").alias("has")).where("has").select("instance_id")
    flat = chunks.join(done, "instance_id", "left_anti")
    return _identified(chunking.chunk_documents(flat.select(F.col("instance_id").alias("document"), F.col("sequence").alias("ord"), F.coalesce("segment_id", F.col("id")).alias("segment_id"), "text")))
