"""The catalogue of works, expressions, instances and chunks: joins along it, browsing, and whole documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def once(df: DataFrame, *keys: str) -> DataFrame:
    """One row per key; redelivered rows are copies of each other."""
    return df.dropDuplicates(list(keys))


def with_work(chunks: DataFrame, instances: DataFrame, expressions: DataFrame, works: DataFrame) -> DataFrame:
    """Chunks with what their work says. The small ids of the catalogue are joined with each other first, so the large side is shuffled at most once."""
    w = once(works, "id").select(F.col("id").alias("work_id"), F.col("canonical_id").alias("work_canonical_id"), "source_type", "tradition_code", F.col("title").alias("work_title"), "is_restricted")
    e = once(expressions, "id").select(F.col("id").alias("expression_id"), "work_id", "language_code")
    i = once(instances, "id").select(F.col("id").alias("instance_id"), "expression_id")
    return chunks.join(i.join(e, "expression_id").join(w, "work_id"), "instance_id")


def with_parent(chunks: DataFrame, all_chunks: DataFrame) -> DataFrame:
    """Each chunk with its parent's text (null without one)."""
    p = once(all_chunks, "id").select(F.col("id").alias("parent_chunk_id"), F.col("text").alias("parent_text"))
    return chunks.join(p, "parent_chunk_id", "left")


def expanded(df: DataFrame, expand: bool = True) -> DataFrame:
    """Small to big: the parent's text where there is one, the child's kept beside it."""
    big = F.lit(expand) & F.col("parent_text").isNotNull()
    return df.withColumn("child_text", F.when(big, F.col("text"))).withColumn("expanded", big).withColumn("text", F.when(big, F.col("parent_text")).otherwise(F.col("text")))


def latest_instances(instances: DataFrame) -> DataFrame:
    """The instance of each expression that was fetched last."""
    return instances.groupBy("expression_id").agg(F.max_by(F.struct("id", "source_url", "retrieved_at"), F.struct("retrieved_at", "id")).alias("i")).select("expression_id", F.col("i.id").alias("instance_id"), F.col("i.source_url").alias("source_url"), F.col("i.retrieved_at").alias("retrieved_at"))


def best_expressions(expressions: DataFrame) -> DataFrame:
    """The expression of each work to show: English first, then the latest year, unknown years last, then by id."""
    w = Window.partitionBy("work_id").orderBy(F.when(F.col("language_code") == "eng", 0).otherwise(1), F.col("publication_year").desc_nulls_last(), "id")
    return once(expressions, "id").withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def document(works: DataFrame, expressions: DataFrame, instances: DataFrame, chunks: DataFrame, canonical_ids: DataFrame) -> DataFrame:
    """Paragraphs in order of the works asked for (canonical_id): parents of the latest instance of the best expression."""
    w = once(works, "id").join(canonical_ids.distinct(), "canonical_id", "left_semi").select(F.col("id").alias("work_id"), "canonical_id", "title")
    e = best_expressions(expressions).select(F.col("id").alias("expression_id"), "work_id", "language_code", "license")
    i = latest_instances(once(instances, "id"))
    c = once(chunks.where("is_parent"), "id").select("instance_id", "sequence", "segment_id", "text")
    return c.join(w.join(e, "work_id").join(i, "expression_id"), "instance_id").select("canonical_id", "title", "language_code", "license", "sequence", "segment_id", "text")


def by_author(works: DataFrame, expressions: DataFrame, author: str) -> DataFrame:
    """Works that have an expression of the author (a teacher)."""
    return works.join(expressions.where(F.col("author_id") == author).select(F.col("work_id").alias("id")), "id", "left_semi")


def with_author(expressions: DataFrame, authors_: DataFrame) -> DataFrame:
    """Expressions with the slug and name of their author (authors: id, slug, name), null where there is none or it isn't known."""
    a = once(authors_, "id").select(F.col("id").alias("author_id"), F.col("slug").alias("author_slug"), F.col("name").alias("author_name"))
    return expressions.join(a, "author_id", "left")


def cards(hits: DataFrame, chunks: DataFrame, instances: DataFrame, expressions: DataFrame, works: DataFrame, authors_: DataFrame | None = None) -> DataFrame:
    """Hits (query_id, chunk_id, rank) with what a card shows: title, context sentence, language, translator; hits whose chunk isn't in the catalogue are dropped."""
    e = once(expressions, "id")
    e = with_author(e, authors_) if authors_ is not None else e.withColumn("author_name", F.col("author_id"))
    w = once(works, "id").select(F.col("id").alias("work_id"), F.col("canonical_id").alias("work"), F.col("title").alias("work_title"))
    e = e.select(F.col("id").alias("expression_id"), "work_id", "language_code", F.col("author_name").alias("translator"))
    i = once(instances, "id").select(F.col("id").alias("instance_id"), "expression_id")
    c = hits.join(chunks.select(F.col("id").alias("chunk_id"), "instance_id", "context_text"), "chunk_id").dropDuplicates(["query_id", "chunk_id"])
    return c.join(i, "instance_id").join(e, "expression_id").join(w, "work_id").select("query_id", "chunk_id", "rank", "work", "work_title", "context_text", "language_code", "translator")


def page(works: DataFrame, limit: int = 50, offset: int = 0, source_type: str | None = None) -> DataFrame:
    """A page of works: latest date first, unknown dates last, then by canonical id; with the total beside each row."""
    if not (1 <= limit <= 200 and offset >= 0):
        raise ValueError("limit must be within 1 and 200, offset not negative")
    rows = once(works, "id")
    rows = rows.where(F.col("source_type") == source_type) if source_type else rows
    # The page is cut by a distributed top-k; only then the total is put beside its rows.
    total = F.broadcast(rows.agg(F.count("*").alias("total")))
    date = F.nullif(F.get_json_object("metadata_json", "$.date"), F.lit(""))
    shown = rows.select("canonical_id", "title", date.alias("date")).orderBy(F.col("date").desc_nulls_last(), "canonical_id").offset(offset).limit(limit)
    return shown.join(total, F.lit(True)).orderBy(F.col("date").desc_nulls_last(), "canonical_id")


def authors(expressions: DataFrame, works: DataFrame) -> DataFrame:
    """Works per author and tradition, most first."""
    e = once(expressions, "id").where("author_id IS NOT NULL").select("author_id", "work_id")
    w = once(works, "id").select(F.col("id").alias("work_id"), "tradition_code")
    return e.join(w, "work_id").groupBy("author_id", "tradition_code").agg(F.countDistinct("work_id").alias("n_works"))


def without(hits: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    return hits.join(excluded.select(key).distinct(), key, "left_anti")


def starts_with(c: Column, *prefixes: str) -> Column:
    """Whether a text begins with one of the prefixes; without any, every text does."""
    return reduce(lambda a, b: a | b, (c.startswith(p) for p in prefixes)) if prefixes else F.lit(True)


def sample(rows: DataFrame, n: int, key: str, seed: int, without: DataFrame | None = None) -> DataFrame:
    """``n`` rows with the smallest hash of seed and key, the same each time; rows whose key ``without`` has are no candidates. A distributed top-k, no sort of all."""
    rows = rows.join(without.select(key).distinct(), key, "left_anti") if without is not None else rows
    return rows.orderBy(F.md5(F.concat(F.lit(str(seed)), F.col(key))), key).limit(n)


def middle_rows(rows: DataFrame, group: str, *order: str, width: int = 1024) -> DataFrame:
    """The middle row of each group in an order (the first of which is a number): row n // 2 of n, from 0.

    Rows are counted in blocks of the first column; the block that holds the
    middle is found from the running counts of a group's blocks, and only its
    rows are ranked. So no task sorts a whole group, however large it is.
    """
    block = F.floor(F.col(order[0]) / width)
    counts = rows.withColumn("block", block).groupBy(group, "block").agg(F.count("*").alias("n"))
    w = Window.partitionBy(group).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    run = counts.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).withColumn("middle", F.floor(F.sum("n").over(Window.partitionBy(group)) / 2))
    at = run.where((F.col("before") <= F.col("middle")) & (F.col("middle") < F.col("before") + F.col("n"))).select(group, "block", (F.col("middle") - F.col("before") + 1).alias("place"))
    held = rows.withColumn("block", block).join(at, [group, "block"])
    ranked = held.withColumn("r", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return ranked.where(F.col("r") == F.col("place")).drop("r", "place", "block")
