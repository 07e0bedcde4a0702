"""Reciprocal rank fusion, boosts and score normalisation over batches of queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import sigmoid


def rrf(channels: dict[str, DataFrame], k: int = 60, limit: int | None = None, digits: int = 9) -> DataFrame:
    """query_id, doc_id, score, rank and rank_<channel>. Each channel has query_id, doc_id, rank (from 1).

    The score adds 1 / (k + rank) over the channels in their order. A document
    that a channel has twice counts with its best rank; one that it hasn't has
    null there. Ties go to what appears first, channel by channel.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    if not channels:
        raise ValueError("no channel")
    names = list(channels)
    rows = reduce(DataFrame.unionByName, (c.select("query_id", "doc_id", F.col("rank").cast("int").alias("r"), F.lit(i).alias("ch")) for i, c in enumerate(channels.values())))
    ranks = [F.min(F.when(F.col("ch") == i, F.col("r"))).alias(f"rank_{n}") for i, n in enumerate(names)]
    fused = rows.groupBy("query_id", "doc_id").agg(*ranks, F.min(F.col("ch") * F.lit(1 << 32) + F.col("r")).alias("first"))  # as one number, so that nothing is sorted for it
    score = reduce(lambda a, b: a + b, (F.coalesce(1 / (k + F.col(f"rank_{n}")), F.lit(0.0)) for n in names))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "first", "doc_id")
    out = fused.withColumn("score", F.round(score, digits)).withColumn("rank", F.row_number().over(w))
    out = out.where(F.col("rank") <= limit) if limit else out
    return out.select("query_id", "doc_id", "score", "rank", *(f"rank_{n}" for n in names))


def pool_sizes(per_channel: int, top_k: int, rerank: bool, boost: bool, boost_pool: int = 100) -> tuple[int, int]:
    """How many hits each channel gives, and how many the fusion keeps."""
    wide = max(per_channel, boost_pool)
    return (wide if boost else per_channel), (wide if boost else per_channel if rerank else top_k)


def boost(hits: DataFrame, factors: DataFrame) -> DataFrame:
    """Hits (query_id, doc_id, work, score, rank) whose work has a factor (query_id, work, factor) get the best score of their query times it, and are ranked anew; equals keep their order."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    joined = hits.join(factors.groupBy("query_id", "work").agg(F.max("factor").alias("factor")), ["query_id", "work"], "left")
    out = joined.withColumn("best", best).withColumn("score", F.when(F.col("factor").isNotNull(), F.greatest(F.col("score") * F.col("factor"), F.col("best") * F.col("factor"))).otherwise(F.col("score")))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "rank")
    return out.withColumn("new_rank", F.row_number().over(w)).drop("best", "factor", "rank").withColumnRenamed("new_rank", "rank")


def normalised(rerank_score: Column, score: Column, best: Column) -> Column:
    """Sigmoid of a rerank score where there is one, else the score over the best of its response, within 0 and 1."""
    return F.when(rerank_score.isNotNull(), sigmoid(rerank_score)).when(best <= 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score / best)))


def rerank(hits: DataFrame, score: Column, top_k: int) -> DataFrame:
    """Hits ordered by another score (any column expression or vectorised UDF), equals in their old order, cut at ``top_k``; none if it isn't positive."""
    w = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank")
    out = hits.withColumn("rerank_score", score).withColumn("new_rank", F.row_number().over(w))
    return out.where(F.col("new_rank") <= max(0, top_k)).withColumnRenamed("rank", "rrf_rank").withColumnRenamed("new_rank", "rank")


def overlap_score(query: Column, text: Column) -> Column:
    """A pair scorer without a model: Jaccard overlap of the words of both."""
    a, b = F.array_distinct(F.split(F.lower(query), r"\W+")), F.array_distinct(F.split(F.lower(text), r"\W+"))
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
