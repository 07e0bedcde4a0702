"""Evaluation of retrieval over a golden set, as joins and groupings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def best_ranks(golden: DataFrame, results: DataFrame) -> DataFrame:
    """Each item of ``golden`` (id, expected_works, …) with ``best``: the first rank at which ``results`` (id, rank, work) has an expected work; null if none."""
    expected = golden.select("id", F.explode(F.array_distinct("expected_works")).alias("work"))
    best = results.join(expected, ["id", "work"], "left_semi").groupBy("id").agg(F.min("rank").alias("best"))
    return golden.join(best, "id", "left")


def hit(k: int):
    """1 if an expected work is among the first k, else 0."""
    if k < 1:
        raise ValueError("k must be positive")
    return F.coalesce((F.col("best") <= k).cast("int"), F.lit(0))


def reciprocal_rank():
    return F.coalesce(1 / F.col("best"), F.lit(0.0))


def summary(ranked: DataFrame, ks: tuple[int, ...] = (1, 5, 10, 20), digits: int = 6) -> DataFrame:
    """n, hit rates and mean reciprocal rank overall, by difficulty and by language, in one grouping."""
    measures = [F.count("*").alias("n"), *(F.round(F.avg(hit(k)), digits).alias(f"hit_{k}") for k in ks), F.round(F.avg(reciprocal_rank()), digits).alias("mrr")]
    sets = [[], [F.col("difficulty")], [F.col("language")]]
    return ranked.groupingSets(sets, F.col("difficulty"), F.col("language")).agg(F.grouping_id().alias("grouping"), *measures)


def compare(a: DataFrame, b: DataFrame, k: int = 5) -> DataFrame:
    """id, change: items whose hit at k one run has and the other hasn't. Both: id, best."""
    x = a.select("id", hit(k).alias("a")).join(b.select("id", hit(k).alias("b")), "id")
    return x.where("a <> b").select("id", F.when(F.col("b") == 1, "fixed").otherwise("regressed").alias("change"))


def worst(ranked: DataFrame, n: int) -> DataFrame:
    """The n items with the worst best rank; those never found come first."""
    return ranked.orderBy(F.col("best").isNull().desc(), F.desc("best"), "id").limit(n)


def decision(metric, good: float = 0.50, fair: float = 0.45):
    return F.when(metric >= good, "release").when(metric >= fair, "review").otherwise("hold")


def outcome(ranked: DataFrame) -> DataFrame:
    """n, missed, top_5, top_20: how many items were never found, and how many among the first."""
    return ranked.agg(F.count("*").alias("n"), F.count_if(F.col("best").isNull()).alias("missed"), F.count_if(F.col("best") <= 5).alias("top_5"), F.count_if(F.col("best") <= 20).alias("top_20"))


def smoke(ranked: DataFrame, k: int = 5) -> DataFrame:
    """id, passed: whether an expected work is among the first k."""
    return ranked.select("id", (hit(k) == 1).alias("passed"))


def best_chunks(hits: DataFrame) -> DataFrame:
    """query_id, work, chunk_id, rank, n_chunks: the best chunk of each work among the hits (query_id, work, chunk_id, rank), and how many it has there."""
    return hits.groupBy("query_id", "work").agg(F.min_by("chunk_id", F.struct("rank", "chunk_id")).alias("chunk_id"), F.min("rank").alias("rank"), F.count("*").alias("n_chunks"))


def grid(golden: DataFrame, configurations: list, run) -> DataFrame:
    """Results of ``run(configuration, golden)`` for each of a short list of (name, configuration), united, with the name as ``config``."""
    if not configurations:
        raise ValueError("no configuration")
    return reduce(DataFrame.unionByName, (run(c, golden).withColumn("config", F.lit(name)) for name, c in configurations))


def best_configuration(cells: DataFrame, metric: str, *by: str) -> DataFrame:
    """config and metric of the best cell (of each group); of equals the first by name."""
    return cells.groupBy(*by).agg(F.min_by("config", F.struct(-F.col(metric), "config")).alias("config"), F.max(metric).alias(metric))


def marginal_effects(cells: DataFrame, factor: str, held: list[str], metric: str) -> DataFrame:
    """What switching ``factor`` on adds to ``metric`` with the other factors held."""
    return cells.groupBy(*held).agg((F.max(F.when(F.col(factor), F.col(metric))) - F.max(F.when(~F.col(factor), F.col(metric)))).alias("delta"))
