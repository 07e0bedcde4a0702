"""Contexts for chunks: what is pending, in which order, the requests, their price, and runs that stop at a cap; reports of runs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import sinks


def pending_pairs(chunks: DataFrame, version: str) -> DataFrame:
    """Children without a context of this version, with their parent's text; children without parent are left out."""
    p = chunks.where("is_parent").select(F.col("id").alias("parent_chunk_id"), F.col("text").alias("parent_text")).dropDuplicates(["parent_chunk_id"])
    rows = sinks.pending(chunks, version).select("id", "parent_chunk_id", "sequence", "text").dropDuplicates(["id"])
    return rows.join(p, "parent_chunk_id")


def by_parent(pairs: DataFrame, partitions: int) -> DataFrame:
    """Children of a parent on end in one partition, so that what is cached of it is used again."""
    return pairs.repartition(partitions, "parent_chunk_id").sortWithinPartitions("parent_chunk_id", "sequence")


def messages(instruction: str, parent: Column, child: Column, strict: bool = False) -> Column:
    """The messages of a request: the instruction, then the document and the chunk; null where a text is empty, an error if ``strict``."""
    p, c = X.strip(parent), X.strip(child)
    system = F.struct(F.lit("system").alias("role"), F.lit(instruction.strip()).alias("content"))
    user = F.struct(F.lit("user").alias("role"), F.concat(F.lit("<document>\n"), p, F.lit("\n</document>\n\n<chunk>\n"), c, F.lit("\n</chunk>")).alias("content"))
    return F.when((p != "") & (c != ""), F.array(system, user)).otherwise(F.raise_error(F.lit("empty document or chunk")) if strict else F.lit(None))


def prefixed(chunks: DataFrame, strict: bool = False) -> DataFrame:
    """chunk_id and text to encode of children that have a context: the context, an empty line, the chunk."""
    rows = chunks.where(~F.col("is_parent") & F.col("context_text").isNotNull()).dropDuplicates(["id"])
    return rows.select(F.col("id").alias("chunk_id"), X.prefixed_chunk(F.col("context_text"), F.col("text"), strict).alias("text")).where("text IS NOT NULL")


def usage(calls: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """model, calls, tokens_in, tokens_out, cache_write, cache_read, usd of a table of calls (model, tokens_in, tokens_out, cache_write, cache_read) in one aggregation; what went through the cache isn't paid again as input.

    ``prices``: model, per_million_in, per_million_out; models without a price have the default ones.
    """
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    base = F.greatest(F.lit(0), n("tokens_in") - n("cache_write") - n("cache_read"))
    t = calls.groupBy("model").agg(F.count("*").alias("calls"), F.sum(base).alias("tokens_in"), *(F.sum(n(c)).alias(c) for c in ("tokens_out", "cache_write", "cache_read")))
    if prices is None:
        return t.withColumn("usd", X.cost_usd(F.col("tokens_in"), F.col("tokens_out"), F.col("cache_write"), F.col("cache_read")))
    t = t.join(prices.select("model", "per_million_in", "per_million_out").dropDuplicates(["model"]), "model", "left")
    paid, made = F.coalesce("per_million_in", F.lit(0.80)), F.coalesce("per_million_out", F.lit(4.00))
    return t.withColumn("usd", (F.col("tokens_in") * paid + F.col("tokens_out") * made + F.col("cache_write") * paid * 1.25 + F.col("cache_read") * paid * 0.10) / 1_000_000).drop("per_million_in", "per_million_out")


def projected_cost(pairs: DataFrame, answer_tokens: int = 100) -> DataFrame:
    """calls, cache_write, cache_read, tokens_in, usd: the first child of a parent pays for writing it to the cache, the others for reading it."""
    first = F.row_number().over(Window.partitionBy("parent_chunk_id").orderBy("sequence", "id")) == 1
    t = pairs.select("parent_chunk_id", "sequence", "id", X.quarter_tokens(F.col("parent_text")).alias("p"), X.quarter_tokens(F.col("text")).alias("c")).withColumn("first", first)
    s = t.agg(F.count("*").alias("calls"), F.coalesce(F.sum(F.when(F.col("first"), F.col("p"))), F.lit(0)).alias("cache_write"), F.coalesce(F.sum(F.when(~F.col("first"), F.col("p"))), F.lit(0)).alias("cache_read"), F.coalesce(F.sum("c"), F.lit(0)).alias("tokens_in"))
    return s.withColumn("usd", X.cost_usd(F.col("tokens_in"), F.col("calls") * answer_tokens, F.col("cache_write"), F.col("cache_read")))


@dataclass
class Usage:
    """Tokens and calls of a run so far; what was read from or written to a cache isn't paid again as input."""

    calls: int = 0
    tokens_in: int = 0
    tokens_out: int = 0
    cache_write: int = 0
    cache_read: int = 0

    def add(self, tokens_in: int, tokens_out: int, cache_write: int = 0, cache_read: int = 0) -> None:
        self.calls += 1
        self.tokens_in += max(0, tokens_in - cache_write - cache_read)
        self.tokens_out += tokens_out
        self.cache_write += cache_write
        self.cache_read += cache_read

    def usd(self, per_million_in: float = 0.80, per_million_out: float = 4.00, write_factor: float = 1.25, read_factor: float = 0.10) -> float:
        return (self.tokens_in * per_million_in + self.tokens_out * per_million_out + self.cache_write * per_million_in * write_factor + self.cache_read * per_million_in * read_factor) / 1e6


def run_capped(rows: DataFrame, parts: int, work: Callable[[DataFrame], float], cap: float) -> tuple[int, float]:
    """``work`` on one slice of ``rows`` after another (by a hash of the parent) until its costs reach ``cap``; how many slices ran, and their cost. Within a slice the work is distributed."""
    spent = 0.0
    for k in range(parts):
        if spent >= cap:
            return k, spent
        spent += work(rows.where(F.pmod(F.xxhash64("parent_chunk_id"), F.lit(parts)) == k))
    return parts, spent


def with_context(chunks: DataFrame, contexts: DataFrame, version: str, model: str) -> DataFrame:
    """Chunks with new contexts (id, context_text) put in, their version and model set; other rows unchanged."""
    new = contexts.select("id", F.col("context_text").alias("new_context")).dropDuplicates(["id"])
    joined = chunks.join(new, "id", "left")
    has = F.col("new_context").isNotNull()
    changed = {"context_text": F.coalesce("new_context", "context_text"), "context_version": F.when(has, F.lit(version)).otherwise(F.col("context_version")), "context_model": F.when(has, F.lit(model)).otherwise(F.col("context_model"))}
    return joined.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in chunks.columns))


def markdown(summary: list[dict], columns: list[str]) -> str:
    """A small result as a Markdown table; fractions with three digits, what is missing as a dash."""
    cell = lambda v: "–" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(r.get(c)) for c in columns) + " |" for r in summary]) + "\n"
