"""Dense and sparse search over a batch of queries, and encoders.

Dense search is exact and runs in blocks: rows of the corpus meet a block of
queries in matrix products of bounded size, and only the best k of a task leave
it. Blocks of queries are of bounded size, so what is sent to the tasks is too,
however many queries there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.operators import sweep

#: Queries that are sent to the corpus at once; more take another pass over the corpus, and so on.
QUERY_BLOCK = 8192


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where one of the vectors has no length."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def dense_top_k(queries: DataFrame, corpus: DataFrame, k: int, digits: int = 6, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, doc_id, score, rank: the k nearest by cosine, ties by id. ``queries``: query_id, vector; ``corpus``: doc_id, vector.

    Queries are divided by a hash of their id into blocks of about ``block``;
    each block is sent to the corpus, and the driver holds one of them at a
    time. Documents come to a task in the order of their ids. Vectors that are
    null or empty find nothing and are not found.
    """
    spark = corpus.sparkSession
    there = "vector IS NOT NULL AND size(vector) > 0"
    asked, stored = queries.where(there).select("query_id", "vector"), corpus.where(there).select("doc_id", "vector")
    schema = T.StructType([queries.schema["query_id"], corpus.schema["doc_id"], T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType())])
    left = T.StructType([T.StructField("no", schema["query_id"].dataType), T.StructField("id", T.ArrayType(schema["doc_id"].dataType)), T.StructField("score", T.ArrayType(T.DoubleType()))])
    n = max(1, -(-asked.count() // block))
    parts = []
    for i in range(n):
        table = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i).toArrow().combine_chunks()
        if not table.num_rows:
            continue
        sent = spark.sparkContext.broadcast((table.column("query_id").combine_chunks(), _unit(_matrix(table.column("vector").combine_chunks()))))

        def nearest(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, of_query = sent.value
            best, names, seen, step = sweep.Best(len(ids), k, digits, least=-np.inf), [], 0, max(16, sweep.CELLS // len(ids))
            for b in batches:
                of_row = _unit(_matrix(b.column(1)))
                for first in range(0, len(b), step):
                    best.add(seen + first, of_query @ of_row[first : first + step].T)
                names.append(b.column(0))
                seen += len(b)
            best.prune()
            best.s = np.round(best.s, digits) + 0.0
            yield from best.batches(ids, names)

        hits = sweep.gathered(stored).sortWithinPartitions("doc_id").mapInArrow(nearest, left)
        parts.append(sweep.ranked(hits.withColumnRenamed("no", "query_id"), "doc_id", k, digits))
    if not parts:
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, parts)


def sparse_top_k(queries: DataFrame, corpus: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """query_id, doc_id, score, rank by the dot product over shared tokens; both sides as (id, token, weight). Without a shared token there is no hit."""
    hits = corpus.join(queries, "token").groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("q_weight") * F.col("weight")), digits).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hashing_encoder(dim: int = 64) -> Callable[[str], list[float]]:
    """A deterministic encoder without a model: words hashed into a vector of unit length. Any callable of the same form can take its place."""
    import zlib

    def encode(text: str) -> list[float]:
        v = np.zeros(dim)
        for w in text.lower().split():
            h = zlib.crc32(w.encode())
            v[h % dim] += 1.0 if h & 0x10000 else -1.0
        n = np.sqrt((v * v).sum())
        return (v / n if n else v).tolist()

    return encode


def encode(df: DataFrame, text: str, into: str, encoder: Callable, batched: bool = False) -> DataFrame:
    """``df`` with a vector of ``text``; null texts have none. A ``batched`` encoder takes a list of texts; one that gives another number of vectors raises."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            if not batched:
                yield s.map(encoder, na_action="ignore")
                continue
            there = s.dropna()
            got = list(encoder(there.tolist())) if len(there) else []
            if len(got) != len(there):
                raise RuntimeError(f"{len(there)} texts, {len(got)} vectors")
            found = dict(zip(there.index, got))
            yield pd.Series([found.get(i) for i in s.index], index=s.index, dtype=object)

    return df.withColumn(into, run(F.col(text)))


def hashed(frequencies: DataFrame, key: str, into: str = "vector", dim: int = 64) -> DataFrame:
    """``key`` and a vector of each text from its terms (key, term, tf): every term adds its frequency, with a sign, at a place; both come from its MD5. No model, and nothing leaves the JVM."""
    h = F.md5(F.col("term"))
    place = F.pmod(F.conv(F.substring(h, 1, 4), 16, 10).cast("int"), F.lit(dim))
    sign = F.when(F.substring(h, 5, 1) < "8", 1).otherwise(-1)
    sums = frequencies.groupBy(key, place.alias("at")).agg(F.sum(sign * F.col("tf")).cast("double").alias("w"))
    made = sums.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("at", "w"))).alias("m"))
    return made.select(key, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0))).alias(into))


def points(chunks: DataFrame, dense: str, sparse: str | None = None, dim: int | None = None) -> DataFrame:
    """Index rows of chunks: vectors and payload in one table, keyed by chunk. A dense vector of another length than ``dim`` raises."""
    vector_ = F.col(dense)
    if dim is not None:
        vector_ = F.when(vector_.isNull() | (F.size(vector_) == dim), vector_).otherwise(F.raise_error(F.concat(F.lit(f"not {dim} numbers in the vector of "), "chunk_id")))
    cols = ["chunk_id", vector_.alias("dense"), *([F.transform_keys(F.col(sparse), lambda k, v: k.cast("int")).alias("sparse")] if sparse else [])]
    payload = [c for c in ("parent_chunk_id", "instance_id", "work_canonical_id", "segment_id", "sequence", "is_parent", "token_count", "source_type", "pericope_id") if c in chunks.columns]
    return chunks.select(*cols, *payload)
