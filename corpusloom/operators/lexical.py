"""Lexical search over a batch of queries: index, query grammar, matching, scores.

The index is written once and read by every batch: postings (term, chunk_id, n,
tf, positions) in folders by a hash of the term, sorted by term, and the
frequencies of the terms. Queries are small and bounded by their number, so
their terms prune the postings before anything is shuffled; from then on the
work is proportional to the postings of the queries' terms, and texts are never
read again.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import normalise_query, simple_terms
from corpusloom.plans.materialize import keep, materialize, shared_folder

#: Rows of queries or their terms that may be broadcast; more are shuffled.
BROADCAST_TERMS = 100_000
#: Folders of postings.
BUCKETS = 32


def _occurrences(chunks: DataFrame) -> DataFrame:
    words = chunks.select("chunk_id", simple_terms(F.col("text")).alias("w"))
    return words.select("chunk_id", F.size("w").alias("n"), F.posexplode("w").alias("pos", "term"))


def frequencies(rows: DataFrame, text: str = "text", key: str = "chunk_id") -> DataFrame:
    """``key``, term, tf of each term of each row, without an index; counts are added up in part before they are shuffled."""
    return rows.select(key, F.explode(simple_terms(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


@dataclass
class Index:
    """A stored index: postings, term frequencies (term, df), number of chunks that have terms, and their mean number of terms."""

    postings: DataFrame
    terms: DataFrame
    docs: int
    mean: float
    buckets: int = BUCKETS

    def of(self, terms: DataFrame) -> DataFrame:
        """Postings of the given terms (a bounded frame with term): only the folders that may have them are listed, and only their rows leave the scan."""
        rows = self.postings
        wanted = terms.select("term").distinct()
        if getattr(terms, "_bounded", False):
            folders = [r[0] for r in wanted.select(_bucket(self.buckets)).distinct().collect()]  # at most as many as there are folders
            if len(folders) < self.buckets:
                rows = rows.where(F.col("bucket").isin(folders))
        return rows.drop("bucket").join(hint(wanted, terms), "term", "left_semi")


_STORED = "term STRING, chunk_id STRING, n INT, tf INT, positions ARRAY<INT>, bucket INT"


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket")


def build_index(chunks: DataFrame, path: str | None = None, buckets: int = BUCKETS) -> Index:
    """The index of chunks (chunk_id, text), written to ``path`` (by default a folder of the session's own in the shared one).

    One shuffle of term occurrences, by folder and a hash of the chunk, so that
    a frequent term is spread over tasks; what it groups is what it writes.
    Chunks that come twice are one: positions are sets, so no pass over texts is
    needed to drop the copies.
    """
    spark = chunks.sparkSession
    at = path or f"{shared_folder(spark)}/corpusloom-index-{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.xxhash64("chunk_id"), F.lit(-(-parts // buckets))).cast("int").alias("salt")
    spread = _occurrences(chunks).select("term", "chunk_id", "n", "pos", _bucket(buckets), salt).repartition("bucket", "salt")
    made = spread.groupBy("bucket", "salt", "term", "chunk_id", "n").agg(F.sort_array(F.collect_set(F.col("pos") + 1)).alias("positions"))
    made = made.select("term", "chunk_id", "n", F.size("positions").alias("tf"), "positions", "bucket").sortWithinPartitions("bucket", "term")
    made.write.mode("overwrite").partitionBy("bucket").parquet(f"{at}/postings")
    if path is None:
        keep(spark, at)
    stored = spark.read.schema(_STORED).parquet(f"{at}/postings")
    stored.groupBy("term").agg(F.count("*").alias("df")).write.mode("overwrite").parquet(f"{at}/terms")
    stored.groupBy("chunk_id").agg(F.max("n").alias("n")).agg(F.count("*").alias("docs"), F.avg("n").alias("mean")).write.mode("overwrite").parquet(f"{at}/stats")
    return open_index(spark, at, buckets)


def open_index(spark: SparkSession, path: str, buckets: int = BUCKETS) -> Index:
    r = spark.read.parquet(f"{path}/stats").head()
    return Index(spark.read.schema(_STORED).parquet(f"{path}/postings"), spark.read.schema("term STRING, df LONG").parquet(f"{path}/terms"), r["docs"] or 0, r["mean"] or 1.0, buckets)


# ---- grammar


def parsed(queries: DataFrame) -> DataFrame:
    """query_id, clause, i, never, words: the phrases of each query (query_id, query).

    A query is folded like the index first. Words are joined by AND, "…" is a
    phrase, ``or`` separates alternatives (clauses) and binds loosest, ``-``
    excludes. Anything can be parsed; a clause without a wanted phrase matches
    nothing.
    """
    items = F.regexp_extract_all(normalise_query(F.col("query")), F.lit(r'(-?"[^"]*"?|\S+)'), F.lit(1))
    each = queries.select("query_id", items.alias("items")).select("query_id", "items", F.posexplode("items").alias("i", "item"))
    clause = F.size(F.filter(F.slice("items", 1, F.col("i") + 1), lambda x: x == "or"))
    rows = each.where("item <> 'or'").select("query_id", clause.alias("clause"), "i", (F.col("item").startswith("-") & (F.length("item") > 1)).alias("never"), simple_terms(F.col("item")).alias("words"))
    return like(rows.where(F.size("words") > 0), queries)


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term: the words that a query's phrases need or exclude, to prune postings."""
    return like(parsed(queries).select("query_id", F.explode("words").alias("term")).distinct(), queries)


def tokens(sparse: DataFrame) -> DataFrame:
    """query_id, term of sparse queries (query_id, token), to prune postings."""
    return like(sparse.select("query_id", F.col("token").alias("term")), sparse)


def like(df: DataFrame, of: DataFrame) -> DataFrame:
    """``df``, marked as bounded if what it is made of is."""
    df._bounded = getattr(of, "_bounded", False)
    return df


def _holds(positions: Column, phrase: Column) -> Column:
    """Whether words stand on end somewhere; ``positions`` of all of them by word. A word that isn't there has none."""
    none = F.array().cast("array<int>")
    of = lambda w: F.coalesce(F.try_element_at(positions, w), none)
    there = lambda at: F.forall(F.transform(phrase, lambda w, i: F.array_contains(of(w), at + i)), lambda x: x)
    return F.exists(of(F.get(phrase, F.lit(0))), there)


def cover_density(positions: Column, terms: Column, weight: float = 0.1) -> Column:
    """Sum over the minimal covers of the terms of weight x terms' share of the cover, after Clarke, Cormack and Tudhope (2000).

    A cover is a shortest stretch that holds all terms; one with n - m extra
    words between its m terms counts weight / (1 + extra). A single term so has
    weight x its frequency. Positions are taken in order; the last place of each
    term is kept, and the first of these is where a cover begins.
    """
    m = F.size(terms)
    events = F.array_sort(F.flatten(F.transform(terms, lambda t, i: F.transform(F.try_element_at(positions, t), lambda p: F.struct(p.alias("p"), i.alias("i"))))))
    state = F.struct(F.array_repeat(F.lit(0), m).alias("last"), F.lit(0).alias("p"), F.lit(0).alias("start"), F.lit(0.0).alias("score"))
    gain = lambda s: F.when(F.array_min(s["last"]) > s["start"], weight / (1 + (s["p"] - F.array_min(s["last"]) + 1 - m))).otherwise(0.0)

    def step(s: Column, e: Column) -> Column:  # what the step before completed is counted here
        return F.struct(F.transform(s["last"], lambda x, i: F.when(i == e["i"], e["p"]).otherwise(x)).alias("last"), e["p"].alias("p"), F.greatest(s["start"], F.array_min(s["last"])).alias("start"), (s["score"] + gain(s)).alias("score"))

    return F.when(m > 0, F.aggregate(events, state, step, lambda s: s["score"] + gain(s))).otherwise(0.0)


@dataclass(frozen=True)
class Bm25:
    k1: float = 1.2
    b: float = 0.75
    stop: frozenset = field(default_factory=frozenset)


def bounded(df: DataFrame, most: int = BROADCAST_TERMS) -> DataFrame:
    """A small frame, such as the queries of a batch, as a local table that joins may broadcast: read once, its rows counted. A larger one comes back as it is, and is shuffled."""
    rows = df.limit(most + 1).toArrow()
    if rows.num_rows > most:
        return df
    out = df.sparkSession.createDataFrame(rows, df.schema)
    out._bounded = True
    return out


def held(df: DataFrame, most: int = BROADCAST_TERMS) -> DataFrame:
    """A frame that several joins read, computed once: written to the shared folder, and from there made a local table if its counted rows are few. (Read up to the bound first, a larger one would be computed twice.)"""
    out = materialize(df)
    return bounded(out, most) if out.count() <= most else out


def hint(df: DataFrame, of: DataFrame) -> DataFrame:
    """A broadcast hint for ``df`` if it is made of a frame that has been counted."""
    return F.broadcast(df) if getattr(of, "_bounded", False) else df


def match(queries: DataFrame, index: Index) -> DataFrame:
    """query_id, chunk_id, score of the chunks that each query matches, by the grammar of ``parsed`` and cover density.

    Alternatives that several queries have are looked up once. Candidates of one
    are the postings of its rarest wanted word; only of those the other words
    are looked up, and a word of the same phrase only where it stands at its
    distance. Phrases are compared for candidates that have all wanted words;
    the score of a chunk is the sum over the alternatives it matches. Blank
    queries match nothing.
    """
    by_kind = lambda never: F.transform(F.array_sort(F.collect_list(F.when(F.col("never") == never, F.struct("i", "words")))), lambda x: x["words"])
    asked = parsed(queries).groupBy("query_id", "clause").agg(by_kind(False).alias("must"), by_kind(True).alias("bad")).where(F.size("must") > 0)
    asked = bounded(asked.withColumn("c", F.md5(F.to_json(F.struct("must", "bad")))))
    specs = bounded(asked.select("c", "must", "bad").dropDuplicates(["c"]))
    words = lambda of: F.explode(F.array_distinct(F.flatten(of)))
    need = specs.select("c", words("must").alias("term"), F.lit(False).alias("never"))
    need = need.union(specs.select("c", words("bad").alias("term"), F.lit(True))).groupBy("c", "term").agg(F.bool_and("never").alias("never"))
    sized = need.join(hint(index.terms.join(hint(need.select("term").distinct(), specs), "term", "left_semi"), specs), "term", "left")
    wanted = sized.where(~F.col("never")).groupBy("c").agg(F.count("*").alias("needed"), F.min_by("term", F.struct("df", "term")).alias("rare"), F.bool_and(F.col("df").isNotNull()).alias("known")).where("known")
    wanted = bounded(wanted.join(specs, "c").select("c", "needed", "rare", F.filter("must", lambda p: F.array_contains(p, F.col("rare")))[0].alias("beside"), (F.size("bad") > 0).alias("picky")))
    distance = F.when(F.array_contains("beside", F.col("term")), F.array_position("beside", F.col("term")) - F.array_position("beside", F.col("rare"))).cast("int")
    other = bounded(need.join(wanted, "c").where("term <> rare").select("c", "term", "never", F.when(~F.col("never"), distance).alias("distance")))
    rows = index.of(like(wanted.select(F.col("rare").alias("term")).union(other.select("term")), wanted))
    candidates = rows.select(F.col("term").alias("rare"), "chunk_id", F.col("positions").alias("at")).join(hint(wanted, wanted), "rare")
    looked_up = candidates.join(hint(other, other), "c").join(rows.select("term", "chunk_id", "positions"), ["chunk_id", "term"])
    looked_up = looked_up.where(F.col("distance").isNull() | F.exists("positions", lambda x: F.array_contains("at", x - F.col("distance"))))
    found = looked_up.groupBy("c", "chunk_id").agg(F.first("needed").alias("needed"), F.first("rare").alias("rare"), F.first("at").alias("at"), F.count_if(~F.col("never")).alias("has"), F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("others"))
    several = found.where((F.col("needed") > 1) & (F.col("has") == F.col("needed") - 1)).select("c", "chunk_id", "rare", "at", "others")
    none = F.create_map().cast("map<string,array<int>>")
    alone = candidates.where("needed = 1 AND NOT picky").select("c", "chunk_id", "rare", "at", none.alias("others"))
    beside = candidates.where("needed = 1 AND picky").join(found.select("c", "chunk_id", "others"), ["c", "chunk_id"], "left").select("c", "chunk_id", "rare", "at", F.coalesce("others", none).alias("others"))
    hits = several.unionByName(alone).unionByName(beside).join(hint(specs, specs), "c")
    hits = hits.withColumn("positions", F.map_concat(F.create_map("rare", "at"), "others"))
    hits = hits.where(F.forall("must", lambda p: (F.size(p) == 1) | _holds(F.col("positions"), p)) & ~F.exists("bad", lambda p: _holds(F.col("positions"), p)))
    scored = hits.select("c", "chunk_id", cover_density(F.col("positions"), F.array_distinct(F.flatten("must"))).alias("score"))
    return scored.join(hint(asked.select("c", "query_id"), asked), "c").groupBy("query_id", "chunk_id").agg(F.sum("score").alias("score"))


def match_all(terms: DataFrame, index: Index) -> DataFrame:
    """Chunks with all terms of a query, and 0.1 x the sum of their frequencies: the form that needs no Python. ``terms``: query_id, term (distinct)."""
    needed = terms.groupBy("query_id").agg(F.count("*").alias("needed"))
    hits = index.of(terms).join(hint(terms, terms), "term").groupBy("query_id", "chunk_id").agg(F.count("*").alias("n"), F.sum("tf").alias("tf"))
    return hits.join(hint(needed, terms), "query_id").where("n = needed").select("query_id", "chunk_id", (F.col("tf") * F.lit(0.1)).alias("score"))


def match_any(terms: DataFrame, index: Index) -> DataFrame:
    return index.of(terms).join(hint(terms, terms), "term").groupBy("query_id", "chunk_id").agg((F.sum("tf") * F.lit(0.1)).alias("score"))


def match_without(hits: DataFrame, unwanted: DataFrame, index: Index) -> DataFrame:
    """Hits (query_id, chunk_id, …) without chunks that have one of the query's unwanted terms (query_id, term)."""
    bad = index.of(unwanted).join(hint(unwanted, unwanted), "term").select("query_id", "chunk_id")
    return hits.join(bad, ["query_id", "chunk_id"], "left_anti")


def bm25(terms: DataFrame, index: Index, options: Bm25 = Bm25()) -> DataFrame:
    """True BM25 (k1, b, inverse document frequency) as a scorer of its own, in one pass over the postings of the terms (query_id, term)."""
    asked = like(terms.join(hint(index.terms.join(hint(terms.select("term").distinct(), terms), "term", "left_semi"), terms), "term"), terms)
    idf = F.log(1 + (F.lit(index.docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (options.k1 + 1) / (F.col("tf") + options.k1 * (1 - options.b + options.b * F.col("n") / index.mean))
    return index.of(terms).join(hint(asked, asked), "term").groupBy("query_id", "chunk_id").agg(F.sum(idf * tf).alias("score"))


def top_k(hits: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """The k best of each query, score descending, ties by chunk id; scores rounded first, so that ties are the same everywhere. Spark keeps k per task before it shuffles."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return hits.withColumn("score", F.round("score", digits)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def children_only(chunks: DataFrame, include_parents: bool = False) -> DataFrame:
    return chunks if include_parents else chunks.where(~F.col("is_parent"))


def in_corpora(chunks: DataFrame, source_types: list[str] | None) -> DataFrame:
    """Rows of the given source types; an empty list means no filter."""
    return chunks.where(F.col("source_type").isin(source_types)) if source_types else chunks


def search(queries: DataFrame, index: Index, limit: int = 10, kept: DataFrame | None = None) -> DataFrame:
    """The whole channel: match and the best ``limit`` of each query; with ``kept`` (chunk_id) only chunks among those, filtered before they are ranked."""
    hits = match(bounded(queries.where(F.trim("query") != "")), index)
    return top_k(hits.join(kept.select("chunk_id"), "chunk_id", "left_semi") if kept is not None else hits, limit)
