"""Problem 6: token budget per source type, language and domain.

Method: a regression per language predicts the tokens of a text from its bytes,
words, digits, punctuation and script counts. It is fitted on a bounded sample
of texts that are tokenised, applied to every text, and its bias is corrected
per language by the ratio of true to predicted tokens on held-out texts of the
sample.

No text counts twice: parents repeat their children and count only where an
instance has no child at all; redelivered rows and texts fetched again for the
same expression count once. Languages come from the expression's code in any
notation, else from the work's.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.language import label_column
from corpusloom.llm.splitting import _buffers
from corpusloom.llm.tokenizing import VOCABULARY, count_tokens
from corpusloom.plans.materialize import materialize

FEATURES = ("bytes", "words", "digits", "punctuation", "latin", "latin_marked", "cyrillic", "cjk", "other_letters", "blanks")
#: Texts per language that are tokenised to fit and to correct, those with the smallest hash; every second one is held out.
SAMPLE = 400


@cache
def _kinds() -> np.ndarray:
    """Class of each code point: 0 other sign, 1 digit, 2 punctuation, 3 plain Latin, 4 marked Latin, 5 Cyrillic, 6 CJK, 7 other letter, 8 blank."""
    t = np.zeros(0x110000, np.uint8)
    for cp in range(0x10000):
        ch = chr(cp)
        if ch.isspace():
            t[cp] = 8
        elif ch.isdigit():
            t[cp] = 1
        elif ch.isascii() and ch.isalpha():
            t[cp] = 3
        elif ch.isalpha():
            t[cp] = 4 if cp < 0x250 or 0x1E00 <= cp < 0x1F00 else 5 if 0x400 <= cp < 0x530 else 6 if 0x3040 <= cp < 0xA000 else 7
        elif ch.isprintable():
            t[cp] = 2
    t[0x20000:0x32000] = 6
    return t


def text_features(column: pa.Array, at_once: int = 1 << 22) -> np.ndarray:
    """FEATURES of each text as one matrix; null and empty texts have zeros. Vectorised over runs of texts."""
    raw, edges = _buffers(column)
    out = np.zeros((len(column), len(FEATURES)), np.int64)
    out[:, 0] = np.diff(edges)
    cuts = [0]
    for i in range(len(column)):
        if edges[i + 1] - edges[cuts[-1]] > at_once or i == len(column) - 1:
            cuts.append(i + 1)
    for a, z in zip(cuts, cuts[1:]):
        b = raw[edges[a] : edges[z]]
        if not len(b):
            continue
        kind = _kinds()[np.frombuffer(b.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)]
        lead = np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80)])
        at = lead[edges[a : z + 1] - edges[a]]
        owner = np.repeat(np.arange(z - a), np.diff(at))
        counts = np.bincount(owner * 9 + kind, minlength=(z - a) * 9).reshape(-1, 9)
        blank = kind == 8
        begins = ~blank
        begins[1:] &= blank[:-1] | (owner[1:] != owner[:-1])
        out[a:z, 1] = np.bincount(owner, weights=begins, minlength=z - a)
        out[a:z, 2:10] = counts[:, [1, 2, 3, 4, 5, 6, 7, 8]]
    return out


def with_features(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` and the FEATURES of ``text``, in one narrow pass."""
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = text_features(b.column(n))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(n)), *(pa.array(m[:, j]) for j in range(len(FEATURES)))], names=[*keys, *FEATURES])

    schema = T.StructType([*(df.schema[k] for k in keys), *(T.StructField(f, T.LongType()) for f in FEATURES)])
    return df.select(*keys, text).mapInArrow(run, schema)


def fit(rows: list[tuple[str, int, np.ndarray, int]], ridge: float = 1.0) -> dict[str, list[float]]:
    """Coefficients per language, bias corrected, from (language, 0 to fit or 1 held out, features, tokens).

    A language with few texts leans on the coefficients of all languages
    together, which are the centre of its ridge. The key None serves languages
    without a model.
    """

    def solve(x: np.ndarray, y: np.ndarray, centre: np.ndarray) -> np.ndarray:
        scale = np.maximum(1.0, np.abs(x).mean(axis=0))
        a = x / scale
        return centre + np.linalg.solve(a.T @ a + ridge * np.eye(a.shape[1]), a.T @ (y - x @ centre)) / scale

    def corrected(part: list, w: np.ndarray) -> list[float]:
        held = [r for r in part if r[1]] or part
        guess = sum(float(r[2] @ w) for r in held)
        true = sum(r[3] for r in held)
        return [float(v) for v in w * (true / guess if guess > 0 and true > 0 else 1.0)]

    start = np.zeros(len(FEATURES))
    start[0] = 0.25
    if not rows:
        return {"": [float(v) for v in start]}
    use = [r for r in rows if not r[1]] or rows
    both = solve(np.array([r[2] for r in use], float), np.array([r[3] for r in use], float), start)
    out = {"": corrected(rows, both)}
    for lang in sorted({r[0] for r in rows}):
        part = [r for r in rows if r[0] == lang]
        own = [r for r in part if not r[1]] or part
        out[lang] = corrected(part, solve(np.array([r[2] for r in own], float), np.array([r[3] for r in own], float), both))
    return out


def slices(works: DataFrame, expressions: DataFrame, instances: DataFrame) -> DataFrame:
    """instance_id, expression_id, source_type, language, tradition_code, one row per instance; what a dangling link leaves open is 'und' or null."""
    w = works.groupBy(F.col("id").alias("work_id")).agg(F.first("source_type").alias("source_type"), F.first("tradition_code").alias("tradition_code"), F.first(label_column(F.col("primary_language_code"))).alias("work_language"))
    e = expressions.groupBy(F.col("id").alias("expression_id")).agg(F.first("work_id").alias("work_id"), F.first(label_column(F.col("language_code"))).alias("own_language"))
    i = instances.groupBy(F.col("id").alias("instance_id")).agg(F.first("expression_id").alias("expression_id"))
    known = i.join(e.join(w, "work_id", "left"), "expression_id", "left")
    return known.select("instance_id", "expression_id", "source_type", F.coalesce("own_language", "work_language", F.lit("und")).alias("language"), "tradition_code")


#: A key with more than this part of all rows is hot; there are fewer of them than its inverse.
HOT_SHARE = 1 / 64


def join_hot(rows: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """``rows`` (materialised) with the columns of ``small`` (one row per key), null where it has none. Rows of hot keys, of which there can be only a few, meet their rows of ``small`` without being shuffled; the others are joined by a shuffle."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    total = rows.count()
    hot = [r[key] for r in counts.where(F.col("n") > max(1000, total * HOT_SHARE)).collect() if r[key] is not None]
    if not hot:
        return rows.join(small, key, "left")
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return rows.where(~is_hot).join(small, key, "left").unionByName(rows.where(is_hot).join(F.broadcast(small.where(F.col(key).isin(hot))), key, "left"))


def chunk_rows(chunks: DataFrame, by_instance: DataFrame) -> DataFrame:
    """One slim row for each text that counts: its slice, features and stored token_count (null where not positive).

    Children always count. A parent counts where no child is linked to it and
    its expression has no child without a link, which might be its own: so a
    parent whose children were lost keeps its tokens, and none counts twice.
    Rows are first merged within their instance with partial aggregation; a hot
    instance is then joined without a shuffle.
    """
    chunks = chunks if "parent_chunk_id" in chunks.columns else chunks.withColumn("parent_chunk_id", F.lit(None).cast("string"))
    base = chunks.where("id IS NOT NULL").select("id", "instance_id", "parent_chunk_id", F.coalesce("is_parent", F.lit(False)).alias("is_parent"), "token_count", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("t"), "text")
    slim = with_features(base, ["id", "instance_id", "parent_chunk_id", "is_parent", "token_count", "t"], "text")
    first = [F.first(c).alias(c) for c in FEATURES]
    once = slim.groupBy("instance_id", "is_parent", "t").agg(F.min("id").alias("id"), F.collect_set(F.when(F.col("is_parent"), F.col("id"))).alias("ids"), F.bool_or(~F.col("is_parent") & F.col("parent_chunk_id").isNull()).alias("loose"), F.max(F.when(F.col("token_count") > 0, F.col("token_count"))).alias("stored"), *first)
    placed = join_hot(materialize(once), by_instance, "instance_id").withColumn("home", F.coalesce("expression_id", "instance_id"))
    rest = [F.first(c).alias(c) for c in ("instance_id", "source_type", "language", "tradition_code", *FEATURES)]
    merged = materialize(placed.groupBy("home", "is_parent", "t").agg(F.min("id").alias("id"), F.array_distinct(F.flatten(F.collect_set("ids"))).alias("ids"), F.bool_or("loose").alias("loose"), F.max("stored").alias("stored"), *rest))
    linked = chunks.where("parent_chunk_id IS NOT NULL AND NOT coalesce(is_parent, false)").select(F.col("parent_chunk_id").alias("p")).distinct()
    parents = merged.where("is_parent").select("home", "t", F.explode("ids").alias("p"))
    has_children = parents.join(linked, "p", "left_semi").select("home", "t").distinct()
    childless = merged.where("is_parent").join(has_children, ["home", "t"], "left_anti")
    loose = merged.where("NOT is_parent AND loose").select("home").distinct()
    counted = merged.where("NOT is_parent").unionByName(childless.join(loose, "home", "left_anti"), allowMissingColumns=True)
    return counted.drop("home", "t", "ids", "loose")


def model(rows: DataFrame, chunks: DataFrame, per_language: int = SAMPLE, vocabulary: str = VOCABULARY) -> dict[str, list[float]]:
    """Fit on at most ``per_language`` texts of each language. The ids of the sample (at most 17 languages x per_language) are sent to the scan."""
    w = Window.partitionBy("language").orderBy("h", "id")
    picked = rows.select("id", F.coalesce("language", F.lit("und")).alias("language"), *FEATURES, F.xxhash64("id").alias("h")).withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_language)
    picked = materialize(picked)
    texts = chunks.select("id", "text").join(F.broadcast(picked.select("id")), "id", "left_semi").dropDuplicates(["id"])
    got = count_tokens(texts, ["id"], vocabulary=vocabulary).join(picked, "id").select("language", "r", *FEATURES, "n_tokens").collect()
    return fit([(g["language"], g["r"] % 2, np.array([g[f] for f in FEATURES], float), g["n_tokens"]) for g in got])


def estimate(weights: dict[str, list[float]], language: str = "language") -> F.Column:
    """The model as an expression of the JVM over FEATURES and the language; never below 0, and 0 for an empty text."""
    table = F.create_map(*(x for lang, w in weights.items() for x in (F.lit(lang), F.array(*map(F.lit, w)))))
    w = F.coalesce(table[F.col(language)], table[F.lit("")])
    return F.greatest(F.lit(0.0), sum((F.col(f) * w[j] for j, f in enumerate(FEATURES)), F.lit(0.0)))


def chunk_tokens(spark: SparkSession, chunks: DataFrame, works: DataFrame, expressions: DataFrame, instances: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Each text that counts, with its slice, est_tokens and stored_tokens (null where the stored count can't be one).

    Null texts count as empty ones; chunks of unknown instances have the language 'und' and null elsewhere.
    """
    rows = materialize(chunk_rows(chunks, slices(works, expressions, instances)))
    weights = model(rows, chunks, vocabulary=vocabulary)
    return rows.select("id", "instance_id", "source_type", F.coalesce("language", F.lit("und")).alias("language"), "tradition_code", "is_parent", F.col("stored").alias("stored_tokens"), estimate(weights).alias("est_tokens"))


def budget(tokens: DataFrame) -> DataFrame:
    """Totals of ``chunk_tokens`` by source_type, language and tradition_code."""
    return tokens.groupBy("source_type", "language", "tradition_code").agg(
        F.count("*").alias("n_texts"),
        F.round(F.sum("est_tokens")).cast("long").alias("est_tokens"),
        F.coalesce(F.sum("stored_tokens"), F.lit(0)).alias("stored_tokens"),
        F.count_if(F.col("stored_tokens").isNull()).alias("n_without_stored"),
    )
