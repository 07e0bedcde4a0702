"""File sources: trees of segment JSON, transcripts, talk metadata, curated YAML lists, dictionaries in script modules."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.text import humanised_slug, nfc, normalise_lemma, split_meanings, strip

# Names of segment files (uid, kind, language, author), and the lines around the body of a transcript.
SEGMENT_NAME = r"/([A-Za-z0-9._-]+)_(root|translation)-([A-Za-z]+)-([A-Za-z0-9]+)\.json$"
HEADER, FOOTER = r"(?m)^TRANSCRIPTION:\s*$", r"(?m)^Generated by WhisperAI\s*$"


def segment_files(spark: SparkSession, root: str, kind: str | None = None, language: str | None = None, author: str | None = None, collection: str | None = None, strict: bool = False) -> DataFrame:
    """Files of a tree whose names follow the grammar: path, uid, kind, language, author, collection, content. A missing root raises; other names are skipped, or raise if ``strict`` (as for a single file)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(root)
    part = lambda n: F.regexp_extract("path", SEGMENT_NAME, n)
    fits = F.col("path").rlike(SEGMENT_NAME)
    files = files.where(F.when(fits, True).otherwise(F.raise_error(F.concat(F.lit("not the name of a segment file: "), "path")).cast("boolean"))) if strict else files.where(fits)
    named = files.select("path", part(1).alias("uid"), part(2).alias("kind"), part(3).alias("language"), part(4).alias("author"), F.nullif(F.regexp_extract("path", ".*/sutta/([^/]+)/", 1), F.lit("")).alias("collection"), F.col("content").cast("string").alias("content"))
    for column, value in (("kind", kind), ("language", language), ("author", author), ("collection", collection)):
        named = named.where(F.col(column) == value) if value is not None else named
    return named


_PAIRS = T.ArrayType(T.StructType([T.StructField("segment_id", T.StringType()), T.StructField("text", T.StringType())]))


@F.pandas_udf(_PAIRS)
def _pairs(contents: pd.Series) -> pd.Series:
    out = []
    for content in contents:
        got = json.loads(content)
        if not isinstance(got, dict) or not all(isinstance(v, str) for v in got.values()):
            raise ValueError("a segment file must be one object of strings")
        out.append([{"segment_id": k, "text": v} for k, v in got.items()])
    return pd.Series(out)


def segments(files: DataFrame) -> DataFrame:
    """path, uid, ord, segment_id, text of each file, in the order of the file, texts as they stand; anything but an object of strings raises. A JSON map of the JVM would lose the order."""
    return files.select("path", "uid", F.posexplode(_pairs("content")).alias("ord", "s")).select("path", "uid", "ord", "s.segment_id", "s.text")


def titles(rows: DataFrame) -> DataFrame:
    """path, uid, title of each file: the segment 0.2, else 0.1, else the first that isn't empty, else the uid; at most 512 characters. Translations of one uid have titles of their own."""
    t = F.trim("text")
    at = lambda s: F.max(F.when((F.col("segment_id") == F.concat("uid", F.lit(s))) & (t != ""), t))
    first = F.min_by(F.when(t != "", t), F.when(t != "", F.col("ord")))
    return rows.groupBy("path", "uid").agg(F.substring(F.coalesce(at(":0.2"), at(":0.1"), first, F.first("uid")), 1, 512).alias("title"))


def root_titles(rows: DataFrame, root_files: DataFrame) -> DataFrame:
    """path, uid, root_title: the title segment of the root text of the same uid, null where there is none.

    ``rows``: files of translations (path, uid); ``root_files``: files as of
    ``segment_files`` of kind root. A root file that can't be read as an object
    gives no title instead of ending the load.
    """
    title = lambda n: F.nullif(F.trim(F.call_function("get_json_object", F.col("content"), F.concat(F.lit("$['"), "uid", F.lit(f":{n}']")))), F.lit(""))
    found = root_files.select("uid", F.substring(F.coalesce(title("0.2"), title("0.1")), 1, 512).alias("root_title")).where("root_title IS NOT NULL").groupBy("uid").agg(F.min("root_title").alias("root_title"))
    return rows.select("path", "uid").distinct().join(found, "uid", "left").select("path", "uid", "root_title")


def transcripts(spark: SparkSession, root: str, metadata: DataFrame | None = None, least: int = 200) -> DataFrame:
    """Talks of a folder of text files ``prefix_id_slug.txt``: talk_id, title, date, body, body_hash. Bodies under ``least`` characters are left out.

    ``metadata``: id, title, date; of an id that comes twice the last by position counts.
    """
    raw = spark.read.text(root, wholetext=True, pathGlobFilter="*.txt", recursiveFileLookup=True).select("value", F.col("_metadata.file_name").alias("name"))
    after = F.element_at(F.split("value", HEADER, 2), -1)
    body = strip(F.element_at(F.split(after, FOOTER, 2), 1))
    name = r"^([^_]+)_(\d+)_(.+)\.txt$"
    talks = raw.where(F.col("name").rlike(name)).select(F.regexp_extract("name", name, 2).alias("talk_id"), humanised_slug(F.regexp_extract("name", name, 3)).alias("slug_title"), body.alias("body")).where(F.length("body") >= least)
    if metadata is None:
        return talks.select("talk_id", F.col("slug_title").alias("title"), F.lit("").alias("date"), "body", F.sha2("body", 256).alias("body_hash"))
    known = metadata.where("id IS NOT NULL").withColumn("n", F.monotonically_increasing_id()).groupBy(F.col("id").cast("string").alias("talk_id")).agg(F.max_by(F.struct("title", "date"), "n").alias("m"))
    joined = talks.join(known, "talk_id", "left")
    return joined.select("talk_id", F.coalesce(F.nullif(F.col("m.title"), F.lit("")), "slug_title").alias("title"), F.coalesce("m.date", F.lit("")).alias("date"), "body", F.sha2("body", 256).alias("body_hash"))


def _yaml(path: str):
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)


def golden_set(spark: SparkSession, path: str) -> DataFrame:
    """A golden set: every item complete, as many as declared; else ValueError."""
    doc = _yaml(path)
    items = doc.get("queries") if isinstance(doc, dict) else None
    if not isinstance(items, list):
        raise ValueError("no list of queries")
    for i in items:
        missing = {"id", "query", "expected_works", "topic", "language", "difficulty"} - set(i)
        if missing:
            raise ValueError(f"{i.get('id')}: {sorted(missing)} missing")
    declared = (doc.get("metadata") or {}).get("total_items")
    if declared is not None and declared != len(items):
        raise ValueError(f"{declared} items declared, {len(items)} found")
    rows = [(str(i["id"]), i["query"], list(i["expected_works"]), list(i.get("expected_segments") or []), i["topic"], i["language"], i["difficulty"], i.get("rationale")) for i in items]
    return spark.createDataFrame(rows, "id STRING, query STRING, expected_works ARRAY<STRING>, expected_segments ARRAY<STRING>, topic STRING, language STRING, difficulty STRING, rationale STRING")


def term_map(spark: SparkSession, path: str, default: float = 1.5) -> DataFrame:
    """A curated list of terms with aliases and works: entry, term, aliases, works, boost."""
    rows = []
    for n, e in enumerate(_yaml(path) or []):
        if not e.get("term") or not e.get("works"):
            raise ValueError(f"entry {n} needs a term and works")
        rows.append((n, e["term"], list(e.get("aliases") or []), list(e["works"]), float(e.get("boost", default))))
    return spark.createDataFrame(rows, "entry INT, term STRING, aliases ARRAY<STRING>, works ARRAY<STRING>, boost DOUBLE")


def script_module(spark: SparkSession, path: str) -> DataFrame:
    """ord, key, value of a dictionary that a script module exports as one object of strings."""
    with open(path, encoding="utf-8") as f:
        m = re.search(r"export\s+const\s+\w+\s*=\s*(\{.*\})\s*;?\s*$", f.read(), re.DOTALL)
    if not m:
        raise ValueError("no exported object")
    return spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(json.loads(m.group(1)).items())], "ord INT, key STRING, value STRING")


def parsed_entries(raw: DataFrame) -> DataFrame:
    """Dictionary lines ``pattern|pos|construction|stem|lemma`` by their parts; lines of fewer parts, and without a lemma, are left out."""
    p = F.split("value", r"\|")
    return raw.where(F.size(p) >= 5).select("ord", "key", F.trim(p[1]).alias("pos"), normalise_lemma(F.trim(p[4])).alias("lemma")).where("lemma <> ''")


def defined(entries: DataFrame, english: DataFrame, russian: DataFrame) -> DataFrame:
    """Entries (ord, key, pos, lemma) with their meanings from the files of definitions (key, value), none where a file hasn't the entry."""
    none = F.array().cast("array<string>")
    e = english.select("key", split_meanings(F.col("value")).alias("meanings_en"))
    r = russian.select("key", split_meanings(F.col("value")).alias("meanings_ru"))
    return entries.join(e, "key", "left").join(r, "key", "left").withColumns({c: F.coalesce(c, none) for c in ("meanings_en", "meanings_ru")})


def build_glossary(entries: DataFrame, most: int = 5) -> DataFrame:
    """lemma, pos, meanings_en, meanings_ru by lemma, composed: meanings in order of the entries, each once, at most ``most``; parts of speech sorted. ``entries`` as of ``defined``."""
    part = lambda c: F.slice(F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("ord", F.col(c).alias("m")))), lambda x: x["m"]))), 1, most)
    rows = entries.groupBy("lemma").agg(F.array_sort(F.collect_set(F.nullif(F.col("pos"), F.lit("")))).alias("pos"), part("meanings_en").alias("meanings_en"), part("meanings_ru").alias("meanings_ru"))
    whole = lambda c: F.split(nfc(F.array_join(c, "\x1f")), "\x1f")
    kept = lambda c: F.when(F.size(c) > 0, whole(c)).otherwise(F.array().cast("array<string>")).alias(c)
    return rows.select(nfc("lemma").alias("lemma"), *(kept(c) for c in ("pos", "meanings_en", "meanings_ru")))


def write_glossary(glossary: DataFrame, path: str) -> None:
    """One compact JSON object per line and lemma."""
    glossary.write.mode("overwrite").json(path)


def read_glossary(spark: SparkSession, lemmas_path: str, cyrillic_path: str) -> tuple[DataFrame, DataFrame]:
    """Lemmas (lemma, pos, meanings_en, meanings_ru) of a JSON file, one object by lemma or one per line, and Cyrillic spellings (word, lemma) of a YAML list.

    Keys are composed and lower case; of a spelling of two lemmas the first
    counts. A missing file raises.
    """
    schema = "lemma STRING, pos ARRAY<STRING>, meanings_en ARRAY<STRING>, meanings_ru ARRAY<STRING>"
    text = spark.read.text(lemmas_path, wholetext=True)
    whole = text.select(F.explode(F.from_json("value", f"map<string, struct<{schema.replace(' ', ':').replace(',:', ', ')}>>")).alias("k", "v")).select("v.*").where("lemma IS NOT NULL")
    lines = spark.read.schema(schema).json(lemmas_path).where("lemma IS NOT NULL")
    none = F.array().cast("array<string>")
    rows = whole.unionByName(lines).select(F.lower(nfc("lemma")).alias("lemma"), *(F.coalesce(c, none).alias(c) for c in ("pos", "meanings_en", "meanings_ru"))).dropDuplicates(["lemma"])
    words: dict[str, str] = {}
    for e in _yaml(cyrillic_path) or []:
        for v in e["cyrillic"]:
            words.setdefault(unicodedata.normalize("NFC", v).lower(), e["pali"])
    return rows, spark.createDataFrame(list(words.items()), "word STRING, lemma STRING")


def batches_in_order(df: DataFrame, key: str, size: int) -> DataFrame:
    """Rows numbered into batches of ``size`` by their key, for consumers that page through a table. Numbers within ranges of keys, so no task sees all rows."""
    spread = df.repartitionByRange(key).sortWithinPartitions(key).withColumn("part", F.spark_partition_id())
    w = Window.partitionBy("part").orderBy(key)
    return spread.withColumn("batch", F.concat_ws("-", F.col("part"), F.floor((F.row_number().over(w) - 1) / size)))
