import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import budget as K
from corpusloom.llm.tokenizing import TrieEncoder, read_vocabulary

TEXTS = [None, "", " \n", "one two, three 4", "saṃsāra 12", "Старый монах.", "老僧人。字", "a\xa0b"]


def test_features_count_what_they_say():
    m = K.text_features(pa.array(TEXTS))
    assert m.tolist() == K.text_features(pa.array(["x", *TEXTS]).slice(1)).tolist() == K.text_features(pa.array(TEXTS), at_once=9).tolist()
    f = [dict(zip(K.FEATURES, r)) for r in m.tolist()]
    assert [x["words"] for x in f] == [len((t or "").split()) for t in TEXTS]
    assert [x["bytes"] for x in f] == [len((t or "").encode()) for t in TEXTS]
    assert f[3]["digits"] == 1 and f[3]["punctuation"] == 1 and f[3]["latin"] == 11 and f[4]["latin_marked"] == 2 and f[5]["cyrillic"] == 11 and f[6]["cjk"] == 4 and f[7]["blanks"] == 1


@pytest.fixture(scope="module")
def tables(spark):
    d = "/root/testdata/sf0.001"
    return [spark.read.parquet(f"{d}/{n}.parquet") for n in ("chunks", "works", "expressions", "instances")]


def test_estimates_come_close_on_all_texts(spark, tables):
    chunks = tables[0]
    got = K.chunk_tokens(spark, *tables).collect()
    text = {r["id"]: r["text"] for r in chunks.select("id", "text").distinct().collect()}
    offsets, _ = TrieEncoder(read_vocabulary()).encode([text[r["id"]] for r in got])
    true = np.diff(offsets).sum()
    assert abs(sum(r["est_tokens"] for r in got) / true - 1) < 0.05
    assert all(r["est_tokens"] >= 0 for r in got)


def test_no_text_counts_twice(spark):
    works = [("w", "early", "eng", "canonical")]
    exprs = [("e", "w", "EN"), ("e", "w", "EN"), ("x", "w", "xx")]
    insts = [("i1", "e"), ("i2", "e"), ("i3", "x"), ("i3", "x")]
    chunks = [
        ("p", "i1", True, 9, "one two three"), ("c1", "i1", False, 2, "one two"), ("c2", "i1", False, None, "three"), ("c1", "i1", False, 2, "one two"),
        ("d1", "i2", False, -5, "one two"), ("q", "i3", True, 0, "alone here"), ("z", "lost", False, 3, "somewhere"), ("n", "i1", False, 4, None), (None, "i1", False, 4, "x"),
    ]
    got = K.chunk_tokens(
        spark,
        spark.createDataFrame(chunks, "id STRING, instance_id STRING, is_parent BOOLEAN, token_count INT, text STRING").selectExpr("*", "1 AS bytes", "'k' AS language"),
        spark.createDataFrame(works, "id STRING, tradition_code STRING, primary_language_code STRING, source_type STRING"),
        spark.createDataFrame(exprs, "id STRING, work_id STRING, language_code STRING"),
        spark.createDataFrame(insts, "id STRING, expression_id STRING"),
    )
    rows = {r["id"]: r for r in got.collect()}
    assert set(rows) == {"c1", "c2", "q", "z", "n"}
    assert rows["c1"]["language"] == "eng" and rows["q"]["language"] == "eng" and rows["z"]["language"] == "und" and rows["c1"]["stored_tokens"] == 2 and rows["q"]["stored_tokens"] is None
    total = {(r["language"], r["source_type"]): r for r in K.budget(got).collect()}
    assert total[("eng", "canonical")]["n_texts"] == 4 and total[("und", None)]["n_texts"] == 1


def test_fit_corrects_its_bias():
    rng = np.random.default_rng(1)
    rows = []
    for i in range(200):
        x = rng.integers(0, 100, len(K.FEATURES)).astype(float)
        rows.append(("eng", i % 2, x, int(x[0] * 0.3 + x[1] + 2)))
    w = K.fit(rows)
    held = [r for r in rows if r[1]]
    assert abs(sum(r[2] @ np.array(w["eng"]) for r in held) / sum(r[3] for r in held) - 1) < 1e-9
    assert K.fit([])[""][0] == 0.25


def test_empty_tables(spark, tables):
    assert K.chunk_tokens(spark, *(t.where("false") for t in tables)).count() == 0


def test_a_parent_counts_where_its_children_are_lost(spark):
    chunks = [
        ("p", "i", None, True, 3, "one two three"), ("c", "i", "p", False, 3, "one two three"), ("q", "i", None, True, 2, "four five"),  # q has no child
        ("r", "j", None, True, 2, "six seven"), ("d", "j", None, False, 2, "six seven"),  # d may be r's
    ]
    none = lambda schema: spark.createDataFrame([], schema)
    by_instance = K.slices(none("id STRING, tradition_code STRING, primary_language_code STRING, source_type STRING"), none("id STRING, work_id STRING, language_code STRING"), none("id STRING, expression_id STRING"))
    df = spark.createDataFrame(chunks, "id STRING, instance_id STRING, parent_chunk_id STRING, is_parent BOOLEAN, token_count INT, text STRING")
    assert {r["id"] for r in K.chunk_rows(df, by_instance).collect()} == {"c", "q", "d"}


def test_hot_keys_are_joined_without_a_shuffle(spark):
    rows = spark.range(5000).selectExpr("CASE WHEN id % 2 = 0 THEN 'hot' WHEN id % 9 = 0 THEN NULL ELSE CAST(id AS STRING) END AS k", "id")
    small = spark.createDataFrame([("hot", 1), ("7", 2)], "k STRING, v INT")
    got = K.join_hot(rows, small, "k")
    assert got.count() == 5000 and got.where("v = 1").count() == 2500 and [r["id"] for r in got.where("v = 2").collect()] == [7]
