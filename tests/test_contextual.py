import pytest
from pyspark.sql import functions as F

from corpusloom.operators import contextual as C

SCHEMA = "id STRING, parent_chunk_id STRING, sequence INT, is_parent BOOLEAN, text STRING, context_text STRING, context_version STRING, context_model STRING"
ROWS = [("p", None, 0, True, "p" * 40, None, None, None), ("a", "p", 1, False, "aaaa", None, None, None), ("b", "p", 2, False, "bbbbbbbb", "old", "v0", "m"), ("c", "p", 3, False, "cc", "done", "v1", "m"), ("o", "gone", 4, False, "x", None, None, None)]


def test_pending_requests_and_costs(spark):
    chunks = spark.createDataFrame([*ROWS, ROWS[1]], SCHEMA)
    pairs = C.pending_pairs(chunks, "v1")
    assert sorted(r["id"] for r in pairs.collect()) == ["a", "b"]
    assert [r["id"] for r in C.by_parent(pairs, 2).collect()] == ["a", "b"]
    m = pairs.orderBy("id").select(C.messages("Say where this is from.", F.col("parent_text"), F.col("text")).alias("m")).head()["m"]
    assert m[0]["content"] == "Say where this is from." and m[1]["content"] == "<document>\n" + "p" * 40 + "\n</document>\n\n<chunk>\naaaa\n</chunk>"
    blank = pairs.withColumn("text", F.lit(" "))
    assert blank.select(C.messages("x", F.col("parent_text"), F.col("text")).alias("m")).head()["m"] is None
    with pytest.raises(Exception, match="empty document"):
        blank.select(C.messages("x", F.col("parent_text"), F.col("text"), strict=True)).collect()
    r = C.projected_cost(pairs).head()
    assert (r["calls"], r["cache_write"], r["cache_read"], r["tokens_in"]) == (2, 10, 10, 3) and r["usd"] > 0
    assert C.projected_cost(pairs.where("false")).head()["usd"] == 0


def test_contexts_are_put_in(spark):
    chunks = spark.createDataFrame(ROWS, SCHEMA)
    got = {r["id"]: (r["context_text"], r["context_version"]) for r in C.with_context(chunks, spark.createDataFrame([("a", "new")], "id STRING, context_text STRING"), "v1", "m2").collect()}
    assert got["a"] == ("new", "v1") and got["b"] == ("old", "v0") and got["p"] == (None, None)


def test_runs_stop_at_the_cap(spark):
    rows = spark.createDataFrame([(str(i), f"p{i}") for i in range(40)], "id STRING, parent_chunk_id STRING")
    seen = []
    ran, spent = C.run_capped(rows, 4, lambda df: seen.append(df.count()) or 1.0, 2.0)
    assert (ran, spent, len(seen)) == (2, 2.0, 2)
    seen.clear()
    assert C.run_capped(rows, 4, lambda df: seen.append(df.count()) or 0.1, 9.0)[0] == 4 and sum(seen) == 40


def test_usage_of_calls(spark):
    calls = spark.createDataFrame([("a", 1_000_000, 0, 400_000, 600_000), ("a", 0, 1_000_000, None, None), ("b", 10, 5, 0, 0)], "model STRING, tokens_in INT, tokens_out INT, cache_write INT, cache_read INT")
    got = {r["model"]: r for r in C.usage(calls).collect()}
    assert (got["a"]["calls"], got["a"]["tokens_in"]) == (2, 0) and abs(got["a"]["usd"] - (0.4 * 0.8 * 1.25 + 0.6 * 0.8 * 0.1 + 4.0)) < 1e-9
    priced = {r["model"]: r["usd"] for r in C.usage(calls, spark.createDataFrame([("b", 1.0, 2.0)], "model STRING, per_million_in DOUBLE, per_million_out DOUBLE")).collect()}
    assert abs(priced["b"] - 20 / 1e6) < 1e-12 and abs(priced["a"] - got["a"]["usd"]) < 1e-9
    assert C.usage(calls.where("false")).count() == 0


def test_usage_and_report():
    u = C.Usage()
    u.add(1_000_000, 0, cache_write=400_000, cache_read=600_000)
    u.add(0, 1_000_000)
    assert u.calls == 2 and u.tokens_in == 0 and abs(u.usd() - (0.4 * 0.8 * 1.25 + 0.6 * 0.8 * 0.1 + 4.0)) < 1e-9
    assert C.markdown([{"k": "a|b", "v": 0.5}, {"k": "c"}], ["k", "v"]) == "| k | v |\n|---|---|\n| a\\|b | 0.500 |\n| c | – |\n"
