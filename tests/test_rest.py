import json

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import answers, chunking, evaluate, library, sinks
from corpusloom.sources import files
from corpusloom.streaming import feedback


def segs(*counts, paragraph=lambda i: i + 1):
    return [(f"x:{paragraph(i)}.1", " ".join(["w"] * n)) for i, n in enumerate(counts)]


def test_chunks_of_segments():
    words = lambda t: len(t.split())
    got = chunking.chunk_segments([(f"x:{p}.{k}", " ".join(["w"] * 90)) for p in (1, 2, 3) for k in (1,)], 150, 500, 60, 100, words)
    assert [c["segment_ids"] for c in got] == [["x:1.1", "x:2.1"], ["x:3.1"]] and [len(c["children"]) for c in got] == [2, 1]
    assert len(chunking.chunk_segments(segs(200, 200, 200), 300, 250, 100, 150, words)) == 3
    assert chunking.chunk_segments([]) == [] and chunking.chunk_segments([("a", "w " * 900)], count=words)[0]["tokens"] == 900


def test_chunks_of_talks():
    words = lambda t: len(t.split())
    body = "\n\n".join(" ".join(f"s{i}{k}." for k in range(10)) for i in range(4))
    got = chunking.chunk_talk(body, 20, 40, 8, 10, 0.25, words)
    assert len(got) == 2 and all(c["tokens"] <= 10 for p in got for c in p["children"])
    a, b = got[0]["children"][:2]
    assert a["text"].split()[-2:] == b["text"].split()[:2]
    with pytest.raises(ValueError):
        chunking.chunk_talk("x", overlap=1.0)
    assert chunking.chunk_talk(" \n\n ") == []


def test_chunk_rows(spark):
    df = spark.createDataFrame([("d", 2, "d:2.1", "two words"), ("d", 1, "d:1.1", "one"), ("d", 3, "d:3.1", " "), ("e", 1, "e", None)], "document STRING, ord INT, segment_id STRING, text STRING")
    got = chunking.chunk_documents(df).orderBy("sequence").collect()
    assert [(r["is_parent"], r["parent_sequence"], r["text"], r["segment_id"]) for r in got] == [(True, None, "one two words", "d:1.1"), (False, 0, "one two words", "d:1.1")]
    assert chunking.chunk_talks(spark.createDataFrame([("t", "a b. c"), ("u", None)], "document STRING, text STRING")).count() == 2


def test_scanner():
    s = answers.CitationScanner(frozenset(["mn10", "mn39", "dn10"]))
    assert s.feed("see [mn") == [] and s.feed("10]. and [mn39, dn10] [free text] [zz] [mn10]") == [("mn10", 10), ("mn39", 28), ("dn10", 28)] and s.feed("") == []
    assert s.seen == ["mn10", "mn39", "dn10"] and s.rest == ""
    assert answers.answer_segments("a [x] [y, z]", {"x", "z"}) == [("text", "a "), ("citation", ["x"]), ("text", " "), ("citation", ["z"])]


def test_events():
    assert feedback.parse_events("event: token\r\ndata: a\r\ndata: b\r\n\r\n: note\n\ndata: c\n\nevent: x\ndata: lost") == [("token", "a\nb"), ("message", "c")]
    ev = feedback.answer_events(["mn1"], ["hi [mn", "1]"], {"mn1"})
    assert [e[0] for e in ev] == ["retrieval_done", "token", "token", "citation", "done"] and ev[-1][1]["citations"] == ["mn1"]
    assert [e[0] for e in feedback.answer_events([], ["x"], set())] == ["retrieval_done", "done"]


def test_streams(spark, tmp_path):
    schema = "trace_id STRING, ts LONG, thumb INT"
    src = tmp_path / "in"
    for k, rows in enumerate([[("a", 1, 1), ("b", 1, 1)], [("a", 2, -1), ("a", 2, -1), ("c", 1, 1)], [("b", 0, -1)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src / f"p{k}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(src))
    feedback.upsert_stream(stream, str(tmp_path / "out"), ["trace_id"], ["ts"], str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert {tuple(r) for r in feedback.current(spark, str(tmp_path / "out"), ["trace_id"], ["ts"]).collect()} == {("a", 2, -1), ("b", 1, 1), ("c", 1, 1)}

    deltas = tmp_path / "deltas"
    spark.createDataFrame([("t", 1, "see [mn", ["mn1"]), ("t", 2, "1] [mn1]", ["mn1"]), ("u", 1, "[zz]", ["mn1"])], "trace_id STRING, seq INT, delta STRING, sources ARRAY<STRING>").write.parquet(str(deltas))
    d = spark.readStream.schema("trace_id STRING, seq INT, delta STRING, sources ARRAY<STRING>").parquet(str(deltas))
    q = feedback.scan_citations(d).writeStream.format("memory").queryName("found").outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.sql("SELECT * FROM found").collect()] == [("t", "mn1", 9)]


def test_sinks(spark):
    old = spark.createDataFrame([("a", 1, "x")], "k STRING, v INT, t STRING")
    new = spark.createDataFrame([("a", 2, "y"), ("a", 2, None), ("b", 1, "z")], "k STRING, v INT, t STRING")
    assert {tuple(r) for r in sinks.upsert(old, new, ["k"], ["v"]).collect()} == {("a", 2, "y"), ("b", 1, "z")}
    assert {tuple(r) for r in sinks.insert_absent(old, new, ["k"]).collect()} == {("b", 1, "z")}
    assert {tuple(r) for r in sinks.upsert(old, old, ["k"], ["v"]).collect()} == {("a", 1, "x")}

    def work(f):
        if (f["v"] == 2).any():
            raise ValueError("two")
        return f[["k", "v"]]

    got = sinks.each_batch(new.coalesce(1), work, "k STRING, v INT").collect()
    assert all(r["error"] == "ValueError: two" for r in got) and len(got) == 3
    assert sinks.each_batch(old, work, "k STRING, v INT").head()["error"] is None


def test_evaluation(spark):
    golden = spark.createDataFrame([("1", ["w1"], "easy", "en"), ("2", ["w2"], "easy", "ru"), ("3", ["w3"], "hard", "en")], "id STRING, expected_works ARRAY<STRING>, difficulty STRING, language STRING")
    res = spark.createDataFrame([("1", 1, "w1"), ("1", 2, "w1"), ("2", 1, "x"), ("2", 3, "w2"), ("3", 1, "x")], "id STRING, rank INT, work STRING")
    best = evaluate.best_ranks(golden, res)
    s = {(r["difficulty"], r["language"]): r for r in evaluate.summary(best, (1, 5)).collect()}
    whole = s[(None, None)]
    assert whole["n"] == 3 and abs(whole["hit_1"] - 1 / 3) < 1e-6 and abs(whole["mrr"] - (1 + 1 / 3) / 3) < 1e-6 and s[("hard", None)]["mrr"] == 0 and len(s) == 5
    assert [r["id"] for r in evaluate.worst(best, 2).collect()] == ["3", "2"]
    other = evaluate.best_ranks(golden, spark.createDataFrame([("3", 1, "w3")], "id STRING, rank INT, work STRING"))
    assert {tuple(r) for r in evaluate.compare(best, other).collect()} == {("1", "regressed"), ("2", "regressed"), ("3", "fixed")}
    with pytest.raises(ValueError):
        evaluate.hit(0)


def test_file_sources(spark, tmp_path):
    root = tmp_path / "translation/en/someone/sutta/mn"
    root.mkdir(parents=True)
    (root / "mn1_translation-en-someone.json").write_text(json.dumps({"mn1:0.1": "Middle ", "mn1:0.2": "The Root ", "mn1:1.1": "So I heard."}))
    (root / "README.json").write_text("{}")
    f = files.segment_files(spark, str(tmp_path), kind="translation")
    assert [(r["uid"], r["language"], r["author"], r["collection"]) for r in f.collect()] == [("mn1", "en", "someone", "mn")]
    rows = files.segments(f)
    assert [r["text"] for r in rows.orderBy("ord").collect()] == ["Middle ", "The Root ", "So I heard."]
    assert files.titles(rows).head()["title"] == "The Root" and files.segment_files(spark, str(tmp_path), language="ru").count() == 0
    with pytest.raises(Exception):
        files.segment_files(spark, str(tmp_path / "none")).count()

    talks = tmp_path / "talks"
    talks.mkdir()
    (talks / "rb_12_the_way_of-love.txt").write_text("Title\nTRANSCRIPTION:\n" + "word " * 60 + "\nGenerated by WhisperAI\n")
    (talks / "rb_13_short.txt").write_text("TRANSCRIPTION:\nshort")
    meta = spark.createDataFrame([("12", "Old", "2019-01-01"), ("12", "Title of it", "2020-01-01"), (None, "x", "")], "id STRING, title STRING, date STRING").coalesce(1)
    got = files.transcripts(spark, str(talks), meta).collect()
    assert [(r["talk_id"], r["title"], r["date"]) for r in got] == [("12", "Title of it", "2020-01-01")] and got[0]["body"].startswith("word") and got[0]["body"].endswith("word")
    assert files.transcripts(spark, str(talks)).head()["title"] == "The Way of Love"


def test_curated_lists(spark, tmp_path):
    golden = tmp_path / "g.yaml"
    golden.write_text("metadata: {total_items: 1}\nqueries:\n- {id: q1, query: x, expected_works: [a], topic: t, language: en, difficulty: easy}\n")
    assert files.golden_set(spark, str(golden)).head()["expected_works"] == ["a"]
    golden.write_text("metadata: {total_items: 2}\nqueries:\n- {id: q1, query: x, expected_works: [a], topic: t, language: en, difficulty: easy}\n")
    with pytest.raises(ValueError):
        files.golden_set(spark, str(golden))
    golden.write_text("queries:\n- {id: q1, query: x}\n")
    with pytest.raises(ValueError):
        files.golden_set(spark, str(golden))
    terms = tmp_path / "t.yaml"
    terms.write_text("- {term: dukkha, works: [sn56.11]}\n- {term: metta, aliases: [a], works: [b], boost: 2}\n")
    assert [(r["term"], r["boost"]) for r in files.term_map(spark, str(terms)).collect()] == [("dukkha", 1.5), ("metta", 2.0)]
    mod = tmp_path / "d.mjs"
    mod.write_text('export const X = {"1": "p|noun|c|s|dhamma 1.1"};\n')
    r = files.parsed_entries(files.script_module(spark, str(mod))).head()
    assert (r["key"], r["pos"], r["lemma"]) == ("1", "noun", "dhamma")


def test_batches(spark):
    got = files.batches_in_order(spark.range(25).selectExpr("id"), "id", 4).groupBy("batch").count().collect()
    assert all(r["count"] <= 4 for r in got) and sum(r["count"] for r in got) == 25


def test_a_new_checkpoint_keeps_what_is_there(spark, tmp_path):
    schema, keys, version, out = "trace_id STRING, ts LONG, thumb INT", ["trace_id"], ["ts"], str(tmp_path / "out")
    spark.createDataFrame([("a", 1, 1), ("b", 5, 1)], schema).write.parquet(str(tmp_path / "one"))
    spark.createDataFrame([("b", 2, -1), ("c", 1, 1)], schema).write.parquet(str(tmp_path / "two"))
    for n, src in enumerate(("one", "two")):  # each with a checkpoint of its own, whose batches begin at 0
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / src))
        feedback.upsert_stream(stream, out, keys, version, str(tmp_path / f"cp{n}")).trigger(availableNow=True).start().awaitTermination()
    want = {("a", 1, 1), ("b", 5, 1), ("c", 1, 1)}
    assert {tuple(r) for r in feedback.current(spark, out, keys, version).collect()} == want
    feedback.compact(spark, out, keys, version)
    assert len(feedback._parts(spark, out)) == 1 and {tuple(r) for r in feedback.current(spark, out, keys, version).collect()} == want
    spark.createDataFrame([("a", 9, -1)], schema).write.parquet(str(tmp_path / "three"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "three"))
    feedback.upsert_stream(stream, out, keys, version, str(tmp_path / "cp3"), compact_every=1).trigger(availableNow=True).start().awaitTermination()
    assert len(feedback._parts(spark, out)) == 1 and ("a", 9, -1) in {tuple(r) for r in feedback.current(spark, out, keys, version).collect()}


def test_answers_as_a_stream(spark, tmp_path):
    schema = "trace_id STRING, seq LONG, delta STRING, sources ARRAY<STRING>, done BOOLEAN"
    rows = [("t", 1, "see [mn", ["mn1"], False), ("t", 2, "1].", None, True), ("u", 1, None, [], False), ("u", 2, "late", [], True)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "deltas"))
    d = spark.readStream.schema(schema).parquet(str(tmp_path / "deltas"))
    q = feedback.answer_stream(d).writeStream.format("memory").queryName("said").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {}
    for r in spark.sql("SELECT * FROM said").collect():
        got.setdefault(r["trace_id"], []).append(r["event"])
    assert got == {"t": ["retrieval_done", "token", "token", "citation", "done"], "u": ["retrieval_done", "done"]}
    hits = spark.createDataFrame([("q", "w2", 2), ("q", "w1", 1)], "query_id STRING, work STRING, rank INT")
    first = {r["query_id"]: (r["sources"], len(r["trace_id"])) for r in feedback.retrievals(spark.createDataFrame([("q",), ("r",)], "query_id STRING"), hits).collect()}
    assert first == {"q": (["w1", "w2"], 36), "r": ([], 36)}


def test_samples_and_middles(spark):
    rows = spark.range(5000).selectExpr("CASE WHEN id < 4000 THEN 'a' ELSE concat('b', id % 7) END AS g", "CAST(id AS INT) AS sequence", "CAST(id AS STRING) AS id")
    got = {r["g"]: r["sequence"] for r in library.middle_rows(rows, "g", "sequence", "id", width=100).collect()}
    for g, members in (("a", range(4000)), ("b3", [i for i in range(4000, 5000) if i % 7 == 3])):
        assert got[g] == sorted(members)[len(members) // 2]
    few = library.sample(rows, 10, "id", seed=3, without=rows.where("sequence % 2 = 0"))
    ids = {r["id"] for r in few.collect()}
    assert len(ids) == 10 and all(int(i) % 2 for i in ids) and ids == {r["id"] for r in few.collect()}
    assert rows.where(library.starts_with(F.col("g"), "a", "b1")).count() == 4000 + len([i for i in range(4000, 5000) if i % 7 == 1]) and rows.where(library.starts_with(F.col("g"))).count() == 5000


def test_authors_and_cards(spark):
    e = spark.createDataFrame([("e1", "w1", "p1", "eng"), ("e2", "w2", None, "rus")], "id STRING, work_id STRING, author_id STRING, language_code STRING")
    people = spark.createDataFrame([("p1", "rob", "Rob")], "id STRING, slug STRING, name STRING")
    assert {(r["id"], r["author_slug"]) for r in library.with_author(e, people).collect()} == {("e1", "rob"), ("e2", None)}
    w = spark.createDataFrame([("w1", "mn1", "One"), ("w2", "mn2", "Two")], "id STRING, canonical_id STRING, title STRING")
    assert [r["canonical_id"] for r in library.by_author(w, e, "p1").collect()] == ["mn1"]
    i = spark.createDataFrame([("i1", "e1"), ("i2", "e2")], "id STRING, expression_id STRING")
    c = spark.createDataFrame([("c1", "i1", "said in spring"), ("c2", "i2", None)], "id STRING, instance_id STRING, context_text STRING")
    hits = spark.createDataFrame([("q", "c1", 1), ("q", "c2", 2), ("q", "gone", 3)], "query_id STRING, chunk_id STRING, rank INT")
    got = [(r["work"], r["translator"], r["context_text"]) for r in library.cards(hits, c, i, e, w, people).orderBy("rank").collect()]
    assert got == [("mn1", "Rob", "said in spring"), ("mn2", None, None)]


def test_confidence_is_measured_on_what_is_shown(spark):
    rows = [("a", "x [mn1] y [MN1] z", ["mn1"]), ("b", "[a, zzzzzzzzzzzzzzzzzzzzzzzzzzzz, b] [c] and much more text than that", ["a", "b", "c"]), ("c", "none", []), ("d", None, ["a"]), ("e", "no marks", ["a"])]
    got = {r["trace_id"]: (r["n_unique"], r["n_total"], r["tier"]) for r in answers.graded(spark.createDataFrame(rows, "trace_id STRING, answer STRING, sources ARRAY<STRING>")).collect()}
    assert got == {"a": (1, 1, "limited"), "b": (3, 2, "synthesized"), "c": (0, 0, "no-sources"), "d": (0, 0, "no-sources"), "e": (0, 0, "interpretive")}


def test_prompts(spark):
    kind = "query STRING, s ARRAY<STRUCT<work: STRING, segment_id: STRING, text: STRING>>"
    df = spark.createDataFrame([("why?", [("mn1", "mn1:1.1", "One."), ("rob_1", None, "Two.")]), ("what?", []), ("who?", None)], kind)
    got = [r["m"] for r in df.select(answers.user_message(F.col("query"), F.col("s")).alias("m")).collect()]
    assert "--- Source 1 [mn1] (mn1:1.1) ---\nOne.\n\n--- Source 2 [rob_1] ---\nTwo.\n" in got[0] and got[0].startswith(answers.INTRO["mixed"]) and got[0].endswith("\nUser question: why?")
    assert got[1] == "User question: what?\n\n(No source passages were retrieved.)" and got[2].startswith("User question: who?")
    assert df.select(answers.system_prompt(F.lit("talk"), "concise").alias("p")).head()["p"].endswith(answers.GUIDANCE["concise"])
    with pytest.raises(ValueError):
        answers.system_prompt(F.lit("talk"), "odd")
