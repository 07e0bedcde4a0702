import re

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import evaluate, expand, fusion, lexical, library, pipeline, vector


def ranked(spark, channels):
    return {n: spark.createDataFrame([("q", d, i + 1) for i, d in enumerate(ids)], "query_id STRING, doc_id STRING, rank INT") for n, ids in channels.items()}


def test_rrf_three_channels(spark):
    ch = {"dense": ["a", "b", "c", "d", "e"], "sparse": ["f", "c", "e", "a"], "bm25": ["b", "g", "d", "h"]}
    got = fusion.rrf(ranked(spark, ch)).orderBy("rank").collect()
    score = {}
    for ids in ch.values():
        for i, d in enumerate(ids):
            score[d] = score.get(d, 0) + 1 / (61 + i)
    assert [r["doc_id"] for r in got][:3] == ["b", "a", "c"]
    assert all(abs(r["score"] - score[r["doc_id"]]) < 1e-8 for r in got)
    assert {r["doc_id"]: r["rank_sparse"] for r in got}["b"] is None


def test_rrf_repeats_ties_limits(spark):
    got = fusion.rrf(ranked(spark, {"x": ["a", "b", "a"], "y": []}), limit=2).orderBy("rank").collect()
    assert [(r["doc_id"], r["rank_x"]) for r in got] == [("a", 1), ("b", 2)] and abs(got[0]["score"] - 1 / 61) < 1e-9
    tie = fusion.rrf(ranked(spark, {"x": ["z"], "y": ["a"]})).orderBy("rank").collect()
    assert [r["doc_id"] for r in tie] == ["z", "a"]
    with pytest.raises(ValueError):
        fusion.rrf(ranked(spark, {"x": ["a"]}), k=0)


def test_boost_lifts_to_the_top(spark):
    hits = spark.createDataFrame([("q", "a", "w1", 0.045, 1), ("q", "b", "w2", 0.038, 2), ("q", "c", "w3", 0.025, 3)], "query_id STRING, doc_id STRING, work STRING, score DOUBLE, rank INT")
    got = fusion.boost(hits, spark.createDataFrame([("q", "w3", 1.5), ("q", "w3", 1.2)], "query_id STRING, work STRING, factor DOUBLE")).orderBy("rank").collect()
    assert [(r["doc_id"], round(r["score"], 4)) for r in got] == [("c", 0.0675), ("a", 0.045), ("b", 0.038)]


def test_pools_and_normalised(spark):
    assert fusion.pool_sizes(30, 8, False, True) == (100, 100) and fusion.pool_sizes(30, 8, True, False) == (30, 30) and fusion.pool_sizes(30, 8, False, False) == (30, 8)
    r = spark.range(1).select(fusion.normalised(F.lit(0.0), F.lit(1.0), F.lit(2.0)).alias("a"), fusion.normalised(F.lit(None).cast("double"), F.lit(1.0), F.lit(2.0)).alias("b"), fusion.normalised(F.lit(None).cast("double"), F.lit(1.0), F.lit(0.0)).alias("c")).head()
    assert (r["a"], r["b"], r["c"]) == (0.5, 0.5, 0.0)


def test_rerank_keeps_the_order_of_equals(spark):
    hits = spark.createDataFrame([("q", "a", 1, 0.0), ("q", "b", 2, 9.0), ("q", "c", 3, 9.0)], "query_id STRING, doc_id STRING, rank INT, s DOUBLE")
    assert [(r["doc_id"], r["rrf_rank"]) for r in fusion.rerank(hits, F.col("s"), 2).orderBy("rank").collect()] == [("b", 2), ("c", 3)]
    assert fusion.rerank(hits, F.col("s"), 0).count() == 0


def test_query_grammar(spark):
    q = asked(spark, a='walking -patience "loving kindness" or joy', b="", c="-x", d="or or", e='""', f='"open phrase', g='Saṃsāra "Life OR death"')
    got = {}
    for r in lexical.parsed(q).orderBy("query_id", "i").collect():
        got.setdefault(r["query_id"], []).append((r["clause"], r["never"], r["words"]))
    assert got == {"a": [(0, False, ["walking"]), (0, True, ["patience"]), (0, False, ["loving", "kindness"]), (1, False, ["joy"])], "c": [(0, True, ["x"])], "f": [(0, False, ["open", "phrase"])], "g": [(0, False, ["samsara"]), (0, False, ["life", "or", "death"])]}


def test_cover_density(spark):
    rows = [("one", {"a": [1, 5, 9]}, ["a"], 0.3), ("beside", {"a": [1], "b": [2]}, ["a", "b"], 0.1), ("apart", {"a": [1], "b": [4]}, ["a", "b"], 0.1 / 3), ("missing", {"a": [1]}, ["a", "b"], 0.0), ("none", {"a": [1]}, [], 0.0), ("several", {"a": [1, 6], "b": [2, 9]}, ["a", "b"], 0.1 + 0.1 / 4 + 0.1 / 3)]
    df = spark.createDataFrame(rows, "k STRING, p MAP<STRING, ARRAY<INT>>, t ARRAY<STRING>, want DOUBLE")
    for r in df.select("k", "want", lexical.cover_density(F.col("p"), F.col("t")).alias("got")).collect():
        assert abs((r["got"] or 0.0) - r["want"]) < 1e-12, r["k"]


@pytest.fixture()
def chunks(spark):
    rows = [("c1", "Craving and craving again", False, "w1"), ("c2", "walking meditation in the house", False, "w1"), ("c3", "meditation while walking; craving", False, "w2"), ("c4", "Craving craving craving", True, "w2"), ("c5", None, False, "w2"), ("c6", "saṃsāra", False, "w3")]
    return spark.createDataFrame(rows, "chunk_id STRING, text STRING, is_parent BOOLEAN, work_canonical_id STRING").withColumns({"source_type": F.lit("canonical"), "parent_chunk_id": F.when(F.col("chunk_id") == "c1", "c4"), "segment_id": F.lit("s")})


def asked(spark, **q):
    return spark.createDataFrame(list(q.items()), "query_id STRING, query STRING")


def index_of(chunks, **options):
    return lexical.build_index(chunks.where("NOT is_parent"), **options)


def test_search(spark, chunks):
    index = index_of(chunks.union(chunks))  # delivered twice
    got = {(r["query_id"], r["chunk_id"]): r["score"] for r in lexical.search(asked(spark, a="craving", b='"walking meditation"', c="walking -house", d="samsara or joy", e=" ", f="house craving", g="SAṂSĀRA"), index).collect()}
    assert got == {("a", "c1"): 0.2, ("a", "c3"): 0.1, ("b", "c2"): 0.1, ("c", "c3"): 0.1, ("d", "c6"): 0.1, ("g", "c6"): 0.1}
    assert lexical.search(asked(spark, a="craving"), index, limit=1).count() == 1
    assert lexical.search(asked(spark, a="craving"), index, kept=chunks.where("work_canonical_id = 'w2'")).count() == 1
    assert lexical.search(asked(spark, a="craving"), index, kept=chunks.where("source_type = 'talk'")).count() == 0
    assert index.docs == 4 and index.mean == (4 + 5 + 4 + 1) / 4


def test_phrases_with_or_and_marks(spark):
    rows = [("a", "saṃsāra and life or death", False), ("b", "life death", False), ("c", "or", False)]
    index = index_of(spark.createDataFrame(rows, "chunk_id STRING, text STRING, is_parent BOOLEAN"))
    got = lexical.search(asked(spark, p='"life or death"', q="saṃsāra", r="samsara", s="life or death", t='"or"', u="saṃsāra -death"), index).collect()
    assert {(r["query_id"], r["chunk_id"]) for r in got} == {("p", "a"), ("q", "a"), ("r", "a"), ("s", "a"), ("s", "b"), ("t", "a"), ("t", "c")}


def test_index_is_read_by_folders(spark, chunks, tmp_path):
    index = index_of(chunks, path=str(tmp_path / "index"), buckets=8)
    again = lexical.open_index(spark, str(tmp_path / "index"), buckets=8)
    assert again.docs == index.docs == 4
    asked_ = lexical.bounded(spark.createDataFrame([("q", "craving")], "query_id STRING, term STRING"))
    rows = again.of(asked_)
    assert sorted((r["chunk_id"], r["tf"], r["positions"]) for r in rows.collect()) == [("c1", 2, [1, 3]), ("c3", 1, [4])]
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", rows._jdf.queryExecution().executedPlan().toString())
    empty = index_of(chunks.where("false"))
    assert empty.docs == 0 and lexical.search(asked(spark, a="craving"), empty).count() == 0


def test_many_queries_take_the_other_way(spark, chunks):
    small = lexical.bounded(asked(spark, a="craving", b="house"), most=1)
    assert not getattr(small, "_bounded", False)
    assert lexical.match(small, index_of(chunks)).count() == 3


def test_dense_blocks_ties_and_empties(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [2.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0])], "doc_id LONG, vector ARRAY<DOUBLE>")
    queries = spark.createDataFrame([(10, [1.0, 0.0]), (11, [0.0, 3.0]), (12, None)], "query_id LONG, vector ARRAY<DOUBLE>")
    for options in ({"block": 1}, {}):
        got = sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in vector.dense_top_k(queries, corpus, 2, **options).collect())
        assert got == [(10, 1, 1, 1.0), (10, 2, 3, 1.0), (11, 1, 2, 1.0), (11, 2, 1, 0.0)]
    assert vector.dense_top_k(queries.where("false"), corpus, 2).count() == 0


def test_sparse(spark):
    corpus = spark.createDataFrame([("a", 111, 0.9), ("b", 222, 0.9), ("c", 111, 0.5)], "doc_id STRING, token INT, weight DOUBLE")
    q = spark.createDataFrame([("q", 111, 1.0), ("r", 333, 1.0)], "query_id STRING, token INT, q_weight DOUBLE")
    assert [(r["query_id"], r["doc_id"]) for r in vector.sparse_top_k(q, corpus, 5).orderBy("rank").collect()] == [("q", "a"), ("q", "c")]


def test_encoder(spark):
    e = vector.hashing_encoder(16)
    got = vector.encode(spark.createDataFrame([("a b",), (None,), ("",)], "t STRING"), "t", "v", e).collect()
    assert got[0]["v"] == e("a b") and got[1]["v"] is None and abs(sum(x * x for x in e("a b")) - 1) < 1e-9
    many = lambda texts: [e(t) for t in texts]
    texts = spark.createDataFrame([("a b",), (None,), ("",)], "t STRING")
    assert vector.encode(texts, "t", "v", many, batched=True).collect()[0]["v"] == e("a b")
    with pytest.raises(Exception, match="3 texts, 1 vectors|texts, 1 vectors"):
        vector.encode(texts.coalesce(1), "t", "v", lambda t: [[0.0]], batched=True).collect()


def test_hashed_vectors(spark):
    f = spark.createDataFrame([("a", "x", 2), ("a", "y", 1), ("b", "x", 1)], "id STRING, term STRING, tf INT")
    got = {r["id"]: r["vector"] for r in vector.hashed(f, "id", dim=8).collect()}
    assert all(len(v) == 8 for v in got.values()) and sum(map(abs, got["b"])) == 1.0 and sum(abs(x) for x in got["a"]) in (1.0, 3.0)


def test_points_check_their_length(spark):
    rows = spark.createDataFrame([("a", [1.0, 2.0]), ("b", None)], "chunk_id STRING, v ARRAY<DOUBLE>")
    assert vector.points(rows, "v", dim=2).count() == 2
    with pytest.raises(Exception, match="not 3 numbers"):
        vector.points(rows, "v", dim=3).collect()


ENTRIES = [(0, "satipaṭṭhāna", ["satipatthana", "four foundations of mindfulness", "сатипаттхана"], ["mn10", "dn22"], 1.5), (1, "mettā", ["loving-kindness", "goodwill"], ["snp1.8"], None), (2, "dukkha", None, ["sn56.11"], 2.0)]


@pytest.fixture()
def entries(spark):
    return spark.createDataFrame(ENTRIES, "entry INT, term STRING, aliases ARRAY<STRING>, works ARRAY<STRING>, boost DOUBLE")


def test_matches_boosts_aliases(spark, entries):
    q = asked(spark, a="What is Satipaṭṭhāna?", b="On loving-kindness and dukkha", c="unloving", d="dukkhas", e="сатипаттхана!")
    m = expand.match_terms(q, entries)
    assert sorted((r["query_id"], r["entry"]) for r in m.collect()) == [("a", 0), ("b", 1), ("b", 2), ("e", 0)]
    assert {(r["query_id"], r["work"], r["factor"]) for r in expand.work_boosts(m, entries).collect()} == {("a", "mn10", 1.5), ("a", "dn22", 1.5), ("e", "mn10", 1.5), ("e", "dn22", 1.5), ("b", "snp1.8", 1.5), ("b", "sn56.11", 2.0)}
    al = {r["query_id"]: r["aliases"] for r in expand.lexical_aliases(m, entries).collect()}
    assert al["a"] == ["four foundations of mindfulness"] and al["b"] == ["loving-kindness", "goodwill"]
    text = spark.createDataFrame([("satipaṭṭhāna", al["a"])], "q STRING, a ARRAY<STRING>").select(expand.lexical_query(F.col("q"), F.col("a")).alias("x")).head()["x"]
    assert text == 'satipaṭṭhāna or "four foundations of mindfulness"'


def test_definitional(spark, entries):
    q = asked(spark, a="What is the dukkha?", b="Что такое дуккха", c="How do I work with anger?", d="what is one two three four five six seven", e="Definition of mettā", f="satipaṭṭhāna means?")
    got = {r["query_id"]: r["query"] for r in expand.alias_sentences(q.union(asked(spark, g="What is satipaṭṭhāna?")), entries).collect()}
    assert got["a"] == "What is dukkha? Discourse on dukkha. Foundations of dukkha. Sutta on dukkha."
    assert got["b"].startswith("Что такое дуккха? Учение о дуккха.") and got["c"] == "How do I work with anger?" and got["d"].startswith("what is one")
    assert got["g"].endswith("Also known as four foundations of mindfulness.")


@pytest.fixture()
def glossary(spark):
    lemmas = spark.createDataFrame([("jhāna", ["absorption", "flame"], ["поглощение"]), ("mettā", [], None)], "lemma STRING, meanings_en ARRAY<STRING>, meanings_ru ARRAY<STRING>")
    return expand.Glossary(lemmas, spark.createDataFrame([("джхана", "jhāna")], "word STRING, lemma STRING"))


def test_glossary(spark, glossary):
    run = lambda options={}, **q: {r["query_id"]: r["query"] for r in expand.expand_glossary(asked(spark, **q), glossary, **options).collect()}  # noqa: B006, E731
    assert run(a="what is jhāna", b="джхана", c="jhana", d="jhána", e="", f="jhāna Absorption jhāna", g=None) == {
        "a": "what is jhāna absorption поглощение", "b": "джхана jhāna absorption поглощение", "c": "jhana", "d": "jhána jhāna absorption поглощение", "e": "", "f": "jhāna Absorption jhāna поглощение", "g": "",
    }
    assert run({"terms": 1}, a="mettā jhāna") == {"a": "mettā jhāna"} and run({"meanings": 0}, a="jhāna") == {"a": "jhāna"}


def corpus_of(chunks):
    index = index_of(chunks)
    dense = vector.hashed(index.postings.select(F.col("chunk_id").alias("doc_id"), "term", "tf"), "doc_id")
    return pipeline.Corpus(chunks, index, dense, pipeline.hashed_queries)


LEXICAL = {"channels": ("bm25",)}


def test_hybrid_end_to_end(spark, chunks, entries):
    corpus = corpus_of(chunks)
    hits = pipeline.hybrid(asked(spark, a="craving", b=""), corpus, pipeline.Options(boosts=False), **LEXICAL).orderBy("rank").collect()
    assert [(r["chunk_id"], r["expanded"], r["text"]) for r in hits] == [("c1", True, "Craving craving craving"), ("c3", False, "meditation while walking; craving")]
    out = pipeline.respond(pipeline.hybrid(asked(spark, a="craving"), corpus, pipeline.Options(boosts=False), **LEXICAL), spark.createDataFrame([("w2",)], "work_canonical_id STRING")).collect()
    assert [(r["work_canonical_id"], r["snippet"], r["score"]) for r in out] == [("w1", "Craving and craving again", 1.0)]
    again = pipeline.hybrid(asked(spark, a="walking meditation craving or house"), corpus, pipeline.Options(rerank=True, boosts=False, top_k=2), pair_score=fusion.overlap_score).collect()
    assert len(again) <= 2 and all(r["rerank_score"] is not None for r in again)
    with pytest.raises(ValueError):
        pipeline.hybrid(asked(spark, a="x"), corpus, pipeline.Options(rerank=True))
    assert pipeline.Options(rerank=True).version == "v2-rerank1-parents1-pali0-defn1-fnd1"


def test_threads(spark, chunks):
    seen = spark.createDataFrame([("a", "c1"), ("b", "c1"), ("b", "c3")], "query_id STRING, chunk_id STRING")
    nxt = pipeline.thread_next(asked(spark, a="craving", b="craving", c="craving"), corpus_of(chunks), seen, top_k=1, **LEXICAL)
    assert {(r["query_id"], r["chunk_id"], r["card"], r["exhausted"]) for r in nxt.collect()} == {("a", "c3", 1, False), ("b", None, None, True), ("c", "c1", 1, False)}


def test_a_long_thread_goes_on(spark):
    """Until all chunks are seen, however many those are, beside a thread that has only begun; equal queries are searched once."""
    ids = ["c%03d" % i for i in range(130)]
    rows = [(i, None, "w1", "sutta", None, False, "craving") for i in ids]
    chunks = spark.createDataFrame(rows, "chunk_id STRING, parent_chunk_id STRING, work_canonical_id STRING, source_type STRING, segment_id STRING, is_parent BOOLEAN, text STRING")
    seen = spark.createDataFrame([("a", i) for i in ids[:125]] + [("b", i) for i in ids[:128]] + [("c", ids[0])], "query_id STRING, chunk_id STRING")
    run = lambda **more: sorted((r["query_id"], r["chunk_id"], r["card"], r["exhausted"], r["text"]) for r in pipeline.thread_next(asked(spark, a="craving", b="craving", c="craving", d="craving"), corpus_of(chunks), seen, **more).collect())
    want = [(q, ids[i], n, q == "b", "craving") for q, first in (("a", 125), ("b", 128), ("c", 1), ("d", 0)) for n, i in enumerate(range(first, min(first + 3, 130)), 1)]
    assert run() == want
    assert run(known=pipeline.found(asked(spark, c="craving", d="craving"), corpus_of(chunks), pipeline.THREAD)) == want


def test_hybrid_rewrites_and_fuses_three_channels(spark, chunks, entries):
    glossary = expand.Glossary(spark.createDataFrame([("jhāna", ["walking house"], [])], "lemma STRING, meanings_en ARRAY<STRING>, meanings_ru ARRAY<STRING>"))
    assert {r["query_id"]: r["query"] for r in pipeline.rewritten(asked(spark, a="What is satipaṭṭhāna?", b="on jhāna"), pipeline.Options(glossary=True), entries, glossary).collect()} == {
        "a": "What is satipaṭṭhāna? Discourse on satipaṭṭhāna. Foundations of satipaṭṭhāna. Sutta on satipaṭṭhāna. Also known as four foundations of mindfulness.", "b": "on jhāna walking house",
    }
    assert pipeline.rewritten(asked(spark, a="What is mettā?"), pipeline.Options(definitional=False), entries).head()["query"] == "What is mettā?"
    run = lambda **q: pipeline.hybrid(asked(spark, **q), corpus_of(chunks), pipeline.Options(boosts=False, glossary=True), entries=entries, glossary=glossary).orderBy("rank").collect()
    hit = run(a="jhāna")[0]  # no chunk has the word: what it is rewritten to finds one
    assert hit["chunk_id"] == "c2" and hit["rank_dense"] == hit["rank_sparse"] == 1 and hit["rank_bm25"] is None
    assert not {r["chunk_id"] for r in run(a="craving")} & {"c4"}  # children only
    few = pipeline.hybrid(asked(spark, a="craving"), corpus_of(chunks), pipeline.Options(boosts=False, source_types=("talk",))).count()
    assert few == 0


def test_probe_and_grid(spark, chunks):
    corpus = corpus_of(chunks)
    targets = spark.createDataFrame([("a", "w2")], "query_id STRING, work STRING")
    got = pipeline.probe(asked(spark, a="craving"), corpus, targets, **LEXICAL)
    assert [(r["work"], r["chunk_id"], r["rank"], r["rank_bm25"]) for r in got.collect()] == [("w2", "c3", 2, 2)]
    assert [(r["chunk_id"], r["n_chunks"]) for r in evaluate.best_chunks(got).collect()] == [("c3", 1)]
    golden = spark.createDataFrame([("a", "craving", ["w2"], "easy", "eng"), ("b", "house", ["w9"], "hard", "eng")], "id STRING, query STRING, expected_works ARRAY<STRING>, difficulty STRING, language STRING")

    def run(options, golden):
        ranked = evaluate.best_ranks(golden, pipeline.golden_run(golden, corpus, options, **LEXICAL))
        return evaluate.summary(ranked, (1, 5)).where("grouping = 3").select("hit_1", "hit_5")

    cells = evaluate.grid(golden, [("wide", pipeline.Options(top_k=20, boosts=False)), ("one", pipeline.Options(top_k=1, boosts=False))], run)
    assert {(r["config"], r["hit_1"], r["hit_5"]) for r in cells.collect()} == {("wide", 0.0, 0.5), ("one", 0.0, 0.0)}
    assert evaluate.best_configuration(cells, "hit_5").head().asDict() == {"config": "wide", "hit_5": 0.5}
    ranked = spark.createDataFrame([("a", 1), ("b", 7), ("c", None)], "id STRING, best INT")
    assert evaluate.outcome(ranked).head().asDict() == {"n": 3, "missed": 1, "top_5": 1, "top_20": 2}
    assert {(r["id"], r["passed"]) for r in evaluate.smoke(ranked).collect()} == {("a", True), ("b", False), ("c", False)}
    with pytest.raises(ValueError):
        evaluate.grid(golden, [], run)


def test_pages(spark):
    rows = [(str(i), f"w{i}", "t", '{"date": "%s"}' % d, "talk" if i % 2 else "canonical") for i, d in enumerate(["2020", "", "2021", "2019"])]
    w = spark.createDataFrame(rows, "id STRING, canonical_id STRING, title STRING, metadata_json STRING, source_type STRING")
    assert [(r["canonical_id"], r["total"]) for r in library.page(w, 2, 1).collect()] == [("w0", 4), ("w3", 4)]
    assert [r["canonical_id"] for r in library.page(w, 9, 0, "talk").collect()] == ["w3", "w1"]
    with pytest.raises(ValueError):
        library.page(w, 0)
