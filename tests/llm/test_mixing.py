import numpy as np
import pytest

from corpusloom.llm import mixing as K


def test_full_sources_leave_their_part_to_the_others():
    got = K.source_totals({"a": 0.5, "b": 0.3, "c": 0.2, "none": 0.1}, {"a": 1000, "b": 30, "c": 1000}, 700)
    assert got["b"] == 30 and abs(got["a"] / got["c"] - 2.5) < 1e-9 and abs(sum(got.values()) - 700) < 1e-6
    assert K.source_totals({"a": 1.0}, {"a": 5}, 100) == {"a": 5.0}
    assert K.source_totals({}, {}, 100) == {}


def test_rake_meets_sources_and_stays_within_what_there_is():
    rng = np.random.default_rng(3)
    cells = [(s, lang, t, float(rng.integers(50, 500))) for s in "ab" for lang in ("eng", "rus") for t in ("x", "y")]
    totals = {"a": 300.0, "b": 900.0}
    w = K.rake(cells, {"a": 1, "b": 2}, totals)
    for s in "ab":
        assert abs(sum(x for c, x in zip(cells, w) if c[0] == s) - totals[s]) < 1e-3
    assert all(x <= c[3] * {"a": 1, "b": 2}[c[0]] + 1e-6 for c, x in zip(cells, w))
    # Language and topic come as near to the documents' own as the sources allow: the independent solution is a fixed point.
    even = [(s, lang, "x", 100.0) for s in "ab" for lang in ("eng", "rus")]
    assert np.allclose(K.rake(even, {"a": 9, "b": 9}, {"a": 100.0, "b": 300.0}), [50, 50, 150, 150])


SIZES = "doc_id LONG, source STRING, language STRING, topic STRING, n_tokens LONG"
TARGETS = "source STRING, target_share DOUBLE, max_repeats INT"


@pytest.fixture(scope="module")
def sizes(spark):
    rng = np.random.default_rng(5)
    rows = [(i, ["a", "a", "a", "a", "b", "c", None, "web"][i % 8], ["eng", "rus"][i % 2], ["x", "y"][i % 3 % 2], int(rng.integers(0, 400))) for i in range(4000)]
    return spark.createDataFrame(rows, SIZES)


def test_shares_are_met_and_repeats_kept(spark, sizes):
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.5, 2), ("c", 0.1, 4), ("none", 0.1, 4)], TARGETS)
    mix = K.draw(sizes, targets, total=200_000)
    rows = mix.collect()
    assert {r["source"] for r in rows} == {"a", "b", "c"} and all(1 <= r["uses"] <= {"a": 1, "b": 2, "c": 4}[r["source"]] for r in rows)
    whole = sum(r["n_tokens"] * r["uses"] for r in rows)
    assert abs(whole / 200_000 - 1) < 0.02
    report = {r["source"]: r for r in K.shares(sizes, targets, mix).collect()}
    # b holds 2 x 100 000 at most, so a, b and c keep the proportion 3 : 5 : 1.
    for s, share in (("a", 3 / 9), ("b", 5 / 9), ("c", 1 / 9)):
        assert abs(report[s]["reached_share"] - share) < 0.005
    assert report["none"]["reached_share"] == 0 and report["web"]["target_share"] == 0 and None in report


def test_same_seed_same_mix_and_other_blocks_same_size(spark, sizes, monkeypatch):
    targets = spark.createDataFrame([("a", 0.6, 1), ("b", 0.4, 2)], TARGETS)
    one = {tuple(r) for r in K.draw(sizes, targets, 90_000).collect()}
    assert one == {tuple(r) for r in K.draw(sizes.repartition(7), targets, 90_000).collect()}
    monkeypatch.setattr(K, "BLOCK", 50)
    many = {tuple(r) for r in K.draw(sizes, targets, 90_000).collect()}
    assert abs(sum(r[2] * r[3] for r in many) / sum(r[2] * r[3] for r in one) - 1) < 0.02


def test_rows_of_every_kind(spark):
    docs = spark.createDataFrame([(1, "a", "en", "x", "one two three"), (2, None, None, None, "b"), (3, "a", None, None, None), (4, "a", "xx", "", ""), (5, "a", "ru", "x", "four five six")], "doc_id LONG, source STRING, lang STRING, tradition_code STRING, text STRING").selectExpr("*", "1 AS uses", "2 AS n_tokens", "3 AS rate")
    targets = spark.createDataFrame([("a", 1.0, 2), ("a", 0.5, 9), (None, 0.1, 1)], TARGETS)
    mix, report = K.mix_of(docs, targets, total=12)
    assert {(r["doc_id"], r["uses"]) for r in mix.collect()} == {(1, 2), (5, 2)}
    assert {r["source"]: r["drawn_tokens"] for r in report.collect()}["a"] == 12
    empty, report = K.mix_of(docs.where("false"), targets)
    assert empty.count() == 0 and report.count() >= 1


def test_long_documents_do_not_make_a_source_miss_its_total(spark):
    rows = [(i, "ab"[i % 2], "eng" if i % 3 else "rus", "x", 4000 if i % 40 < 2 else 20 + i % 50) for i in range(1200)]
    sizes = spark.createDataFrame(rows, "doc_id LONG, source STRING, language STRING, topic STRING, n_tokens LONG")
    targets = spark.createDataFrame([("a", 0.25, 1), ("b", 0.75, 2)], TARGETS)
    mix = K.draw(sizes, targets, total=100_000).collect()
    for s, want in (("a", 25_000), ("b", 75_000)):
        assert abs(sum(r["n_tokens"] * r["uses"] for r in mix if r["source"] == s) - want) <= 70
    assert all(1 <= r["uses"] <= {"a": 1, "b": 2}[r["source"]] for r in mix)
