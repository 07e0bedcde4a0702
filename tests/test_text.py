import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import text as X


def one(spark, f, *values):
    names = [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} STRING" for n in names)).select(f(*map(F.col, names)).alias("x")).head()["x"]


@pytest.mark.parametrize(
    "f, given, wanted",
    [
        (X.ascii_fold, "saṃsāra saññā ŚRĪ müller café", "samsara sanna SRI müller café"),
        (X.normalise_iast, "saṁsāra Ṁ", "saṃsāra Ṃ"),
        (X.collapse_whitespace, " a\xa0b  c\t\nd ", "a b c d"),
        (X.strip_tags, "a<b>c</b> d", "a c  d"),
        (X.canonical, " &lt;foo&gt; a&amp;b\xa0" + unicodedata.normalize("NFD", "ṁ"), "a&b ṃ"),
        (X.strip_diacritics, "jhāna ёй", "jhana еи"),
        (X.casefold, "Straße", "strasse"),
        (X.has_diacritics, "jhāna", True),
        (X.has_diacritics, "jhana", False),
        (X.normalise_query, "  Saṃsāra\tIS ", "samsara is"),
        (X.normalise_query, None, ""),
        (X.tokenize, "Not-Self, 12 и Мир", ["not-self", "и", "мир"]),
        (X.token_estimate, "", 1),
        (X.token_estimate, "a b", 3),
        (X.token_estimate, "a b c d e", 6),
        (X.token_estimate, " ".join("abcdefghij"), 13),
        (X.word_tokens, "", 1),
        (X.quarter_tokens, "abc", 1),
        (X.paragraphs, "a\n\n\n b \n\nc\n", ["a", "b", "c"]),
        (X.sentences, "One. Two!  Three… four", ["One.", "Two!", "Three…", "four"]),
        (X.sentences, "none", ["none"]),
        (X.paragraph_of, "mn1:3.2", "3"),
        (X.paragraph_of, "mn-name:1.mn-x", "1"),
        (X.paragraph_of, "mn1:x.2", None),
        (X.split_meanings, "a | b;a; ", ["a", "b"]),
        (X.normalise_lemma, "dhamma 1.2", "dhamma"),
        (X.humanised_slug, "the_way-of the heart", "The Way of the Heart"),
        (X.language_code, "en", "eng"),
        (X.language_code, "xx", None),
        (X.year_of, "2020-05-01", 2020),
        (X.year_of, "", None),
    ],
)
def test_functions(spark, f, given, wanted):
    assert one(spark, f, given) == wanted


def test_snippet_and_context(spark):
    assert one(spark, lambda c: X.snippet(c, 5), "ab  cdefg") == "ab cd…"
    assert one(spark, X.prefixed_chunk, " ctx ", " body ") == "ctx\n\nbody" and one(spark, X.prefixed_chunk, "", "body") is None
    assert one(spark, X.talk_context, "Title", "", "2020", None) == 'Excerpt from a recorded dharma talk, titled "Title", recorded 2020.'


def test_citations(spark):
    df = spark.createDataFrame([("see [MN39, dn10] and [free text] [mn39] [zz1]", ["mn39", "dn10"]), (None, ["a"]), ("[a]", None)], "a STRING, s ARRAY<STRING>")
    assert [r[0] for r in df.select(X.citations(F.col("a"), F.col("s"))).collect()] == [["mn39", "dn10"], None, []]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=8))
def test_estimate_is_pythons(spark, texts):
    df = spark.createDataFrame([(i, t.replace("\x00", "")) for i, t in enumerate(texts)], "i INT, t STRING")
    got = {r["i"]: r["n"] for r in df.select("i", X.token_estimate(F.regexp_replace("t", r"[\x1c-\x1f]", "")).alias("n")).collect()}
    import re

    assert got == {i: max(1, round(len(re.sub(r"[\x00\x1c-\x1f]", "", t).split()) * 1.3)) for i, t in enumerate(texts)}


def test_cost_and_sigmoid(spark):
    r = spark.range(1).select(X.cost_usd(F.lit(1_000_000), F.lit(1_000_000), F.lit(1_000_000), F.lit(1_000_000)).alias("c"), X.sigmoid(F.lit(0.0)).alias("s")).head()
    assert abs(r["c"] - (0.8 + 4 + 1.0 + 0.08)) < 1e-9 and r["s"] == 0.5
