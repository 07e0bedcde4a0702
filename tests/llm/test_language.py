import pytest

from corpusloom.llm import language as L

MODEL = L.Languages(L.training_texts({}))


@pytest.mark.parametrize(
    "label, code",
    [("en", "eng"), ("EN", "eng"), ("eng", "eng"), ("en-GB", "eng"), ("zh-Hans", "zho"), ("pi_01", "pli"), ("English", "eng"), ("german ", "deu"), ("ger", "deu"), ("mul", None), ("und", None), ("", None), (None, None), ("?", None), ("unknown", None)],
)
def test_labels(label, code):
    assert L.label_code(label) == code


def test_label_column_agrees(spark):
    from pyspark.sql import functions as F

    labels = ["en", "EN", "en-GB", "zh-Hans", "pi_01", "English", "german ", "ger", "mul", "", None, "?", "fra "]
    got = spark.createDataFrame([(x,) for x in labels], "x STRING").select("x", L.label_column(F.col("x")).alias("c")).collect()
    assert [(r["x"], r["c"]) for r in got] == [(x, L.label_code(x)) for x in labels]


@pytest.mark.parametrize(
    "text, code",
    [
        ("Where do the people live who want to learn this?", "eng"),
        ("Почему старик и ребёнок пошли в дом у реки?", "rus"),
        ("Pochemu starik i rebenok poshli v dom u reki?", "rus"),
        ("Warum gingen der alte Mann und das Kind zum Haus?", "deu"),
        ("Dlaczego stary czlowiek i dziecko poszli do domu nad rzeka?", "pol"),
        ("为什么这两者之间有关系？", "zho"),
        ("ここはどこですか、わたしの家です", "jpn"),
        ("여기는 어디입니까 집입니다", "kor"),
    ],
)
def test_languages(text, code):
    parts = [p for _, _, p in L.stretches(text)]
    assert [MODEL.decide(p)[0] for p in parts] == [code]
    assert all(0.5 < MODEL.decide(p)[1] <= 1 for p in parts)


def test_held_out_accuracy():
    held = {"eng": ["The man wants to know where the child went when it was there"], "fra": ["Le vieil homme voudrait savoir pourquoi personne n'est venu"], "spa": ["El niño quisiera saber por qué nadie estaba en la casa"], "nld": ["De man zou graag willen weten waar het kind naar toe ging"], "ita": ["Il bambino vorrebbe sapere perché nessuno è venuto alla casa"], "por": ["A criança gostaria de saber por que ninguém estava na casa"]}
    right = sum(MODEL.decide(t)[0] == c for c, ts in held.items() for t in ts)
    assert right >= 5


def test_stretches_leave_out_asides_and_short_terms():
    assert [p for _, _, p in L.stretches("What is generosity here? (mettā bhāvanā auf Pali) dukkha")] == ["What is generosity here"]
    assert list(L.stretches("... 12.4 —")) == [] and list(L.stretches("")) == []


def test_automaton_holds_all_substrings():
    a = L.SuffixAutomaton("abcabxabcd")
    assert a.phrases("abcab", 99) == 1 and a.phrases("xabcd", 99) == 1 and a.phrases("abcdx", 99) == 2 and a.phrases("zz", 99) == 2


def test_wrong_labels_are_left_out():
    good = [f"The old man number {w} wants to know where the river is and who lives there" for w in "one two three four five six seven eight nine ten".split()]
    sample = {"eng": good * 3, "fra": ["Le vieil homme et l'enfant sont allés près du fleuve aujourd'hui", good[0], good[1]]}
    texts = L.training_texts(sample)
    assert "old man number one" not in texts["fra"] and "old man number three" in texts["eng"]


def test_mixed_rows_nulls_and_repeats(spark):
    rows = [("a", "What is the meaning of this? Warum ist das so wichtig für die Menschen?"), ("b", None), ("c", ""), ("d", "???"), ("a", "What is the meaning of this? Warum ist das so wichtig für die Menschen?")]
    df = spark.createDataFrame(rows, "k STRING, t STRING").selectExpr("*", "1 AS start", "'x' AS language")
    got = L.identify(df, L.training_texts({}), ["k"], "t").collect()
    assert sorted((r["k"], r["language"]) for r in got) == [("a", "deu"), ("a", "deu"), ("a", "eng"), ("a", "eng")]
    assert L.identify(df.where("false"), L.training_texts({}), ["k"], "t").count() == 0


def test_sample_is_bounded_and_votes(spark):
    rows = [(f"sentence number {i} in a row", "eng") for i in range(50)] + [("sentence number 1 in a row", "eng"), ("sentence number 1 in a row", "fra"), (None, "eng"), ("long enough text", None)]
    got = L.labelled_sample(spark.createDataFrame(rows, "text STRING, code STRING"), 10)
    assert len(got["eng"]) == 10 and "fra" not in got


def test_slices_change_no_sum():
    import numpy as np

    from corpusloom.llm.ngrams import NaiveBayes

    b = NaiveBayes.fit({"eng": ["the old man and the river"], "deu": ["der alte mann und der fluss"]})
    texts = ["the man", "", "der fluss und " * 40, "x"]
    assert np.allclose(b.sums(texts), b.sums(texts, step=7), atol=1e-3)
    assert b.classes[int(b.posteriors(["the river and the man"])[0].argmax())] == "eng"
