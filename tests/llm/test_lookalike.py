import unicodedata

import duckdb
import pytest

from corpusloom.llm import lookalike as K


def form(*texts):
    import pyarrow as pa

    con = duckdb.connect()
    con.register("batch", pa.table({"k": list(range(len(texts))), "t": pa.array(texts, pa.string())}))
    got = dict(con.sql(K.batch_sql("batch")).fetchall())
    return [got[i] for i in range(len(texts))]


@pytest.mark.parametrize(
    "a, b",
    [
        ("ＡＢＣ　１２３！", "ABC 123!"),
        (unicodedata.normalize("NFD", "saṃsāra é ß"), "saṃsāra é ß"),
        ("a​b﻿c⁠d­e", "abcde"),
        ("ā͏̣", "ạ̄"),
        ("  one two \tthree　", "one two three"),
        ("ѕсrірt of ореn", "script of open"),
        ("coceд дoмa", "сосед дома"),
        ("La disciple attentive", "La diѕciрlе аttеntive"),
        ("eﬃcient ﬁrst", "efficient first"),
        ("ΑΒ νο", "AB vo"),
        (unicodedata.normalize("NFD", "ёж й ї"), "ёж й ї"),
        ("non‑breaking", "non-breaking"),
    ],
)
def test_same_to_the_eye(a, b):
    x, y = form(a, b)
    assert x == y


@pytest.mark.parametrize("a, b", [("ṁ", "ṃ"), ("a", "ā"), ("A", "a"), ("end.", "end!"), ("е", "ё"), ("a b", "ab"), ("1", "l"), ("o", "0"), ("it's", "it’s"), ("и", "й")])
def test_different_to_the_eye(a, b):
    x, y = form(a, b)
    assert x != y


def test_form_is_stable_and_reads_in_its_script():
    texts = ["упрямый торговец", "ycтaлый cтpaнник", "a о", "он и она", None, "", "​ ", "Ёлка х2"]
    once = form(*texts)
    assert form(*once) == once
    assert once[1] == "усталый странник" and once[3] == "он и она" and once[4] is None and once[5] == "" and once[6] == ""


def test_pairs(spark):
    rows = [("s", 1, "abc"), ("s", 2, "ａbc"), ("s", 3, "abc"), ("s", 4, " abc"), ("s", 5, "abd"), ("g", 1, "abc"), ("g", 2, "a​bc"), ("s", 6, None), ("s", 7, ""), ("s", 8, " "), ("s", 9, "　")]
    df = spark.createDataFrame(rows, "src STRING, id LONG, text STRING").selectExpr("*", "1 AS t", "2 AS f", "3 AS form")
    got = [tuple(r) for r in K.lookalike_pairs(df).collect()]
    assert sorted(got) == [("g", 1, 2), ("s", 1, 2), ("s", 1, 4), ("s", 2, 3), ("s", 2, 4), ("s", 3, 4)]
    assert K.lookalike_pairs(df.where("false")).count() == 0


def test_hot_form_equals_brute_force(spark):
    import random

    rnd = random.Random(2)
    variants = ["evaṃ me", "evaṃ  me", "evaṃ me ", "ｅvaṃ me", "evaṁ me"]
    rows = [("s", i, rnd.choice(variants) if rnd.random() < 0.6 else f"text {rnd.randint(1, 9)}") for i in range(300)]
    forms = form(*[r[2] for r in rows])
    want = {("s", a, b) for a in range(300) for b in range(a + 1, 300) if forms[a] == forms[b] and rows[a][2] != rows[b][2]}
    got = [tuple(r) for r in K.lookalike_pairs(spark.createDataFrame(rows, "src STRING, id LONG, text STRING")).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_long_text():
    t = "ａ " * 200_000
    assert form(t) == [("a " * 200_000).strip()]


def test_classes_hold_the_rows_of_the_pairs(spark):
    rows = [("s", 1, "a b"), ("s", 2, "a\u00a0b"), ("s", 3, "a b"), ("s", 4, "other"), ("t", 5, "a\u2003b"), ("s", 6, None), ("s", 7, "ｶﾞ"), ("s", 8, "ガ"), ("s", 9, "x²"), ("s", 10, "x2")]
    df = spark.createDataFrame(rows, "src STRING, id LONG, text STRING")
    classes = {}
    for r in K.form_classes(df).collect():
        classes.setdefault(r["class"], set()).add(r["id"])
    assert sorted(map(sorted, classes.values())) == [[1, 2, 3], [7, 8]]
    assert {tuple(r)[1:] for r in K.lookalike_pairs(df).collect()} == {(1, 2), (2, 3), (7, 8)}
