import random

import pytest
from tokenizers import Tokenizer

from corpusloom.llm import tokenizing as K


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(K.VOCABULARY)
    t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def texts():
    rnd = random.Random(4)
    out = [None, "", " ", "\n\n\t ", "<|endoftext|> x", "a" * 700, " " * 400, "日本語" * 80, "I'VE don't 's 'll", "1234567890123", "é́̂ ẹ", "\U0001f600‍\U0001f468", "Старый монах измеряет.", "saṃsāra"]
    ranges = [(32, 127), (0xA0, 0x2FF), (0x400, 0x460), (0x4E00, 0x4F00), (0x1F300, 0x1F600), (0x300, 0x340)]
    for _ in range(1500):
        out.append("".join(chr(rnd.randrange(*rnd.choice(ranges))) for _ in range(rnd.randrange(1, 50))))
    out += [" ".join("".join(rnd.choice("etaoinshr") for _ in range(rnd.randint(1, 14))) for _ in range(9)) for _ in range(500)]
    return out


def test_ids_equal_the_library(reference):
    e = K.TrieEncoder(K.read_vocabulary())
    offsets, ids = e.encode(texts())
    assert [ids[a:z].tolist() for a, z in zip(offsets, offsets[1:])] == reference(texts())


def test_slices_of_long_texts_change_nothing(reference, monkeypatch):
    monkeypatch.setattr(K, "SLICE", 50)
    rnd = random.Random(6)
    t = "".join(rnd.choice(["word", "  ", "\n", "слово", " ", "!!", "12", "\n \n", "x" * 70]) for _ in range(900))
    e = K.TrieEncoder(K.read_vocabulary())
    assert e.encode([t])[1].tolist() == reference([t])[0]


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(K, "REMEMBERED", 3)
    e = K.TrieEncoder(K.read_vocabulary())
    a = [e.encode([t])[1].tolist() for t in ("one two three four five", "one six", "one two")]
    assert a[2] == e.encode(["one two"])[1].tolist() and len(e.known) < 10


def test_rows_of_every_kind(spark, reference):
    rows = [(1, "a b"), (2, None), (3, ""), (4, " "), (1, "a b"), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING").selectExpr("*", "7 AS ids", "8 AS n_tokens")
    got = K.encode_corpus(df).collect()
    assert sorted((r["doc_id"] or 0, r["ids"]) for r in got) == sorted((i or 0, ids) for (i, _), ids in zip(rows, reference([t for _, t in rows])))
    assert [f.name for f in K.encode_corpus(df).schema] == ["doc_id", "ids"]
    assert K.encode_corpus(df.where("false")).count() == 0
    counts = {r["doc_id"]: r["n_tokens"] for r in K.count_tokens(df, ["doc_id"]).collect()}
    assert counts[2] == 0 and counts[3] == 0 and counts[1] == 2
