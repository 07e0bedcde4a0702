import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import spans
from corpusloom.llm.fmindex import FMIndex

SCHEMA = "id STRING, level BOOLEAN, text STRING"


def brute(rows, least):
    """Maximal stretches of characters in runs that another record of the level has, window by window."""
    texts = {(i, lv): t for i, lv, t in rows if i and t}
    out = set()
    for (i, lv), t in texts.items():
        held = set()
        for a in range(len(t) - least + 1):
            if any(j != i and l2 == lv and t[a : a + least] in u for (j, l2), u in texts.items()):
                held.update(range(a, a + least))
        at = sorted(held)
        for k, p in enumerate(at):
            if k == 0 or at[k - 1] != p - 1:
                start = p
            if k == len(at) - 1 or at[k + 1] != p + 1:
                out.add((i, start, p + 1))
    return out


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    return {tuple(r) for r in spans.shared_spans(df, **options).collect()}


def corpus(seed, n=40):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeёжз中文") for _ in range(rnd.randint(2, 6))) for _ in range(60)]
    passages = [" ".join(rnd.choice(words) for _ in range(rnd.randint(8, 25))) for _ in range(8)]
    rows = []
    for k in range(n):
        parts = [rnd.choice(passages) if rnd.random() < 0.4 else " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 12))) for _ in range(rnd.randint(1, 6))]
        rows.append((f"r{k}", rnd.random() < 0.3, " ".join(parts)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_spans_equal_brute_force(spark, seed):
    rows = corpus(seed)
    assert found(spark, rows, least=40, k=12, shard_chars=2000) == brute(rows, 40)


@pytest.mark.parametrize("hot", [100, 400])
def test_minimizers_with_too_many_strings_are_taken_apart(spark, hot):
    rows = corpus(3, 25)
    assert found(spark, rows, least=40, k=12, hot_chars=hot) == brute(rows, 40)


def test_long_runs_are_compared_to_their_end(spark):
    rnd = random.Random(11)
    stem = "".join(rnd.choice("ab") for _ in range(700))
    # Equal for 600 characters and more, and for 560 only: what differs lies behind the 512th.
    rows = [("a", False, stem + "x"), ("b", False, "y" + stem), ("c", False, stem[:560] + "zz" + stem[570:]), ("d", False, "q" + stem[100:])]
    assert found(spark, rows, least=591, k=64) == brute(rows, 591)
    index = FMIndex([stem[:590] + "1", stem[:590] + "2"], np.array([0, 1]))
    assert not len(index.shared(np.arange(2), 591)[0])
    assert len(index.shared(np.arange(2), 590)[0]) == 2


def test_nulls_repeats_short_and_repetition_within_one_record(spark):
    p = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(90))
    rows = [("a", False, p + "x" + p), ("a", False, p + "x" + p), ("b", True, p), (None, False, p), ("c", False, None), ("d", False, ""), ("e", False, "short"), ("f", None, "0" * 300)]
    assert found(spark, rows, least=50, k=10) == {r for r in brute([r for r in rows if r[0] and r[2]], 50)}
    assert found(spark, rows + [("g", False, "?" + p)], least=50, k=10) >= {("a", 0, 90), ("a", 91, 181), ("g", 1, 91)}
    assert found(spark, [], least=50, k=10) == set()


def test_coverage_counts_shared_characters(spark):
    p = "".join(chr(97 + (i * 5 + i // 9) % 26) for i in range(60))
    df = spark.createDataFrame([("a", False, p + "zz"), ("b", False, "y" + p), ("c", False, None)], SCHEMA)
    got = {r["id"]: (r["n_chars"], r["shared_chars"], round(r["shared_share"], 3)) for r in spans.coverage(df, spans.shared_spans(df, least=50, k=10)).collect()}
    assert got == {"a": (62, 60, 0.968), "b": (61, 60, 0.984), "c": (0, 0, 0.0)}


def test_long_texts_are_taken_in_slices(monkeypatch):
    monkeypatch.setattr(spans, "AT_ONCE", 500)
    rnd = random.Random(5)
    t = "".join(rnd.choice("abcd") for _ in range(3000))
    own, start, length, h = spans.runs_of_texts([t], 60, 16)
    windows = {(s + i, int(x)) for s, n, x in zip(start, length, h) for i in range(n - 59)}
    monkeypatch.setattr(spans, "AT_ONCE", 1 << 20)
    own, start, length, h = spans.runs_of_texts([t], 60, 16)
    assert windows == {(s + i, int(x)) for s, n, x in zip(start, length, h) for i in range(n - 59)}
    assert len({p for p, _ in windows}) == 3000 - 59


def test_index_finds_what_other_owners_share():
    rnd = random.Random(7)
    for _ in range(60):
        base = ["".join(rnd.choice("abc") for _ in range(rnd.randint(1, 9))) for _ in range(3)]
        strings = list(dict.fromkeys("".join(rnd.choice(base) for _ in range(3)) for _ in range(rnd.randint(1, 8))))
        owner = np.array([rnd.randint(0, 3) if rnd.random() < 0.8 else -1 for i in range(len(strings))], np.int64)
        which, a, z = FMIndex(strings, owner).shared(np.arange(len(strings)), 4)
        got = {(i, p) for i, s, e in zip(which.tolist(), a, z) for p in range(s, e)}
        want = {(i, p) for i, s in enumerate(strings) for at in range(len(s) - 3) if any((owner[i] < 0 or owner[j] != owner[i]) and s[at : at + 4] in t for j, t in enumerate(strings)) for p in range(at, at + 4)}
        assert got == want


def test_extra_columns_with_clashing_names_are_ignored(spark):
    p = "".join(chr(97 + (i * 5 + i // 9) % 26) for i in range(60))
    df = spark.createDataFrame([("a", False, p), ("b", False, p)], SCHEMA).withColumns({"h": F.lit(1), "rec": F.lit("x"), "start": F.lit(2)})
    assert spans.shared_spans(df.select("id", "level", "text"), least=50, k=10).count() == 2
    assert spans.shared_spans(df, least=50, k=10).count() == 2
