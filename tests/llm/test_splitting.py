import random

import pyarrow as pa
import pytest

from corpusloom.llm import splitting as S


def texts():
    rnd = random.Random(3)
    blanks = [" ", "  ", "\n", "\n\n", "\t", "\xa0", "　", " ", ". ", "! ", "。", "… "]
    out = [None, "", " ", "a", "　", "x" * 9000, "字" * 5000, "字句。" * 2000, "w " * 700]
    for _ in range(60):
        out.append("".join(rnd.choice(["слово", "word", "词", "é"]) + rnd.choice(blanks) for _ in range(rnd.randint(1, 900))))
    return out


@pytest.mark.parametrize("step", [5, 64, 1 << 20])
def test_ranges_count_as_python_does(step):
    for column in (pa.array(texts()), pa.array(texts()[3:]).slice(2), pa.array(texts(), pa.large_string())):
        words, chars = S.range_counts(*S._buffers(column), step=step)
        assert words.tolist() == [len((t or "").split()) for t in column.to_pylist()]
        assert chars.tolist() == [len(t or "") for t in column.to_pylist()]


@pytest.mark.parametrize("limits", [S.Limits(512, 4000), S.Limits(120, 500), S.Limits(2048, 16000)])
def test_pieces_are_within_limits_and_whole(limits):
    for t in texts():
        if not t or not t.strip():
            continue
        parts = S.cut(S.table_of(t), limits)
        assert parts[0][0] == 0 and parts[-1][1] == len(t)
        for k, (a, z, new) in enumerate(parts):
            assert z - a <= limits.chars and max(1, round(1.3 * len(t[a:z].split()))) <= limits.tokens
            if k:
                assert a < new == parts[k - 1][1] < z


def test_overlap_is_forty_words_or_sixty_characters():
    t = " ".join(f"word{i}" for i in range(1500))
    parts = S.cut(S.table_of(t), S.CHILD)
    assert all(len(t[a:new].split()) == 40 for a, z, new in parts[1:]) and len(parts) > 3
    t = "字" * 9000
    assert all(new - a == 60 for a, z, new in S.cut(S.table_of(t), S.CHILD)[1:])


def test_cuts_come_at_the_highest_ends():
    part = "one two three four five six seven eight nine ten. "
    t = (part * 30 + "\n\n") * 3
    assert all(t[:z].rstrip(" ").endswith(("\n", ".")) for _, z, _ in S.cut(S.table_of(t), S.CHILD))
    assert t[S.cut(S.table_of(t), S.CHILD)[0][1] :].startswith((" \n\n", "\n\n"))


@pytest.mark.parametrize("n, over", [(394, False), (395, True)])
def test_limit_in_words(spark, n, over):
    df = spark.createDataFrame([("a", False, " ".join(["w"] * n))], "id STRING, is_parent BOOLEAN, text STRING")
    assert S.measure(df, "id", "text", "is_parent").head()["oversize"] is over


def test_rows_of_every_kind(spark):
    rows = [("a", False, "x" * 4001, ["s1"]), ("b", True, "x" * 4001, ["s1"]), ("c", None, "x" * 4001, None), ("d", False, None, None), ("e", False, "", []), ("a", False, "x" * 4001, ["s1"])]
    df = spark.createDataFrame(rows, "id STRING, is_parent BOOLEAN, text STRING, segment_ids ARRAY<STRING>").selectExpr("*", "1 AS piece", "2 AS n_chars")
    got = S.measure(df, "id", "text", "is_parent").where("oversize").collect()
    assert sorted(r["id"] for r in got) == ["a", "a", "c"]
    out = S.pieces(df).where("id = 'c'").collect()
    assert [r["piece_segment_ids"] for r in out] == [None, None] and out[1]["piece_start"] == 3940
    assert S.pieces(df.where("false")).count() == 0 and S.measure(df.where("false"), "id", "text", "is_parent").count() == 0


def test_segments_of_pieces():
    t = "".join(f"Sentence number {i} is here. " for i in range(200))
    ids = [f"s{i}" for i in range(200)]
    parts = S.cut(S.table_of(t), S.CHILD, len(ids))
    seen = [S.covered(S.table_of(t), ids, [(a, z)])[0] for a, z, _ in parts]
    assert seen[0][0] == "s0" and seen[-1][-1] == "s199" and {x for s in seen for x in s} == set(ids)


def test_giant_files_by_ranges(spark, tmp_path):
    rnd = random.Random(1)
    t = "".join(rnd.choice(["слово ", "word ", "句子。", "end. ", "line\n", "para\n\n", "nospace"]) for _ in range(6000))
    path = tmp_path / "giant.txt"
    path.write_bytes(t.encode())
    rows = sorted(S.file_pieces(spark, [(str(path), path.stat().st_size)], most_chars=1000, step=1777).collect(), key=lambda r: r["byte_start"])
    data = t.encode()
    assert rows[0]["byte_start"] == 0 and rows[-1]["byte_end"] == len(data)
    assert all(a["byte_end"] == b["byte_start"] for a, b in zip(rows, rows[1:]))
    assert all(r["char_end"] - r["char_start"] <= 1000 and len(data[r["byte_start"] : r["byte_end"]].decode()) == r["char_end"] - r["char_start"] for r in rows)


@pytest.mark.parametrize("kind, step", [("words", 3001), ("words", 1 << 20), ("tight", 4001), ("mixed", 2503), ("solid", 5000)])
def test_giant_files_overlap_within_both_limits(spark, tmp_path, kind, step):
    rnd = random.Random(5)
    units = {"words": ["a ", "to ", "слово ", "end. ", "line\n"], "tight": ["这是一个句子。", "另外一个问题！", "他说「好。」"], "mixed": ["word ", "句子。", "longerword ", "para\n\n", "\u3000"], "solid": ["é", "字"]}[kind]
    t = "".join(rnd.choice(units) for _ in range(9000))
    data, path = t.encode(), tmp_path / "giant.txt"
    path.write_bytes(data)
    limits = S.Limits(120, 700)
    rows = sorted(S.file_pieces(spark, [(str(path), len(data))], limits.chars, most_tokens=limits.tokens, step=step).collect(), key=lambda r: r["piece"])
    assert [r["piece"] for r in rows] == list(range(len(rows))) and rows[0]["overlap_byte_start"] == 0 and rows[-1]["byte_end"] == len(data)
    for k, r in enumerate(rows):
        whole, old = data[r["overlap_byte_start"] : r["byte_end"]].decode(), data[r["overlap_byte_start"] : r["byte_start"]].decode()
        assert whole == t[r["overlap_char_start"] : r["char_end"]] and old == t[r["overlap_char_start"] : r["char_start"]]
        assert len(whole) <= limits.chars and max(1, round(1.3 * len(whole.split()))) <= limits.tokens
        if k:
            assert r["byte_start"] == rows[k - 1]["byte_end"] and (len(old.split()) == S.OVERLAP_WORDS or len(old) == S.OVERLAP_CHARS)
    if kind == "tight":
        assert all(t[: r["char_end"]].endswith(("。", "！", "」")) for r in rows)


def test_empty_and_blank_files(spark, tmp_path):
    for n, text in enumerate(["", " " * 5000]):
        path = tmp_path / f"{n}.txt"
        path.write_text(text)
        rows = sorted(S.file_pieces(spark, [(str(path), len(text))], 700, step=900).collect(), key=lambda r: r["piece"])
        assert rows[0]["byte_start"] == 0 and rows[-1]["byte_end"] == len(text) and all(a["byte_end"] == b["byte_start"] for a, b in zip(rows, rows[1:]))


@pytest.mark.parametrize("step", [7, 16, 33])
def test_tables_of_ranges_are_stitched(step):
    rnd = random.Random(step)
    alphabet = ["a", "bc", " ", "\n", "\n\n", ".", "! ", "…", "。", "！", "”", ")", '"', "中", "é", "\u3000", "x" * 30, "𝔘"]
    for _ in range(300):
        t = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60)))
        whole, parts = S.table_of(t), S.table_of(t, step)
        assert whole.n == parts.n == len(t)
        assert all((a == b).all() for a, b in zip((whole.starts, whole.ends, whole.level, whole.number), (parts.starts, parts.ends, parts.level, parts.number)))


def test_segments_of_many_pieces_take_one_pass():
    t = " ".join(f"word{i}." if i % 9 == 0 else "word" for i in range(20_000))
    table = S.table_of(t)
    parts = S.cut(table, S.CHILD)
    ids = [f"s{i}" for i in range(40)]
    held = S.covered(table, ids, [(a, z) for a, z, _ in parts])
    assert held[0][0] == "s0" and held[-1][-1] == "s39" and all(held)
