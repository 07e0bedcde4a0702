import json

import pytest

from corpusloom.functions.register import register
from corpusloom.operators import ingest
from corpusloom.plans import requests
from corpusloom.sources import files


def tree(tmp_path, **texts):
    root = tmp_path / "translation/en/someone/sutta/mn"
    root.mkdir(parents=True, exist_ok=True)
    for uid, lines in texts.items():
        (root / f"{uid}_translation-en-someone.json").write_text(json.dumps({f"{uid}:{i + 1}.1": t for i, t in enumerate(lines)}))
    return str(tmp_path)


LANGUAGES = [("eng",), ("rus",)]


def test_files_are_loaded_once(spark, tmp_path):
    langs = spark.createDataFrame(LANGUAGES, "code STRING")
    none = spark.createDataFrame([], "content_hash STRING")
    root = tree(tmp_path, mn1=["The <b>root</b>&nbsp;of all", " ", "things"], mn2=["Another text"])
    got = ingest.load_segments(spark, root, none, langs)
    assert got.counts == {"files": 2, "loaded": 2, "skipped": 0}
    chunks = got.chunks.orderBy("instance_id", "sequence").collect()
    assert {(r["is_parent"], r["text"]) for r in chunks} == {(True, "The root of all things"), (False, "The root of all things"), (True, "Another text"), (False, "Another text")}
    ids = {r["id"] for r in chunks}
    assert all(r["parent_chunk_id"] in ids for r in chunks if not r["is_parent"]) and len(ids) == 4
    again = ingest.load_segments(spark, root, got.instances, langs)
    assert again.counts["loaded"] == 0 and again.chunks.count() == 0
    tree(tmp_path, mn1=["Changed"])
    more = ingest.load_segments(spark, root, none, langs, works=got.works)
    assert more.works.count() == 0 and more.expressions.count() == 2


def test_unknown_language_stops_the_load(spark, tmp_path):
    root = tree(tmp_path, mn1=["x"])
    with pytest.raises(ValueError):
        ingest.load_segments(spark, root, spark.createDataFrame([], "content_hash STRING"), spark.createDataFrame([("rus",)], "code STRING"))


def test_two_translations_keep_their_titles(spark, tmp_path):
    for lang, author, title in (("en", "one", "The Root"), ("de", "two", "Wurzel aller Dinge")):
        at = tmp_path / f"translation/{lang}/{author}/sutta/mn"
        at.mkdir(parents=True)
        (at / f"mn1_translation-{lang}-{author}.json").write_text(json.dumps({"mn1:0.2": title, "mn1:1.1": "text"}))
    at = tmp_path / "root/pli/ms/sutta/mn"
    at.mkdir(parents=True)
    (at / "mn1_root-pli-ms.json").write_text(json.dumps({"mn1:0.1": "Majjhima", "mn1:0.2": " Mūlapariyāya "}))
    (tmp_path / "mn1_comment-en-one.json").write_text("{}")
    got = ingest.load_segments(spark, str(tmp_path), spark.createDataFrame([], "content_hash STRING"), spark.createDataFrame([("eng",), ("deu",)], "code STRING"))
    assert {r["title"] for r in got.expressions.collect()} == {"The Root", "Wurzel aller Dinge"}
    assert [r["title_pali"] for r in got.works.collect()] == ["Mūlapariyāya"]
    with pytest.raises(LookupError):
        ingest.load_segments(spark, str(tmp_path), spark.createDataFrame([], "content_hash STRING"), spark.createDataFrame([("eng",), ("deu",)], "code STRING"), authors=spark.createDataFrame([("one",)], "slug STRING"))
    with pytest.raises(Exception, match="not the name"):
        files.segment_files(spark, str(tmp_path), strict=True).count()


def test_glossary_is_built_and_read(spark, tmp_path):
    for name, d in (("pali", {"1": "a|nt|x|y|dhamma 1", "2": "a|masc|x|y|dhamma 2.1", "3": "short|x", "4": "a||x|y|jhāna"}), ("en", {"1": "teaching; law", "2": "law|thing"}), ("ru", {"1": "учение"})):
        (tmp_path / f"{name}.mjs").write_text(f"export const D = {json.dumps(d)};")
    part = lambda n: files.script_module(spark, str(tmp_path / f"{n}.mjs"))
    built = files.build_glossary(files.defined(files.parsed_entries(part("pali")), part("en"), part("ru")))
    got = {r["lemma"]: (r["pos"], r["meanings_en"], r["meanings_ru"]) for r in built.collect()}
    assert got == {"dhamma": (["masc", "nt"], ["teaching", "law", "thing"], ["учение"]), "jhāna": ([], [], [])}
    (tmp_path / "cyrillic.yaml").write_text("- pali: dhamma\n  cyrillic: [Дхамма, дхарма]\n- pali: other\n  cyrillic: [дхамма]\n")
    files.write_glossary(built, str(tmp_path / "lines"))
    (tmp_path / "whole.json").write_text(json.dumps({"dhamma": {"lemma": "dhamma", "pos": ["nt"], "meanings_en": ["law"]}}))
    for at in ("lines", "whole.json"):
        lemmas, words = files.read_glossary(spark, str(tmp_path / at), str(tmp_path / "cyrillic.yaml"))
        assert "dhamma" in {r["lemma"] for r in lemmas.collect()} and {tuple(r) for r in words.collect()} == {("дхамма", "dhamma"), ("дхарма", "dhamma")}


def test_talks(spark, tmp_path):
    (tmp_path / "rb_12_on_love.txt").write_text("TRANSCRIPTION:\n" + "One sentence here. " * 30 + "\n\nGenerated by WhisperAI")
    none = spark.createDataFrame([], "content_hash STRING")
    got = ingest.load_talks(spark, str(tmp_path), None, none, "rob", "Rob")
    assert got.works.head()["canonical_id"] == "rob_12" and got.counts["loaded"] == 1
    child = got.chunks.where("not is_parent").head()
    assert child["context_text"].startswith('Excerpt from a recorded dharma talk, titled "On Love", by Rob') and got.chunks.where("is_parent").head()["context_text"] is None


def test_rechunk(spark):
    rows = [("a", "i", 0, False, "a:1.1", "one"), ("b", "i", 1, False, "a:2.1", "two"), ("c", "j", 0, True, None, "p"), ("d", "j", 1, False, None, "p")]
    got = ingest.rechunk(spark.createDataFrame(rows, "id STRING, instance_id STRING, sequence INT, is_parent BOOLEAN, segment_id STRING, text STRING")).collect()
    assert {(r["instance_id"], r["is_parent"], r["text"]) for r in got} == {("i", True, "one two"), ("i", False, "one two")}


def test_registered_functions(spark):
    assert len(register(spark)) == 9
    r = spark.sql("SELECT loom_ascii_fold('saṃsāra') a, loom_strip_diacritics('jhāna') b, loom_collapse(' a  b ') c, loom_quarter_tokens('abcdefgh') d, loom_nfc('é') = 'é' e").head()
    assert tuple(r) == ("samsara", "jhana", "a b", 2, True)


def test_requests(spark):
    assert requests.queries_frame(spark, {"a": requests.QueryRequest("x", source_types=("talk",))}).head()["source_types"] == ["talk"]
    for bad in (lambda: requests.QueryRequest(""), lambda: requests.QueryRequest("x" * 2001), lambda: requests.QueryRequest("x", 21), lambda: requests.AnswerRequest("x", 11), lambda: requests.AnswerRequest("x", 5, "odd"), lambda: requests.RetrieveRequest("x", 20, 201), lambda: requests.ThreadRequest("x", 0), lambda: requests.Feedback("t", 0), lambda: requests.Feedback("t", 1, "x" * 2001)):
        with pytest.raises(ValueError):
            bad()
