"""The pN_ queries over a folder of tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.tables import table


def _language_texts(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """Training text per language, from the labels of golden queries and segments."""
    from corpusloom.llm import language

    golden = table(spark, sf_dir, "golden_items").select(F.col("query").alias("text"), language.label_column(F.col("language")).alias("code"))
    segments = table(spark, sf_dir, "segments").select("text", language.label_column(F.col("language_code")).alias("code"))
    sample = language.labelled_sample(golden)
    for code, texts in language.labelled_sample(segments).items():
        sample.setdefault(code, []).extend(texts)
    return language.training_texts(sample)


def _queries_with_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    golden = table(spark, sf_dir, "golden_items").select(F.lit("golden_items").alias("src"), F.col("id").alias("rec_key"), F.col("language").alias("label"), F.col("query").alias("text"))
    feedback = table(spark, sf_dir, "feedback").select(F.lit("feedback").alias("src"), F.col("trace_id").alias("rec_key"), F.lit(None).cast("string").alias("label"), F.col("query_text").alias("text"))
    return golden.unionByName(feedback)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import language

    rows = _queries_with_label(spark, sf_dir).withColumn("label", language.label_column(F.col("label")))
    got = language.identify(rows, _language_texts(spark, sf_dir), ["src", "rec_key", "label"], "text")
    return got.where(~F.col("language").eqNullSafe(F.col("label"))).select("src", "rec_key", "language").distinct()


def p3_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import language

    rows = _queries_with_label(spark, sf_dir)
    return language.identify(rows, _language_texts(spark, sf_dir), ["src", "rec_key"], "text").distinct()


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import spans

    chunks = table(spark, sf_dir, "chunks").select("id", F.col("is_parent").alias("level"), "text")
    return spans.shared_spans(chunks).withColumnRenamed("id", "chunk_id")


def p1_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import spans

    chunks = table(spark, sf_dir, "chunks").select("id", F.col("is_parent").alias("level"), "text")
    return spans.coverage(chunks, spans.shared_spans(chunks)).withColumnRenamed("id", "chunk_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import pairs

    answers = table(spark, sf_dir, "answers").select(F.lit("answers").alias("src"), "trace_id", F.col("query").alias("question"), "answer")
    feedback = table(spark, sf_dir, "feedback").select(F.lit("feedback").alias("src"), "trace_id", F.col("query_text").alias("question"), F.col("answer_text").alias("answer"))
    return pairs.defects(answers.unionByName(feedback), _language_texts(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import splitting

    return splitting.measure(table(spark, sf_dir, "chunks"), "id", "text", "is_parent").where("oversize").select(F.col("id").alias("chunk_id")).distinct()


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import splitting

    rows = table(spark, sf_dir, "chunks").select("id", "text", "is_parent", "segment_ids")
    return splitting.pieces(rows).dropDuplicates(["id", "piece"]).withColumnRenamed("id", "chunk_id")


def p4_file_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of giant files: the texts of all documents, written as text files, by byte offset and within the limits of a child."""
    import uuid

    from corpusloom.llm import splitting
    from corpusloom.plans.materialize import keep, shared_folder

    at = f"{shared_folder(spark)}/corpusloom-files-{uuid.uuid4().hex}"
    table(spark, sf_dir, "documents").where("text IS NOT NULL").select("text").write.text(at)
    keep(spark, at)
    files = spark.read.format("binaryFile").load(at).select("path", "length").where("length > 0").orderBy("path").collect()  # as many as tasks wrote
    got = splitting.file_pieces(spark, [(r["path"], r["length"]) for r in files], splitting.CHILD.chars)
    names = spark.createDataFrame([(r["path"], i) for i, r in enumerate(files)], "path STRING, file INT")
    return got.join(names, "path").drop("path")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import lookalike

    segments = table(spark, sf_dir, "segments").select(F.lit("segments").alias("src"), F.col("row_id").alias("id"), "text")
    glossary = table(spark, sf_dir, "glossary_entries").select(F.lit("glossary_entries").alias("src"), F.col("entry_id").alias("id"), F.col("pali").alias("text"))
    return lookalike.lookalike_pairs(segments.unionByName(glossary))


def p5_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import lookalike

    return lookalike.consistent(table(spark, sf_dir, "segments"), "row_id", "text")


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row that looks like another of other characters, with its class."""
    from corpusloom.llm import lookalike

    segments = table(spark, sf_dir, "segments").select(F.lit("segments").alias("src"), F.col("row_id").alias("id"), "text")
    glossary = table(spark, sf_dir, "glossary_entries").select(F.lit("glossary_entries").alias("src"), F.col("entry_id").alias("id"), F.col("pali").alias("text"))
    return lookalike.form_classes(segments.unionByName(glossary))


def _tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [table(spark, sf_dir, n) for n in names]


def p6_chunk_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import budget

    return budget.chunk_tokens(spark, *_tables(spark, sf_dir, "chunks", "works", "expressions", "instances"))


def p6_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import budget

    return budget.budget(p6_chunk_tokens(spark, sf_dir))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import mixing

    return mixing.mix_of(*_tables(spark, sf_dir, "documents", "mix_targets"))[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import mixing

    return mixing.mix_of(*_tables(spark, sf_dir, "documents", "mix_targets"))[1]


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import tokenizing

    return tokenizing.encode_corpus(table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import residue

    return residue.residue(table(spark, sf_dir, "documents")).select("doc_id").distinct()


def p9_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import residue

    return residue.without_residue(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_coverage, p2_found, p3_found, p3_stretches, p4_found, p4_pieces, p4_file_pieces, p5_found, p5_forms, p5_classes, p6_chunk_tokens, p6_budget, p7_ids, p8_mix, p8_shares, p9_found, p9_clean)}


_BLANK = r"\x09-\x0D\x1C-\x20\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

#: Every window of 200 characters of every chunk, grouped; then islands of those that two chunks have.
_P1 = """
WITH c AS (SELECT DISTINCT id, is_parent, text FROM chunks WHERE length(text) >= 200),
w AS (SELECT id, is_parent, text, unnest(range(0, length(text) - 199)) AS a FROM c),
g AS (SELECT id, is_parent, a, md5(substr(text, a + 1, 200)) AS h FROM w),
several AS (SELECT is_parent, h FROM g GROUP BY ALL HAVING min(id) <> max(id)),
hit AS (SELECT DISTINCT id, a FROM g JOIN several USING (is_parent, h)),
edge AS (SELECT id, a, CASE WHEN a <= lag(a) OVER (PARTITION BY id ORDER BY a) + 200 THEN 0 ELSE 1 END AS new FROM hit),
part AS (SELECT id, a, sum(new) OVER (PARTITION BY id ORDER BY a) AS k FROM edge)
SELECT id AS chunk_id, CAST(min(a) AS INTEGER) AS span_start, CAST(max(a) + 200 AS INTEGER) AS span_end FROM part GROUP BY id, k
"""

_P4 = f"""
WITH c AS (SELECT DISTINCT id, is_parent, text FROM chunks WHERE text IS NOT NULL),
m AS (SELECT id, coalesce(is_parent, false) AS up, length(text) AS n, greatest(1, round_even(len(regexp_extract_all(text, '[^{_BLANK}]+')) * 1.3::DOUBLE, 0)) AS t FROM c)
SELECT DISTINCT id AS chunk_id FROM m WHERE t > CASE WHEN up THEN 2048 ELSE 512 END OR n > CASE WHEN up THEN 16000 ELSE 4000 END
"""


def _p5_forms_sql(rows: str) -> str:
    """Forms of rows (src, id, text), told character by character: each is looked up in a table, words are put together again, and each word goes to the script that its own letters name. CTEs up to ``formed`` (src, id, text, form)."""
    from corpusloom.llm import lookalike as L

    wide, plain = L._wide()
    pairs = dict(zip(wide + L.HYPHENS, plain + "-" * len(L.HYPHENS))) | dict(L.LIGATURES) | dict(zip(L.CYRILLIC + L.GREEK, L.CYRILLIC_AS_LATIN + L.GREEK_AS_LATIN))
    values = ", ".join(f"({ord(c)}, {L._quoted(m)})" for c, m in pairs.items())
    back = ", ".join(f"({L._quoted(a)}, {L._quoted(b)})" for a, b in zip(L.LATIN_BACK, L.CYRILLIC_BACK))
    own = "(unicode(c) BETWEEN 1024 AND 1327)"
    latin = f"((c BETWEEN 'A' AND 'Z' OR c BETWEEN 'a' AND 'z') AND NOT contains({L._quoted(L.LATIN_BACK)}, c) OR unicode(c) BETWEEN 192 AND 591 AND NOT unicode(c) IN (203, 207, 215, 235, 239, 247) OR unicode(c) BETWEEN 7680 AND 7935)"
    return f"""
    r AS ({rows}), code(u, m) AS (VALUES {values}), back(c, y) AS (VALUES {back}),
    ch AS (SELECT src, id, i, substr(text, i, 1) AS c FROM (SELECT src, id, text, unnest(range(1, length(text) + 1)) AS i FROM r WHERE text IS NOT NULL AND text <> '')),
    seen AS (SELECT src, id, i, coalesce(m, c) AS x FROM ch LEFT JOIN code ON u = unicode(c) WHERE NOT regexp_matches(c, '{L.INVISIBLE}')),
    whole AS (SELECT src, id, nfc_normalize(string_agg(x, '' ORDER BY i)) AS s FROM seen GROUP BY ALL),
    letter AS (SELECT src, id, i, substr(s, i, 1) AS c FROM (SELECT src, id, s, unnest(range(1, length(s) + 1)) AS i FROM whole)),
    kind AS (SELECT src, id, i, c, regexp_matches(c, '{L.BLANKS}') AS blank, {own} AS cyr, {latin} AS lat FROM letter),
    worded AS (SELECT *, sum(blank::INT) OVER (PARTITION BY src, id ORDER BY i) AS w, sum(cyr::INT) OVER (PARTITION BY src, id) AS n_cyr, sum(lat::INT) OVER (PARTITION BY src, id) AS n_lat FROM kind),
    spoken AS (SELECT *, bool_or(cyr) OVER (PARTITION BY src, id, w) AS w_cyr, bool_or(lat) OVER (PARTITION BY src, id, w) AS w_lat FROM worded WHERE NOT blank),
    spelled AS (SELECT src, id, w, i, CASE WHEN n_cyr > 0 AND NOT w_lat AND (w_cyr OR n_cyr > n_lat) THEN coalesce(y, s.c) ELSE s.c END AS x FROM spoken s LEFT JOIN back b ON b.c = s.c),
    joined AS (SELECT src, id, w, string_agg(x, '' ORDER BY i) AS x FROM spelled GROUP BY ALL),
    formed AS (SELECT src, id, any_value(r.text) AS text, string_agg(x, ' ' ORDER BY w) AS form FROM joined JOIN r USING (src, id) GROUP BY src, id)"""


_RECORDS = "SELECT 'segments' AS src, row_id AS id, text FROM segments UNION ALL SELECT 'glossary_entries', entry_id, pali FROM glossary_entries"

_P1_COVERAGE = f"""
WITH found AS ({_P1}), held AS (SELECT chunk_id, sum(span_end - span_start) AS k FROM found GROUP BY ALL), size AS (SELECT id AS chunk_id, max(coalesce(length(text), 0)) AS n FROM chunks GROUP BY ALL)
SELECT chunk_id, CAST(n AS INTEGER) AS n_chars, CAST(coalesce(k, 0) AS BIGINT) AS shared_chars, CASE WHEN n > 0 THEN coalesce(k, 0)::DOUBLE / n ELSE 0.0 END AS shared_share FROM size LEFT JOIN held USING (chunk_id)
"""


def oracle_sql() -> dict[str, str]:
    """Problems 1, 4 and 5 as SQL of their own."""
    forms = _p5_forms_sql(_RECORDS)
    p5 = f"WITH {forms} SELECT a.src, a.id AS id_a, b.id AS id_b FROM formed a JOIN formed b ON a.src = b.src AND a.form = b.form AND a.id < b.id AND a.text <> b.text"
    segments = _p5_forms_sql("SELECT 'segments' AS src, row_id AS id, text FROM segments")
    p5_forms = f"WITH {segments} SELECT g.row_id, CASE WHEN g.text IS NULL THEN NULL ELSE coalesce(form, '') END AS form FROM segments g LEFT JOIN formed f ON f.id = g.row_id"
    p5_classes = f"WITH {forms}, several AS (SELECT src, form FROM formed GROUP BY ALL HAVING count(DISTINCT text) > 1) SELECT src, id, upper(md5(form)) AS class FROM formed JOIN several USING (src, form)"
    return {"p1_found": _P1, "p1_coverage": _P1_COVERAGE, "p4_found": _P4, "p5_found": p5, "p5_forms": p5_forms, "p5_classes": p5_classes}
