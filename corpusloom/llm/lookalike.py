"""Problem 5: one consistent form for text that looks the same.

Method: DuckDB inside Arrow partitions. Each Arrow batch is a table of an
embedded DuckDB, and one SQL statement with nfc_normalize, translate and
regular expressions brings its texts to one form. No shuffle and no Python
per row: Arrow buffers go into DuckDB and come out of it.

The form: full-width and half-width forms (of letters, kana, Korean and signs)
become plain ones (styled letters and super- or subscripts look different and
stay), ligatures are
spelled out, invisible characters go, accents are composed, runs of blanks of
any kind become one blank and those at the ends go. A letter that looks like
one of another script is then written in the script of its word: with Cyrillic
letters if the word has a letter that only Cyrillic has and none that only
Latin has, else with Latin ones; a word of look-alikes only goes with the
majority of the text. Case, punctuation and visible marks stay.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from string import ascii_letters

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.plans.materialize import materialize

# Letters that look alike, in the same order on both sides.
CYRILLIC, CYRILLIC_AS_LATIN = "аеорсухіјѕһԁԛԝӏАВЕКМНОРСТУХІЈЅԌԚԜӀёїЁЇӓӧӑӗѐӱӯӒӦӐӖЀ", "aeopcyxijshdqwlABEKMHOPCTYXIJSGQWIëïËÏäöăĕèÿȳÄÖĂĔÈ"
GREEK, GREEK_AS_LATIN = "ονόΑΒΕΖΗΙΚΜΝΟΡΤΥΧΆΈΊΌΎϳϲ", "ovóABEZHIKMNOPTYXÁÉÍÓÝjc"
#: Back again, for a Cyrillic word: one Cyrillic letter for each Latin one (l, I and the rare ones stay with the first that has them).
LATIN_BACK, CYRILLIC_BACK = "aeopcyxijsABEKMHOPCTYXIJSëïËÏ", "аеорсухіјѕАВЕКМНОРСТУХІЈЅёїЁЇ"
# Characters without any width of their own.
INVISIBLE = r"[\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{FFF9}-\x{FFFB}\x{E0000}-\x{E0FFF}\x{0000}-\x{0008}\x{000E}-\x{001B}\x{007F}-\x{0084}\x{0086}-\x{009F}]"
BLANKS = r"[\x{0009}-\x{000D}\x{001C}-\x{0020}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{2800}\x{3000}]+"
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "ĳ": "ij", "Ĳ": "IJ", "ǉ": "lj", "ǌ": "nj", "ǳ": "dz", "…": "..."}
HYPHENS = "‐‑"


def _wide() -> tuple[str, str]:
    """Characters that differ from others by their width only, full-width and half-width forms, and what they stand for; by the rule that Unicode gives them."""
    forms = [(chr(c), unicodedata.normalize("NFKC", chr(c))) for c in range(0xFF01, 0xFFEF) if unicodedata.decomposition(chr(c)).startswith(("<wide>", "<narrow>"))]
    forms = [(a, {"\u3099": "\u3099", "\u309a": "\u309a"}.get(b, b)) for a, b in forms if len(b) == 1 and b != "\u1160"]
    return "".join(a for a, _ in forms), "".join(b for _, b in forms)


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def form_sql(column: str) -> str:
    """A DuckDB expression for the consistent form of ``column``.

    Invisible characters go first, and accents are composed after letters are
    mapped: else an accent would stay apart from its letter.
    """
    blanks = lambda x: f"trim(regexp_replace({x}, '{BLANKS}', ' ', 'g'))"
    seen = f"regexp_replace({column}, '{INVISIBLE}', '', 'g')"
    # Each mapping runs over the texts that have a character for it: a test of one class costs less than a mapping.
    only = lambda where, then, other: f"CASE WHEN regexp_matches({column}, '[{where}]') THEN {then} ELSE {other} END"
    s = seen
    for one, many in LIGATURES.items():
        s = f"replace({s}, {_quoted(one)}, {_quoted(many)})"
    s = only("".join(LIGATURES), s, seen)
    wide, plain = _wide()
    s = only(rf"{HYPHENS}\x{{FF01}}-\x{{FFEE}}", f"translate({s}, {_quoted(wide + HYPHENS)}, {_quoted(plain + '-' * len(HYPHENS))})", s)
    s = only(r"\x{0370}-\x{052F}", f"translate({s}, {_quoted(CYRILLIC + GREEK)}, {_quoted(CYRILLIC_AS_LATIN + GREEK_AS_LATIN)})", s)
    return f"CASE WHEN strlen({column}) = length({column}) THEN {blanks(seen)} ELSE {blanks(f'nfc_normalize({s})')} END"


def batch_sql(view: str) -> str:
    """The statement that runs over each batch: key k and text t in, k and form out."""
    only_cyrillic = r"[\x{0400}-\x{052F}]"
    alone = "".join(c for c in ascii_letters if c not in LATIN_BACK)
    only_latin = rf"[{alone}\x{{00C0}}-\x{{00CA}}\x{{00CC}}-\x{{00CE}}\x{{00D0}}-\x{{00D6}}\x{{00D8}}-\x{{00EA}}\x{{00EC}}-\x{{00EE}}\x{{00F0}}-\x{{00F6}}\x{{00F8}}-\x{{024F}}\x{{1E00}}-\x{{1EFF}}]"
    whole = f"translate(s, '{LATIN_BACK}', '{CYRILLIC_BACK}')"  # a text without Latin letters of its own: all words go back
    back = f"translate(w, '{LATIN_BACK}', '{CYRILLIC_BACK}')"
    return f"""
    WITH plain AS (SELECT k, {form_sql("t")} AS s FROM {view}),
    counted AS (SELECT k, s, NOT regexp_matches(s, '{only_cyrillic}') AS no_cyrillic, NOT regexp_matches(s, '{only_latin}') AS no_latin,
        len(regexp_extract_all(s, '{only_cyrillic}')) > len(regexp_extract_all(s, '{only_latin}')) AS mostly FROM plain)
    SELECT k, CASE WHEN s IS NULL THEN NULL WHEN no_cyrillic THEN s WHEN no_latin THEN {whole} ELSE array_to_string(list_transform(string_split(s, ' '), lambda w:
        CASE WHEN regexp_matches(w, '{only_latin}') OR NOT (mostly OR regexp_matches(w, '{only_cyrillic}')) THEN w ELSE {back} END), ' ') END AS form
    FROM counted"""


def consistent(df: DataFrame, key: str, text: str, into: str = "form") -> DataFrame:
    """``key`` and the consistent form of ``text`` for each row of ``df``.

    Null stays null, empty stays empty, and what held only blanks and invisible
    characters becomes empty. Repeated rows give repeated rows; other columns
    are left out; texts of any length are taken whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB"})
        for b in batches:
            con.register("batch", pa.Table.from_arrays([b.column(0), b.column(1)], names=["k", "t"]))
            got = con.sql(batch_sql("batch")).to_arrow_table()
            con.unregister("batch")
            for part in got.combine_chunks().to_batches():
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(pa.string())], names=[key, into])

    return df.select(key, text).mapInArrow(run, T.StructType([df.schema[key], T.StructField(into, T.StringType(), True)]))


def form_classes(rows: DataFrame) -> DataFrame:
    """src, id, class: rows (src, id, text) whose form another text of their src has, too, with the digest of that form. What ``lookalike_pairs`` spells out in pairs, at one row each; a form that a third of all rows share costs no more than its rows."""
    return _dirty(rows).select("src", "id", F.hex("f").alias("class"))


def _dirty(rows: DataFrame) -> DataFrame:
    marked = rows.select(F.struct("src", F.col("id").cast("long").alias("id"), F.unhex(F.md5("text")).alias("t")).alias("k"), "text").where("text IS NOT NULL AND text <> ''")
    formed = consistent(marked, "k", "text").where("form <> ''")
    all_rows = materialize(formed.select("k.src", "k.id", "k.t", F.unhex(F.md5("form")).alias("f")))
    several = all_rows.groupBy("src", "f").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).where("lo <> hi").select("src", "f")
    return all_rows.join(several, ["src", "f"], "left_semi")


def lookalike_pairs(rows: DataFrame) -> DataFrame:
    """Pairs of rows of one src whose texts differ but look the same.

    ``rows``: src, id (unique within src), text. Returns src, id_a, id_b with
    id_a < id_b. Rows with null or empty text, or only blanks and invisible
    characters, make no pair; neither do rows with the same text.

    A form that a third of all rows share costs only what it returns: the pairs
    come from different *texts* of a form first, and only then from their rows,
    so rows of one text are never set against each other. Joins are by hash of
    the form and of the text; adaptive execution splits the hot ones.
    """
    dirty = materialize(_dirty(rows))
    texts = dirty.select("src", "f", F.col("t").alias("t2")).distinct()
    a = dirty.join(texts, ["src", "f"]).where("t < t2").select("src", F.col("id").alias("x"), F.col("t2").alias("t"))
    b = dirty.select("src", F.col("id").alias("y"), "t")
    return a.join(b, ["src", "t"]).select("src", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
