"""Text functions as column expressions; Python only where the JVM has no equivalent (Unicode forms, entities)."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The letters that lexical matching folds, 16 in two cases, in the same order on both sides.
FOLD_FROM, FOLD_TO = "āĀīĪūŪṝṜḹḸṛṚḷḶṭṬḍḌṇṆṣṢñÑṅṄṃṂḥḤśŚ", "aAiIuUrRlLrRlLtTdDnNsSnNnNmMhHsS"
# Two-letter language codes and their three-letter ones.
LANGUAGES = {"en": "eng", "pli": "pli", "pi": "pli", "san": "san", "sa": "san", "ru": "rus", "de": "deu", "fr": "fra", "es": "spa", "pt": "por", "it": "ita", "nl": "nld", "pl": "pol", "zh": "zho", "si": "sin", "th": "tha", "ko": "kor", "jp": "jpn", "ja": "jpn"}
BLANKS = r"(?U)\s+"


def strip_tags(c: Column) -> Column:
    """Markup tags become one blank each."""
    return F.regexp_replace(c, "<[^>]+>", " ")


def normalise_iast(c: Column) -> Column:
    """The older anusvara with a dot above becomes the one with a dot below."""
    return F.translate(c, "ṁṀ", "ṃṂ")


def ascii_fold(c: Column) -> Column:
    """Letters of the romanisation without their marks; all other letters stay."""
    return F.translate(c, FOLD_FROM, FOLD_TO)


def collapse_whitespace(c: Column) -> Column:
    """Runs of white space of any kind become one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, BLANKS, " "))


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@F.pandas_udf(T.StringType())
def unescape_html(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


@F.pandas_udf(T.StringType())
def strip_diacritics(s: pd.Series) -> pd.Series:
    """Without the combining marks of the decomposed form."""
    return s.map(lambda t: "".join(ch for ch in unicodedata.normalize("NFD", t) if unicodedata.category(ch) != "Mn"), na_action="ignore")


@F.pandas_udf(T.StringType())
def casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFC", t).casefold(), na_action="ignore")


@F.pandas_udf(T.BooleanType())
def has_diacritics(s: pd.Series) -> pd.Series:
    return s.map(lambda t: any(unicodedata.category(ch) == "Mn" for ch in unicodedata.normalize("NFD", t)), na_action="ignore")


def canonical(c: Column) -> Column:
    """Entities to characters, tags away, composed form, one romanisation, single blanks. An escaped tag is a tag once it is unescaped, and goes."""
    return collapse_whitespace(normalise_iast(nfc(strip_tags(unescape_html(c)))))


def is_nfc(c: Column) -> Column:
    return nfc(c) == c


def normalise_query(c: Column) -> Column:
    """What lexical search looks up: folded, lower case, single blanks; null counts as empty."""
    return collapse_whitespace(F.lower(ascii_fold(F.coalesce(c, F.lit("")))))


def tokenize(c: Column) -> Column:
    """Lower-case words of letters, with hyphens inside; marks are letters where the text is composed (``nfc``)."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"(?U)([\p{L}]+(?:-[\p{L}]+)*)"), F.lit(1))


def simple_terms(c: Column) -> Column:
    """Terms of the lexical index: folded, lower-case runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(ascii_fold(c)), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def word_count(c: Column) -> Column:
    t = collapse_whitespace(c)
    return F.when(F.coalesce(t, F.lit("")) == "", F.lit(0)).otherwise(F.size(F.split(t, " ")))


def token_estimate(c: Column) -> Column:
    """max(1, 1.3 x words), halves to even."""
    return F.greatest(F.lit(1), F.bround(word_count(c) * F.lit(1.3)).cast("int"))


def word_tokens(c: Column) -> Column:
    return F.greatest(F.lit(1), word_count(c))


def quarter_tokens(c: Column) -> Column:
    """A token for each four characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4).cast("int"))


def looks_cyrillic(c: Column) -> Column:
    return c.rlike(r"[\x{0400}-\x{04FF}]")


def paragraphs(c: Column, separator: str = r"\n{2,}") -> Column:
    return F.filter(F.transform(F.split(strip(c), separator), strip), lambda x: x != "")


def sentences(c: Column) -> Column:
    """Cut after the end of a sentence where white space follows; the whole text if there is none."""
    return F.filter(F.split(strip(c), r"(?U)(?<=[.!?…])\s+"), lambda x: x != "")


def paragraph_of(segment_id: Column) -> Column:
    """The paragraph number of a segment id, null if it isn't a number."""
    got = F.regexp_extract(segment_id, r"^[^:]+:(\d+)\.", 1)
    return F.when(got != "", got)


def citations(answer: Column, sources: Column) -> Column:
    """Ids in square brackets, several between commas, lower case, those among the sources, each once in order of appearance."""
    inner = F.regexp_extract_all(answer, F.lit(r"\[([^\[\]]+)\]"), F.lit(1))
    parts = F.flatten(F.transform(inner, lambda x: F.transform(F.split(x, ","), lambda y: F.trim(y))))
    ids = F.transform(F.filter(parts, lambda x: x.rlike(r"^[a-zA-Z0-9._-]+$")), lambda x: F.lower(x))
    return F.array_distinct(F.filter(ids, lambda x: F.array_contains(F.coalesce(sources, F.array().cast("array<string>")), x)))


def split_meanings(c: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(c, r"[|;]"), lambda x: F.trim(x)), lambda x: x != ""))


def normalise_lemma(c: Column) -> Column:
    """A dictionary lemma without its sense number."""
    return F.regexp_replace(c, r"\s+\d+(\.\d+)?$", "")


def snippet(c: Column, n: int) -> Column:
    t = collapse_whitespace(c)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("…"))).otherwise(t)


def prefixed_chunk(context: Column, chunk: Column, strict: bool = False) -> Column:
    """Context, an empty line, chunk; where one of them is empty null, or an error if ``strict``."""
    a, b = strip(context), strip(chunk)
    return F.when((a != "") & (b != ""), F.concat_ws("\n\n", a, b)).otherwise(F.raise_error(F.lit("empty context or chunk")) if strict else F.lit(None))


def talk_context(title: Column, teacher: Column, date: Column, link: Column) -> Column:
    """One sentence about where a chunk of a talk comes from; unknown parts are left out."""
    part = lambda c, text: F.when(F.coalesce(c, F.lit("")) != "", text)
    said = F.concat_ws(", ", F.lit("Excerpt from a recorded dharma talk"), part(title, F.concat(F.lit('titled "'), title, F.lit('"'))), part(teacher, F.concat(F.lit("by "), teacher)), part(date, F.concat(F.lit("recorded "), date)))
    return F.concat(said, F.lit("."), F.coalesce(part(link, F.concat(F.lit(" Source: "), link, F.lit("."))), F.lit("")))


def humanised_slug(c: Column, small: tuple[str, ...] = ("a", "an", "and", "as", "at", "but", "by", "for", "from", "in", "of", "on", "or", "the", "to", "with")) -> Column:
    """A title from a slug; small words stay small unless first."""
    words = F.split(F.trim(F.regexp_replace(c, r"[-_]+", " ")), " +")
    return F.array_join(F.transform(words, lambda w, i: F.when((i > 0) & F.lower(w).isin(*small), F.lower(w)).otherwise(F.initcap(w))), " ")


def language_code(c: Column) -> Column:
    """Three-letter code of a short one; null where unknown."""
    return F.create_map(*(F.lit(x) for p in LANGUAGES.items() for x in p))[F.lower(c)]


def year_of(date: Column) -> Column:
    return F.substring(date, 1, 4).try_cast("int")


def cost_usd(tokens_in: Column, tokens_out: Column, cache_write: Column, cache_read: Column, per_million_in: float = 0.80, per_million_out: float = 4.00, write_factor: float = 1.25, read_factor: float = 0.10) -> Column:
    """Price of requests from their four token counts."""
    return (tokens_in * per_million_in + tokens_out * per_million_out + cache_write * (per_million_in * write_factor) + cache_read * (per_million_in * read_factor)) / 1_000_000


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))
