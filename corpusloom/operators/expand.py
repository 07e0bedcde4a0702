"""Rewriting a batch of queries: definitional templates, glossary terms, term-to-works matches, aliases for the lexical channel."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import ascii_fold, casefold, looks_cyrillic, nfc, normalise_lemma, strip, strip_diacritics, tokenize

# How a question for a definition begins, and the articles that may follow. What comes then, up to the end, is the term.
OPENERS = (
    ("what is", ("the", "a")),
    ("what are", ("the", "a")),
    ("define", ("the",)),
    ("meaning of", ()),
    ("definition of", ()),
    ("что такое", ()),
    ("определение", ()),
    ("значение", ()),
    ("что значит", ()),
    ("что означает", ()),
)
# What such a question is rewritten to.
TEMPLATE_EN = "What is %s? Discourse on %s. Foundations of %s. Sutta on %s."
TEMPLATE_RU = "Что такое %s? Учение о %s. Основы %s. Сутта о %s."
MOST_TERM_WORDS = 6


def definitional_term(query: Column) -> Column:
    """The term a query asks to define, null if it asks for none, or for one with marks within or of too many words.

    A query is compared word by word: its first words are an opener, an article
    may come next, and the rest is the term, without one mark at its end. Runs
    of blanks in the term become one.
    """
    bare = F.trim(F.regexp_replace(strip(query), r"(?U)\s*[?.]$", ""))
    words = F.split(bare, r"(?U)\s+")
    low = F.transform(words, lambda w: F.lower(w))
    found = None
    for opener, articles in OPENERS:
        n = opener.count(" ") + 1
        asks = (F.size(words) > n) & (F.array_join(F.slice(low, 1, n), " ") == opener)
        skip = F.when((F.size(words) > n + 1) & F.get(low, F.lit(n)).isin(*articles), n + 1).otherwise(n) if articles else F.lit(n)
        rest = F.slice(words, skip + 1, F.greatest(F.lit(1), F.size(words)))
        found = F.when(asks, rest) if found is None else found.when(asks, rest)
    term = F.array_join(found, " ")
    return F.when((term != "") & ~term.rlike("[?.,;]") & (F.size(found) <= MOST_TERM_WORDS), term)


def definitional_language(query: Column) -> Column:
    return F.when(looks_cyrillic(query), "ru").otherwise("en")


def expand_definitional(query: Column) -> Column:
    """The template filled with the term; other queries unchanged."""
    t = definitional_term(query)
    ru = definitional_language(query) == "ru"
    return F.when(t.isNull(), query).when(ru, F.format_string(TEMPLATE_RU, t, t, t, t)).otherwise(F.format_string(TEMPLATE_EN, t, t, t, t))


def _grams(c: Column) -> Column:
    """All strings of one to three characters in a text."""
    n = F.length(c)
    each = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - (k - 1))), lambda i: F.substring(c, i, k))
    return F.array_distinct(F.concat(each(1), each(2), each(3)))


def _holding(whole: DataFrame, w: str, part: DataFrame, p: str) -> DataFrame:
    """Pairs of rows in which the text ``w`` of one holds the text ``p`` of the other: an equi-join on the first three characters of what is held, then a look at the whole."""
    return whole.withColumn("gram", F.explode(_grams(F.col(w)))).join(part.withColumn("gram", F.substring(p, 1, 3)), "gram").where(F.col(w).contains(F.col(p))).drop("gram")


def alias_sentences(queries: DataFrame, entries: DataFrame, most: int = 3) -> DataFrame:
    """``queries`` (query_id, query) with query extended by up to three phrases of the first entry whose term is the asked one, or holds it, or is held by it.

    ``entries``: entry (order), term, aliases. Only phrases of several words that
    aren't Cyrillic and aren't the term count. Distinct terms are compared.
    """
    asked = queries.select("query_id", "query", definitional_term(F.col("query")).alias("t"), definitional_language(F.col("query")).alias("lang"))
    terms = asked.where("t IS NOT NULL").select(F.lower("t").alias("k")).distinct()
    known = entries.select("entry", F.lower("term").alias("low"), "aliases").where("low <> ''")
    near = _holding(terms, "k", known, "low").select("k", "entry", "aliases").union(_holding(known, "low", terms, "k").select("k", "entry", "aliases"))
    first = near.groupBy("k").agg(F.min_by("aliases", "entry").alias("aliases"))
    good = F.filter("aliases", lambda a: F.trim(a).contains(" ") & ~looks_cyrillic(a) & (F.lower(a) != F.col("k")))
    first = first.select("k", F.slice(good, 1, most).alias("aliases")).where(F.size("aliases") > 0)
    said = F.concat(F.array_join(F.transform("aliases", lambda a: F.concat(F.when(F.col("lang") == "ru", "То же что ").otherwise("Also known as "), a)), ". "), F.lit("."))
    out = asked.join(first, F.lower(asked["t"]) == first["k"], "left")
    return out.select("query_id", F.concat_ws(" ", expand_definitional(F.col("query")), F.when(F.col("aliases").isNotNull(), said)).alias("query"))


def checked(entries: DataFrame, most: int = 100_000) -> DataFrame:
    """Curated lists are sent to all tasks; one that has grown beyond a list is refused."""
    if entries.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} entries: not a curated list")
    return entries


def normalised(c: Column) -> Column:
    """Composed, case folded, single blanks."""
    return F.trim(F.regexp_replace(casefold(c), r"(?U)\s+", " "))


def match_terms(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """query_id, entry, term: entries of which the term or an alias stands in the query as whole words, one row per entry.

    ``entries``: entry (order), term, aliases, works, boost. Each name is looked
    up by its first word among the words of the queries (an equi-join), and only
    those pairs are tested.
    """
    names = checked(entries).select("entry", "term", F.explode(F.array_distinct(F.concat(F.array("term"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("name"))
    names = names.select("entry", "term", normalised(F.col("name")).alias("name")).where("name <> ''")
    names = names.withColumn("w", F.regexp_extract("name", r"(?U)([\p{L}\p{M}\p{N}_]+)", 1))
    words = queries.select("query_id", normalised(F.col("query")).alias("q"))
    words = words.withColumn("w", F.explode(F.array_distinct(F.regexp_extract_all("q", F.lit(r"(?U)([\p{L}\p{M}\p{N}_]+)"), F.lit(1)))))
    pattern = F.concat(F.lit(r"(?U)(?<!\w)\Q"), F.col("name"), F.lit(r"\E(?!\w)"))
    return words.join(F.broadcast(names), "w").where(F.regexp_like("q", pattern)).select("query_id", "entry", "term").distinct()


def work_boosts(matches: DataFrame, entries: DataFrame, default: float = 1.5) -> DataFrame:
    """query_id, work, factor: the largest factor of a work over the matched entries."""
    works = entries.select("entry", F.explode("works").alias("work"), F.coalesce("boost", F.lit(default)).alias("factor"))
    return matches.join(works, "entry").groupBy("query_id", "work").agg(F.max("factor").alias("factor"))


def lexical_aliases(matches: DataFrame, entries: DataFrame, most: int = 3) -> DataFrame:
    """query_id, aliases: up to three names of the matched entries, in their order, without spelling variants of the term and Cyrillic ones."""
    names = checked(entries).select("entry", "term", F.posexplode("aliases").alias("pos", "alias")).withColumn("alias", F.trim("alias"))
    variant = ~F.col("alias").contains(" ") & (ascii_fold(F.lower("alias")) == ascii_fold(F.lower("term")))
    names = names.where((F.col("alias") != "") & ~variant & ~looks_cyrillic(F.col("alias"))).drop("term")
    got = matches.select("query_id", "entry").join(F.broadcast(names), "entry").groupBy("query_id", "alias").agg(F.min(F.struct("entry", "pos")).alias("at"))
    w = Window.partitionBy("query_id").orderBy("at")
    kept = got.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
    return kept.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "alias"))), lambda x: x["alias"]).alias("aliases"))


def lexical_query(query: Column, aliases: Column) -> Column:
    """The raw query and its aliases as alternatives; several words as a phrase."""
    quoted = F.transform(aliases, lambda a: F.when(a.contains(" "), F.concat(F.lit('"'), a, F.lit('"'))).otherwise(a))
    return F.when(F.size(F.coalesce(aliases, F.array())) > 0, F.concat_ws(" or ", query, F.array_join(quoted, " or "))).otherwise(query)


@dataclass
class Glossary:
    """Lemmas (lemma, meanings_en, meanings_ru; lower case, each once) and spellings of them in Cyrillic (word, lemma)."""

    lemmas: DataFrame
    cyrillic: DataFrame | None = None


def expand_glossary(queries: DataFrame, glossary: Glossary, meanings: int = 1, terms: int = 5) -> DataFrame:
    """``queries`` (query_id, query, …) with query followed by the lemmas of its first known words and their first meanings in both languages, as far as they aren't there.

    A word is looked up as a Cyrillic spelling; else, if it has marks, as a
    lemma with them, then without them. The lookups are joins of the words with
    the glossary, a checked list. Words that come twice count twice among the
    first; what is appended comes once, whatever its case.
    """
    words = tokenize(nfc(F.coalesce("query", F.lit(""))))
    asked = queries.select("query_id", words.alias("words"))
    each = asked.select("query_id", F.posexplode("words").alias("pos", "w")).withColumn("bare", strip_diacritics("w"))
    lemmas = checked(glossary.lemmas).select(F.col("lemma").alias("exact"))
    bare = lemmas.groupBy(strip_diacritics("exact").alias("bare")).agg(F.min("exact").alias("by_bare"))
    looked = each.join(F.broadcast(lemmas), each["w"] == lemmas["exact"], "left").join(F.broadcast(bare), "bare", "left")
    lemma = F.when(F.col("w") != F.col("bare"), F.coalesce("exact", "by_bare"))
    if glossary.cyrillic is not None:
        spelled = checked(glossary.cyrillic).groupBy(F.col("word").alias("w")).agg(F.first("lemma").alias("cyrillic"))
        looked = looked.join(F.broadcast(spelled), "w", "left")
        lemma = F.coalesce("cyrillic", lemma)
    known = looked.select("query_id", "pos", lemma.alias("lemma")).where("lemma IS NOT NULL")
    known = known.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))).where(F.col("n") <= terms)
    none = F.array().cast("array<string>")
    says = checked(glossary.lemmas).select("lemma", F.concat(*(F.slice(F.coalesce(c, none), 1, meanings) for c in ("meanings_en", "meanings_ru"))).alias("said"))
    added = known.join(F.broadcast(says), "lemma", "left").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("n", F.concat(F.array("lemma"), F.coalesce("said", none)).alias("x")))).alias("found"))
    added = added.join(asked, "query_id").withColumn("all", F.flatten(F.transform("found", lambda f: f["x"])))
    low = F.transform("all", lambda x: F.lower(x))
    new = F.filter("all", lambda x, i: (F.array_position(low, F.lower(x)) == i + 1) & ~F.array_contains("words", F.lower(x)))
    extra = added.select("query_id", F.array_join(new, " ").alias("extra"))
    out = queries.join(extra, "query_id", "left")
    return out.withColumn("query", F.concat_ws(" ", "query", F.nullif(F.col("extra"), F.lit("")))).select(*queries.columns)


def merged_lemmas(raw: DataFrame, most: int = 5) -> DataFrame:
    """Glossary entries by lemma: meanings of its senses in order, each once, at most ``most``; the parts of speech as a set. ``raw``: ord, lemma, pos ARRAY, meanings ARRAY."""
    rows = raw.select(F.lower(strip(normalise_lemma(F.col("lemma")))).alias("lemma"), "ord", "pos", "meanings")
    return rows.groupBy("lemma").agg(
        F.slice(F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("ord", F.coalesce("meanings", F.array().cast("array<string>")).alias("m")))), lambda x: x["m"]))), 1, most).alias("meanings"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("pos", F.array().cast("array<string>")))))).alias("pos"),
        F.count("*").alias("n_senses"),
    )
