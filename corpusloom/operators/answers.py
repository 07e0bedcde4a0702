"""Answers: citations, confidence, prompts, and the scanner for citations in a stream."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import strip

# What is a citation, and what is an id in it.
_BRACKET = re.compile(r"\[([^\[\]]+)\]")
_ID = re.compile(r"^[a-zA-Z0-9._-]+$")


@dataclass
class CitationScanner:
    """Citations as text streams in: each known id once, at the end of its bracket; an open bracket waits for the rest.

    Only the text from the last open bracket on is kept, so state stays small.
    """

    known: frozenset[str]
    rest: str = ""
    offset: int = 0
    seen: list[str] = field(default_factory=list)

    def feed(self, delta: str) -> list[tuple[str, int]]:
        text = self.rest + delta
        found, done = [], 0
        for m in _BRACKET.finditer(text):
            done = m.end()
            for part in m.group(1).split(","):
                i = part.strip()
                if _ID.match(i) and i.lower() in self.known and i.lower() not in self.seen:
                    self.seen.append(i.lower())
                    found.append((i.lower(), self.offset + m.end()))
        keep = text.rfind("[", done)
        cut = keep if keep >= 0 else len(text)
        self.rest, self.offset = text[cut:], self.offset + cut
        return found


def answer_segments(answer: str, known: set[str]) -> list[tuple[str, str | list[str]]]:
    """An answer as text and citations in turn; brackets without a known id stay text. Ids keep their case here."""
    out: list[tuple[str, str | list[str]]] = []
    at = 0
    for m in _BRACKET.finditer(answer):
        ids = [i for p in m.group(1).split(",") if (i := p.strip()) in known]
        if ids:
            if m.start() > at:
                out.append(("text", answer[at : m.start()]))
            out.append(("citation", ids))
            at = m.end()
    if at < len(answer):
        out.append(("text", answer[at:]))
    return out


def confidence_tier(n_sources: Column, answer: Column, n_unique: Column, last_end: Column) -> Column:
    """How well an answer is grounded, by the different sources it cites and how far they reach into it."""
    trimmed = F.length(strip(answer))
    return (
        F.when((F.coalesce(n_sources, F.lit(0)) == 0) | (F.coalesce(trimmed, F.lit(0)) == 0), "no-sources")
        .when((n_unique >= 3) & (last_end / trimmed >= 0.6), "well-grounded")
        .when(n_unique >= 2, "synthesized")
        .when(n_unique == 1, "limited")
        .otherwise("interpretive")
    )


def graded(answers: DataFrame) -> DataFrame:
    """trace_id, cited, n_unique, n_total, tier of each answer (trace_id, answer, sources).

    Ids are those of the sources, case and all. How far citations reach is
    measured on the answer as it is shown: what a bracket names besides known
    ids isn't in it.
    """
    known = F.coalesce("sources", F.array().cast("array<string>"))
    brackets = F.regexp_extract_all("answer", F.lit(r"\[([^\[\]]+)\]"), F.lit(1))
    ids = F.transform(brackets, lambda b: F.struct((F.length(b) + 2).alias("n"), F.concat(F.lit("["), b, F.lit("]")).alias("b"), F.filter(F.transform(F.split(b, ","), strip), lambda i: F.array_contains(known, i)).alias("ids")))
    rows = answers.select("trace_id", "answer", "sources", F.filter(ids, lambda x: F.size(x["ids"]) > 0).alias("c"))
    last = F.try_element_at("c", F.lit(-1))["b"]  # what comes behind it has no equal
    hidden = F.aggregate("c", F.lit(0), lambda s, x: s + x["n"] - F.length(F.array_join(x["ids"], ", ")) - 2)
    reach = F.when(F.size("c") > 0, F.length("answer") - F.call_function("instr", F.reverse("answer"), F.reverse(last)) + 1 - hidden).otherwise(0)
    cited = F.array_distinct(F.flatten(F.transform("c", lambda x: x["ids"])))
    rows = rows.select("trace_id", "answer", "sources", F.coalesce(cited, F.array().cast("array<string>")).alias("cited"), F.coalesce(F.size("c"), F.lit(0)).alias("n_total"), reach.alias("reach"))
    tier = confidence_tier(F.size(F.coalesce("sources", F.array())), F.col("answer"), F.size("cited"), F.col("reach"))
    return rows.select("trace_id", "cited", F.size("cited").alias("n_unique"), F.greatest("n_total", F.lit(0)).alias("n_total"), tier.alias("tier"))


def cited_in_order(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """trace_id, work, segment_id, score, position: the best source of each cited work, by where the answer first cites it.

    ``answers``: trace_id, answer, citations; ``sources``: trace_id, work, segment_id, score.
    """
    best = sources.groupBy("trace_id", "work").agg(F.max_by("segment_id", F.struct("score", "segment_id")).alias("segment_id"), F.max("score").alias("score"))
    each = answers.select("trace_id", "answer", F.posexplode("citations").alias("ord", "work"))
    at = F.expr("instr(answer, concat('[', work))")
    placed = each.withColumn("at", F.when(at > 0, at).otherwise(F.lit(2147483647)))
    w = Window.partitionBy("trace_id").orderBy("at", "ord")
    return placed.join(best, ["trace_id", "work"]).withColumn("position", F.row_number().over(w)).select("trace_id", "work", "segment_id", "score", "position")


def corpus_type(works: Column) -> Column:
    """'mixed', 'talk' or 'canonical' by the ids of an answer's sources: those of talks have an underscore."""
    talk = F.exists(works, lambda w: w.contains("_"))
    text = F.exists(works, lambda w: ~w.contains("_"))
    return F.when(talk & text, "mixed").when(talk, "talk").otherwise("canonical")


#: What a prompt says about its sources, by the corpus they are from, and how long an answer should be, by style.
INTRO = {"canonical": "These passages of canonical texts were found for the question below.", "talk": "These excerpts of recorded talks were found for the question below. They are transcripts of speech: put their sense into whole sentences.", "mixed": "These sources were found for the question below: some are canonical texts, some excerpts of recorded talks, which are transcripts of speech."}
GUIDANCE = {"auto": "Let the question decide how long the answer is.", "concise": "Answer in a few sentences.", "detailed": "Answer at length, point by point."}


def system_prompt(corpus: Column, style: str = "auto") -> Column:
    """Instructions for the sources of a corpus type, with the guidance of a style."""
    if style not in GUIDANCE:
        raise ValueError("unknown style")
    table = F.create_map(*(F.lit(x) for p in INTRO.items() for x in p))
    return F.concat(F.coalesce(table[corpus], F.lit(INTRO["canonical"])), F.lit(" Answer from them only, and name the id of a source in square brackets behind what it says.\n- " + GUIDANCE[style]))


def user_message(query: Column, sources: Column) -> Column:
    """The question with its numbered sources (an array of work, segment_id, text), each under its id; without sources, a note that there are none."""
    title = lambda s, i: F.concat(F.lit("--- Source "), (i + 1).cast("string"), F.lit(" ["), s["work"], F.lit("]"), F.when(F.coalesce(s["segment_id"], F.lit("")) != "", F.concat(F.lit(" ("), s["segment_id"], F.lit(")"))).otherwise(""), F.lit(" ---"))
    blocks = F.transform(sources, lambda s, i: F.concat(title(s, i), F.lit("\n"), s["text"], F.lit("\n")))
    asked = F.concat(F.lit("User question: "), query)
    intro = F.create_map(*(F.lit(x) for p in INTRO.items() for x in p))[corpus_type(F.transform(sources, lambda s: s["work"]))]
    none = F.concat(asked, F.lit("\n\n(No source passages were retrieved.)"))
    return F.when(F.size(F.coalesce(sources, F.array())) <= 0, none).otherwise(F.concat_ws("\n", intro, F.lit(""), F.array_join(blocks, "\n"), asked))
