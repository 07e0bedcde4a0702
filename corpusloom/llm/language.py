"""Problem 3: the language of texts and of their stretches.

Method: cross-parsing entropy. For each language a suffix automaton of labelled
text is built. A stretch is parsed from left to right into the longest phrases
that the automaton holds; the bits to code it are phrases x log2(length of the
language's text), and the language needing fewest bits for the stretch wins.
The difference of the bits gives its confidence.

The labelled text is a bounded sample (documented in ``labelled_sample``) of
rows with a label, beside a few seed sentences per language. As labels may be
wrong, sentences that character n-gram statistics of the whole sample give to
another language are left out: those statistics bear some wrong labels, a
longest match does not.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import zip_longest
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.ngrams import NaiveBayes

# Language codes and English names.
NAMES = {"eng": "english", "rus": "russian", "pli": "pali", "deu": "german", "fra": "french", "spa": "spanish", "por": "portuguese", "ita": "italian", "nld": "dutch", "pol": "polish", "zho": "chinese", "san": "sanskrit", "sin": "sinhala", "tha": "thai", "kor": "korean", "jpn": "japanese"}
OTHER_CODES = {"en": "eng", "ru": "rus", "pi": "pli", "de": "deu", "fr": "fra", "es": "spa", "pt": "por", "it": "ita", "nl": "nld", "pl": "pol", "zh": "zho", "sa": "san", "si": "sin", "th": "tha", "ko": "kor", "ja": "jpn", "ger": "deu", "fre": "fra", "dut": "nld", "chi": "zho", "cmn": "zho", "pal": None}

#: Seed sentences per language; with them even a table without labels has models.
SEEDS = {
    "eng": "What is the meaning of this and why does it matter? Where do the texts say how a person should live? Is it true that they were there when he came? I would like to know which of these is better for the people who want to learn. How are the two related to each other? Could you explain when that becomes a problem? The old man and the child went to the house by the river, but nobody was there.",
    "rus": "Что это значит и почему это важно? Где в текстах говорится о том, как человек должен жить? Правда ли, что они были там, когда он пришёл? Я хотел бы знать, что из этого лучше для людей, которые хотят учиться. Как они связаны между собой? Расскажите, пожалуйста, когда это становится трудным. Старик и ребёнок пошли в дом у реки, но там никого не было.",
    "pli": "Evaṃ me sutaṃ. Ekaṃ samayaṃ bhagavā sāvatthiyaṃ viharati jetavane anāthapiṇḍikassa ārāme. Tatra kho bhagavā bhikkhū āmantesi. Kathaṃ nu kho bhante vuttaṃ hoti? Kiṃ panetaṃ, kattha ca bhikkhu viharati? Idha bhikkhave bhikkhu sato ca sampajāno ca hoti. Manopubbaṅgamā dhammā manoseṭṭhā manomayā. Sabbe saṅkhārā aniccā ti yadā paññāya passati, atha nibbindati dukkhe.",
    "deu": "Was bedeutet das und warum ist es wichtig? Wo steht in den Texten, wie ein Mensch leben soll? Ist es wahr, dass sie dort waren, als er kam? Ich möchte wissen, welches davon für die Menschen besser ist, die lernen wollen. Wie hängen die beiden zusammen? Können Sie mir erklären, wann das zu einem Problem wird? Der alte Mann und das Kind gingen zum Haus am Fluss, aber niemand war da.",
    "fra": "Que signifie cela et pourquoi est-ce important ? Où trouve-t-on dans les textes comment une personne doit vivre ? Est-il vrai qu'ils étaient là quand il est venu ? Je voudrais savoir ce qui est mieux pour les gens qui veulent apprendre. Quel est le lien entre les deux ? Pouvez-vous m'expliquer quand cela devient un problème ? Le vieil homme et l'enfant sont allés à la maison près du fleuve, mais personne n'était là.",
    "spa": "¿Qué significa esto y por qué es importante? ¿Dónde dicen los textos cómo debe vivir una persona? ¿Es verdad que estaban allí cuando él vino? Quisiera saber cuál de estos es mejor para la gente que quiere aprender. ¿Cómo se relacionan los dos? ¿Puede explicarme cuándo se convierte en un problema? El viejo y el niño fueron a la casa junto al río, pero nadie estaba allí.",
    "por": "O que significa isto e por que é importante? Onde dizem os textos como uma pessoa deve viver? É verdade que eles estavam lá quando ele veio? Eu gostaria de saber qual destes é melhor para as pessoas que querem aprender. Qual é a relação entre os dois? Você pode me explicar quando isso se torna um problema? O velho e a criança foram à casa junto ao rio, mas ninguém estava lá.",
    "ita": "Che cosa significa questo e perché è importante? Dove dicono i testi come deve vivere una persona? È vero che erano là quando lui è venuto? Vorrei sapere quale di questi è meglio per la gente che vuole imparare. Qual è il legame tra i due? Può spiegarmi quando diventa un problema? Il vecchio e il bambino andarono alla casa vicino al fiume, ma non c'era nessuno.",
    "nld": "Wat betekent dit en waarom is het belangrijk? Waar staat in de teksten hoe een mens moet leven? Is het waar dat zij daar waren toen hij kwam? Ik zou graag willen weten welke van deze beter is voor de mensen die willen leren. Wat is het verband tussen de twee? Kunt u mij uitleggen wanneer dat een probleem wordt? De oude man en het kind gingen naar het huis aan de rivier, maar er was niemand.",
    "pol": "Co to znaczy i dlaczego jest to ważne? Gdzie w tekstach jest powiedziane, jak człowiek powinien żyć? Czy to prawda, że byli tam, kiedy on przyszedł? Chciałbym wiedzieć, co z tego jest lepsze dla ludzi, którzy chcą się uczyć. Jaki związek mają ze sobą? Czy może pan wyjaśnić, kiedy to staje się problemem? Stary człowiek i dziecko poszli do domu nad rzeką, ale nikogo tam nie było.",
    "zho": "这是什么意思，为什么这么重要？经文里哪里说人应该怎样生活？他来的时候他们真的在那里吗？我想知道其中哪一个对想学习的人更好。这两者之间有什么关系？请您解释一下什么时候会成为问题。老人和孩子去了河边的房子，可是那里没有人。",
    "san": "evaṃ mayā śrutam ekasmin samaye bhagavān śrāvastyāṃ viharati sma. yogaś cittavṛttinirodhaḥ tadā draṣṭuḥ svarūpe'vasthānam. dharmakṣetre kurukṣetre samavetā yuyutsavaḥ.",
}
#: Languages that their script alone tells. Ranges of code points.
SCRIPTS = (("tha", 0x0E00, 0x0E7F), ("kor", 0xAC00, 0xD7AF), ("kor", 0x1100, 0x11FF), ("jpn", 0x3040, 0x30FF), ("sin", 0x0D80, 0x0DFF), ("san", 0x0900, 0x097F), ("zho", 0x3400, 0x9FFF))
#: Russian in Latin letters as passports and libraries write it, fixed values.
RUSSIAN_IN_LATIN = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "a b v g d e e zh z i y k l m n o p r s t u f kh ts ch sh shch _ y _ e yu ya".replace("_", "").split(" ")))

SAMPLE_ROWS, SAMPLE_CHARS = 600, 14_000
LEAST_WORDS, LEAST_CJK = 3, 4

_SPLIT = re.compile(r"[.!?…]+[\"'”’»)\]]*(?=\s|$)|[。！？；]|[\n\r]+|\s+[/|—–]\s+|\s[-]\s|(?=[¿¡])|;\s")
_ASIDE = re.compile(r"\([^()]*\)|（[^（）]*）|\[[^\[\]]*\]")
_LETTERS = re.compile(r"[^\W\d_]+")
_CJK = re.compile(r"[㐀-鿿\u3040-\u30FF\u0E00-\u0E7F]")  # written without blanks


def label_code(label: str | None) -> str | None:
    """The code that a label names: by a two- or three-letter code, with or without region or script, or an English name; else None."""
    if not label:
        return None
    s = label.strip().lower()
    for code, name in NAMES.items():
        if s in (code, name):
            return code
    head = re.split(r"[-_]", s)[0]
    return head if head in NAMES else OTHER_CODES.get(head)


def label_column(c: Column) -> Column:
    """The same as an expression of the JVM."""
    s = F.lower(F.trim(c))
    head = F.regexp_extract(s, r"^([^-_]*)", 1)
    pairs = [(k, k) for k in NAMES] + [(k, v) for k, v in OTHER_CODES.items() if v]
    table = F.create_map(*(F.lit(x) for p in pairs for x in p))
    names = F.create_map(*(F.lit(x) for code, name in NAMES.items() for x in (name, code)))
    return F.coalesce(names[s], table[head])


def _class_of(fits) -> re.Pattern:
    """A pattern for runs of the characters that fit."""
    at = [cp for cp in range(sys.maxunicode + 1) if not 0xD800 <= cp < 0xE000 and fits(chr(cp))]
    new = [i for i, cp in enumerate(at) if i == 0 or at[i - 1] != cp - 1]
    runs = [(at[i], at[(new + [len(at)])[k + 1] - 1]) for k, i in enumerate(new)]
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{z:08x}" for a, z in runs) + "]+")


_INVISIBLE = _class_of(lambda ch: unicodedata.category(ch) == "Cf")
_MARKS = _class_of(unicodedata.combining)


@lru_cache(maxsize=50_000)
def plain(text: str) -> str:
    """Lower case, composed, without invisible characters, runs of blanks as one."""
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text).lower())
    return " ".join(text.lower().split())


def bare(text: str) -> str:
    """Without the marks on letters."""
    if text.isascii():
        return text
    t = _MARKS.sub("", unicodedata.normalize("NFD", text))
    return t.replace("ł", "l").replace("ß", "ss").replace("ø", "o").replace("æ", "ae").replace("œ", "oe")


def in_latin(text: str) -> str:
    return "".join(RUSSIAN_IN_LATIN.get(ch, ch) for ch in text)


@lru_cache(maxsize=50_000)
def spellings(code: str, text: str) -> list[str]:
    """A text as its language may write it: with and without marks, and Russian in Latin letters."""
    t = plain(text)
    out = [t] if bare(t) == t or code == "rus" else [t, bare(t)]
    return [*out, in_latin(t)] if code == "rus" else out


class SuffixAutomaton:
    """All substrings of a text, as the transitions of its smallest automaton."""

    def __init__(self, text: str) -> None:
        follow: list[dict[str, int]] = [{}]
        link, length, last = [-1], [0], 0
        for ch in text:
            new = len(follow)
            follow.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and ch not in follow[p]:
                follow[p][ch] = new
                p = link[p]
            if p >= 0:
                q = follow[p][ch]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    twin = len(follow)
                    follow.append(dict(follow[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and follow[p].get(ch) == q:
                        follow[p][ch] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            last = new
        self.follow, self.bits = follow, log2(len(text) + 2)

    def phrases(self, text: str, most: float) -> int:
        """Longest-match phrases that ``text`` needs; stops counting beyond ``most``."""
        follow, n, i, count = self.follow, len(text), 0, 0
        while i < n:
            state = 0
            k = i
            while k < n:
                to = follow[state].get(text[k])
                if to is None:
                    break
                state = to
                k += 1
            i = max(k, i + 1)
            count += 1
            if count > most:
                break
        return count


class Languages:
    """A suffix automaton per language."""

    def __init__(self, texts: dict[str, str]) -> None:
        self.models = {code: SuffixAutomaton(t) for code, t in texts.items()}
        self.decide = lru_cache(maxsize=200_000)(self._decide)

    def _decide(self, stretch: str) -> tuple[str | None, float]:
        """The language of a stretch without aside and its confidence; None if no script or model fits."""
        if code := _by_script(stretch):
            return code, 1.0
        t = plain(stretch)
        if not t:
            return None, 0.0
        best: list[tuple[float, str]] = []
        least = float("inf")
        for code, m in self.models.items():
            n = m.phrases(t, (least + 40) / m.bits)
            bits = n * m.bits
            least = min(least, bits)
            best.append((bits, code))
        best.sort()
        # Text that no language knows falls into phrases of about two characters.
        if best[0][0] / self.models[best[0][1]].bits > len(t) / 2.2:
            return None, 0.0
        return best[0][1], 1 / sum(2 ** max(-60.0, best[0][0] - b) for b, _ in best)


def stretches(text: str) -> Iterator[tuple[int, int, str]]:
    """Sentences and questions of a text that are long enough to have a language: start, end, text without asides."""
    at = 0
    for m in [*_SPLIT.finditer(text), None]:
        a, z = at, (m.start() if m else len(text))
        end = m.end() if m else len(text)
        at = end
        part = _ASIDE.sub(" ", text[a:z]).strip()
        if len(_LETTERS.findall(part)) >= LEAST_WORDS or len(_CJK.findall(part)) >= LEAST_CJK:
            yield a, end, part


def labelled_sample(rows: DataFrame, rows_per_label: int = SAMPLE_ROWS) -> dict[str, list[str]]:
    """Sentences by the code of their label from ``rows`` (text, code); the driver gets a bounded sample, whatever the size of the table.

    At most ``rows_per_label`` texts a language, of 12 to 2,000 characters,
    those with the smallest hash; ``training_texts`` takes at most SAMPLE_CHARS
    characters of them. A first pass counts rows per code; only rows whose hash
    is small enough for their code are shuffled, some times more than are
    wanted, as texts repeat. Where a language comes out short of what it has,
    its share is widened.
    """
    fit = rows.where("code IS NOT NULL AND text IS NOT NULL AND length(text) BETWEEN 12 AND 2000").select("text", "code", F.xxhash64("text").alias("h"))
    counts = {r["code"]: r["n"] for r in fit.groupBy("code").agg(F.count("*").alias("n")).collect()}
    share = {code: min(1.0, 8 * rows_per_label / n) for code, n in counts.items()}
    w = Window.partitionBy("code").orderBy("h", "text")
    out: dict[str, list[str]] = {}
    while share:
        small = F.create_map(*(F.lit(x) for c, p in share.items() for x in (c, int(-(1 << 63) + p * ((1 << 64) - 1)) if p < 1 else (1 << 63) - 1)))
        # A text that stands in many rows counts once, under the label most of them give it; all of them are below the largest share.
        top = max(share.values())
        near = fit if top >= 1 else fit.where(F.col("h") <= int(-(1 << 63) + top * ((1 << 64) - 1)))
        votes = near.groupBy("text", "code", "h").agg(F.count("*").alias("n")).groupBy("text", "h").agg(F.max_by("code", F.struct("n", "code")).alias("code"))
        kept = votes.where(F.col("h") <= small[F.col("code")]).withColumn("r", F.row_number().over(w)).where(F.col("r") <= rows_per_label)
        got: dict[str, list[str]] = {}
        for r in sorted(kept.select("code", "h", "text").collect()):
            got.setdefault(r["code"], []).append(r["text"])
        out.update({c: t for c, t in got.items() if c in share})
        share = {c: min(1.0, 16 * p) for c, p in share.items() if p < 1 and len(got.get(c, ())) < rows_per_label}
    return out


def training_texts(sample: dict[str, list[str]], chars: int = SAMPLE_CHARS) -> dict[str, str]:
    """Text per language of at most ``chars`` characters a spelling: seeds and the sentences whose label holds."""
    pieces = {code: [part for t in texts for _, _, part in stretches(t)] for code, texts in sample.items()}

    pieces = {code: [p for p in ps if _by_script(p) in (None, code) and (code != "zho" or _by_script(p))] for code, ps in pieces.items()}
    kept = {code: list(ps) for code, ps in pieces.items()}
    for _ in range(2):  # statistics of all, then of those that agreed
        labelled = {code: [f for p in [SEEDS.get(code, ""), *kept.get(code, ())] for f in spellings(code, p)] for code in sorted(set(SEEDS) | set(kept))}
        bayes = NaiveBayes.fit(labelled)
        for code, ps in pieces.items():
            if ps:
                # A language with little text has its wrong labels in high concentration: sizes count too.
                forms = [plain(p) for p in ps]
                lead = np.log([sum(map(len, labelled[c])) for c in bayes.classes])
                best = (bayes.sums(forms) + 3.0 * np.array([[len(f)] for f in forms]) * lead).argmax(axis=1)
                kept[code] = [p for p, j in zip(ps, best) if bayes.classes[j] == code]
    def build(ps: dict[str, list[str]]) -> dict[str, str]:
        out = {}
        for code in sorted(set(SEEDS) | set(pieces)):
            own, held = [SEEDS.get(code, "")], 0
            for p in ps.get(code, ()):
                if held > chars:
                    break
                own.append(p)
                held += len(p)
            out[code] = "\n".join(dict.fromkeys(f for p in own for f in spellings(code, p)))
        return out

    # A sentence must also be told right by the automata of the half it isn't in: in its own it is one phrase.
    halves = [{code: ps[i::2] for code, ps in kept.items()} for i in (0, 1)]
    judges = [Languages(build(h)) for h in reversed(halves)]
    return build({code: [p for pair in zip_longest(*([q for q in h[code] if j.decide(q)[0] == code] for h, j in zip(halves, judges))) for p in pair if p] for code in kept})


def _by_script(stretch: str) -> str | None:
    """The language that the script of most letters tells, if one does."""
    letters = "".join(_LETTERS.findall(stretch))
    for code, lo, hi in SCRIPTS:
        n = sum(lo <= ord(ch) <= hi for ch in letters)
        if n and n * (2 if code == "zho" else 3) >= len(letters):
            return code
    return None


_made: dict[int, Languages] = {}


def model(texts: dict[str, str]) -> Languages:
    """The automata of ``texts``, built once per worker."""
    k = hash(tuple(sorted(texts.items())))
    if k not in _made:
        _made.clear()
        _made[k] = Languages(texts)
    return _made[k]


def identify(df: DataFrame, texts: dict[str, str], keys: list[str], text: str) -> DataFrame:
    """Each stretch of ``text`` that has a language: keys, start, end, language, confidence.

    Stretches are sentences and questions of at least 3 words, or 4 characters
    of Chinese; what stands in brackets counts with none. Null and empty texts
    and texts without words have no row, nor have stretches that no language
    knows. Repeated rows repeat.
    """
    sent = df.sparkSession.sparkContext.broadcast(texts)
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(sent.value)
        for b in batches:
            rows = []
            for i, t in enumerate(b.column(n).to_pylist()):
                for a, z, part in stretches(t) if t else ():
                    code, sure = m.decide(part)
                    if code:
                        rows.append((i, a, z, code, sure))
            if rows:
                at, a, z, code, sure = zip(*rows)
                at = pa.array(at)
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(at) for k in range(n)), pa.array(a, pa.int32()), pa.array(z, pa.int32()), pa.array(code), pa.array(sure, pa.float64())], names=[*keys, "start", "end", "language", "confidence"])

    schema = T.StructType([*(df.schema[k] for k in keys), *T._parse_datatype_string("start INT, end INT, language STRING, confidence DOUBLE").fields])
    return df.select(*keys, text).mapInArrow(run, schema)
