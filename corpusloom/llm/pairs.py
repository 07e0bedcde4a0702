"""Problem 2: broken pairs of question and answer.

Method: the language posteriors of question and answer come from a character
n-gram naive Bayes and are compared; truncation is told by the likelihood of
the answer's last characters at an end of text against their likelihood within
texts, from n-gram counts over all answers. Refusals are told by the likelihood
of their sentences' n-grams in labelled refusals against texts, and by phrases;
empty answers and copies of the question from the words of both.

One narrow pass counts n-grams, one judges; what is shuffled is one row per
n-gram of character classes and task (their number is fixed), and the defects.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.language import bare, plain, spellings, stretches
from corpusloom.llm.ngrams import NaiveBayes
from corpusloom.llm.refusals import LEAST as LEAST_ODDS
from corpusloom.llm.refusals import Refusals, labelled

DEFECTS = ("empty", "copy", "refusal", "other_language", "truncated")

_LETTER, _HAN = re.compile(r"[^\W\d_]"), re.compile("[㐀-鿿]")
_CITATION = re.compile(r"\[[^\[\]\n]{0,60}\]")
_WORD = re.compile(r"[㐀-鿿]|[^\W\d_㐀-鿿]+")
#: Marks for a missing value, fixed values.
MISSING = re.compile(r"^(?:n\s*/?\s*a|null|nil|none|nan|undefined|missing|no (?:answer|data|value)|empty|void|tbd|k\.?\s?a\.?|н\s*/\s*д|б\s*/\s*о|пусто|无|空)$")
#: Refusals and statements that the sources give no answer, by language; fixed values.
REFUSAL = re.compile(
    r"""not possible for me to|(?:can ?not|can't|can’t|unable to|not able to|won't|will not|must not|may not) (?:help|answer|respond|reply|comment|say|tell|provide|assist|address|offer)|(?:must|have to|need to|prefer to|wish to) (?:decline|refuse|pass)|i (?:must )?(?:decline|refuse)\b|prefer not to (?:say|answer|comment|respond)|(?:would|'d) (?:rather|prefer) not|nothing (?:i|we) can (?:offer|say|add|tell)|nothing to (?:offer|add)|(?:not|nothing)[^.]{0,20} settle the question|no answer can be given|nothing to say (?:on|about)
    |(?:excerpts?|passages?|sources?|texts?|material|documents?|context)\b[^.]{0,40}\b(?:do|does) not (?:address|contain|mention|answer|say|cover|touch|provide|speak|include|discuss|give)|(?:excerpts?|passages?|sources?|texts?|material|context)\b[^.]{0,40}\b(?:say|says|contain|contains|provide|provides) nothing|(?:excerpts?|passages?|sources?|texts?|material)\b[^.]{0,40}\black|none of the (?:retrieved |given |provided |available )?(?:texts|sources|passages|excerpts)|not (?:enough|sufficient) (?:information|data|material)|insufficient (?:information|data)|i (?:do not|don't) (?:know|have (?:an answer|enough))
    |не могу (?:ответить|помочь|сказать|судить)|вынужден\w* отказать|отказываюсь|ответа нет|нет ответа|нечего сказать|судить об этом нельзя|данных для ответа|этого не касаются|не содерж\w+ ответ|не (?:говорит|сказано|упомина)\w* об этом|недостаточно (?:данных|сведений)|предпочту не|не вправе|невозможно ответить|ничего не сказано
    |kann (?:ich )?(?:diese|die|ihre|deine|darauf|dazu|hierzu|das|leider)?[^.]{0,40}(?:nicht|nichts) (?:beantworten|antworten|sagen|helfen|beurteilen)|darf (?:ich )?[^.]{0,20}(?:nicht|nichts)\b|muss ich (?:hier |leider )?(?:passen|ablehnen)|keine antwort|reicht das material|nicht (?:genug|genügend) (?:angaben|daten|informationen)|(?:quellen|texte|auszüge|stellen)\b[^.]{0,40}(?:nichts|keine|nicht)|möchte (?:ich )?(?:mich )?(?:dazu |darauf )?(?:lieber )?(?:nicht|nichts)|lehne ich ab|äußere ich mich nicht|fehlen (?:mir )?(?:die )?(?:angaben|daten|informationen)
    |ne (?:peux|puis|pouvons|saurais)\w* pas (?:vous )?(?:répondre|aider|dire|renseigner)|impossible de (?:vous )?(?:répondre|renseigner|dire|conclure)|préfère ne pas|dois (?:décliner|refuser)|rien dans (?:ces|les) (?:extraits|textes|sources|passages)|(?:sources|textes|extraits|passages)\b[^.]{0,40}ne (?:\w+ )?(?:\w+ )?(?:pas|rien|aucune)|ne (?:contiennent|disent|donnent|traitent|permettent)\b|pas assez (?:d['’]|de )(?:informations|éléments|données)|données (?:manquent|insuffisantes)|manque (?:de )?(?:données|d['’]éléments)|n['’]en (?:parlent|disent|traitent|font)[^.]{0,10} (?:pas|rien|mention)|ne permet de (?:conclure|répondre)|suis au regret
    |no puedo (?:responder|contestar|ayudar|opinar|decir)|prefiero no|debo (?:declinar|rehusar|rechazar)|no hay (?:datos|información|elementos)|(?:fuentes|textos|pasajes|fragmentos)\b[^.]{0,40}\bno (?:tratan|contienen|dicen|responden|mencionan|dan|hablan|permiten)|me es imposible|no me es posible|no (?:tengo|dispongo) (?:de )?(?:respuesta|datos|información)|nada en (?:los|las|estos|estas)
    |não (?:posso|consigo) (?:responder|ajudar|opinar|dizer|comentar)|prefiro não|devo (?:recusar|declinar)|(?:fontes|textos|trechos|passagens)\b[^.]{0,40}\bnão (?:tratam|contêm|contém|dizem|respondem|mencionam|dão|falam|permitem|abordam)|faltam (?:dados|informações|elementos)|não há (?:dados|informações|elementos|resposta)|não me é possível|é-me impossível
    |non (?:posso|possiamo|sono in grado|riesco)(?: di| a)? ?(?:rispondere|aiutar|dire|commentare|esprimermi)?|preferisco non|devo (?:declinare|rifiutare)|mancano (?:i )?(?:dati|gli elementi|elementi|le informazioni|informazioni)|(?:fonti|testi|brani|passi|estratti)\b[^.]{0,40}\bnon (?:trattano|contengono|dicono|rispondono|menzionano|danno|parlano|permettono|affrontano|ne parlano)|non (?:ci sono|ho) (?:abbastanza |sufficienti )?(?:dati|informazioni|elementi|risposta)|mi è impossibile
    |(?:kan|mag|kunnen) (?:ik )?[^.]{0,40}(?:niet|niets|geen)\b|(?:bronnen|teksten|passages|fragmenten)\b[^.]{0,40}(?:niet|niets|geen)\b|te weinig (?:gegevens|informatie|materiaal)|(?:liever|wil) (?:ik )?(?:hier )?(?:niet|niets|geen)|moet (?:ik )?[^.]{0,30}(?:weigeren|afwijzen|passen)|onvoldoende (?:gegevens|informatie)|geen antwoord|(?:laat|spreek) ik (?:mij|me) (?:hierover |daarover )?niet
    |nie mogę (?:\w+ )?(?:odpowiedzieć|pomóc|powiedzieć)|wolę\b[^.]{0,30}\bnie\b|(?:muszę|zmuszon\w+) (?:\w+ )?(?:odmówić|odmawiać)|brakuje (?:mi )?(?:danych|informacji)|(?:źródła|teksty|fragmenty|urywki)\b[^.]{0,40}\bnie\b|nie (?:mówią|zawierają|poruszają|dają|dotyczą)|za mało (?:danych|informacji)|brak (?:danych|odpowiedzi|informacji)|nie (?:ma|znam|jestem w stanie)
    |无法(?:回答|作答|判断|答复|提供)|不能(?:回答|作答|答复|评论)|不足以|没有(?:涉及|提到|回答|答案|说明|谈到|足够)|未(?:涉及|提及|谈到)|不便|不(?:予|宜)(?:评论|发表)|拒绝(?:回答|作答)|(?:资料|信息|材料|内容)不(?:足|够)|找不到答案|恕我|无可奉告|不予(?:回答|置评)
    |na sakkomi|na sakkā (?:mayā )?(?:vissajjetuṃ|vattuṃ|byākātuṃ)|natthi (?:vissajjanaṃ|vissajjanā|byākaraṇaṃ)|na (?:vissajjemi|byākaromi|vadanti|kathenti)|nāhaṃ (?:vattuṃ|vissajjetuṃ|byākātuṃ|jānāmi)|na (?:vattuṃ|vissajjetuṃ) icchāmi""".replace("\n    ", ""),
)
#: What may follow a refusal without answering: advice to ask otherwise or someone else; fixed values.
FOLLOW_UP = re.compile(
    r"ask (?:a|another|your|in)|(?:consult|try|rephras|reword|contact|speak to|turn to)\w*\b|спросите|обратитесь|попробуйте|задайте|переформулируйте|fragen sie|versuchen sie|wenden sie|formulieren sie|adressez|essayez|demandez|reformul|consultez|consulte|intente|pregunte|pruebe|reformule|procure|tente|pergunte|si rivolga|provi|chieda|consulti|riprovi|vraag|probeer|raadpleeg|stel (?:uw|de) vraag|wend u|proszę|zapytaj|spróbuj|zwróć|请(?:换|咨询|询问|向|您|尝试|再|试)|可以(?:换|咨询)|ācariyaṃ|puccha"
)


#: Words by which a sentence that speaks of declining goes on to answer, fixed values.
GOES_ON = re.compile(r"\b(?:and yet|yet|still|but|however|nevertheless|но|однако|aber|doch|dennoch|mais|pourtant|pero|sin embargo|mas|porém|ma|tuttavia|maar|toch|ale|jednak)\b|但是|不过|然而|可是")


def core_of(answer: str) -> str:
    """The answer without citations, invisible characters and what surrounds it."""
    t = plain(_CITATION.sub(" ", answer))
    return t.strip(" *_#>•-–—\"'“”«»„`()[]{}:;,.!?…|/\\。！？")


def is_empty(answer: str | None) -> bool:
    """No words of an answer, only a mark for a missing value, or only citations or list marks."""
    if answer is None:
        return True
    core = core_of(answer)
    if MISSING.match(core):
        return True
    return not _LETTER.search(core) and (not any(ch.isdigit() for ch in core) or bool(re.fullmatch(r"\s*\d{1,3}[.)]\s*", answer)) or not core)


def words_of(text: str) -> list[str]:
    return _WORD.findall(bare(plain(_CITATION.sub(" ", text))))


def is_copy(question: str, answer: str) -> bool:
    """Only the question again, or one of its questions, at most with small changes or marks."""
    q, a = words_of(question), words_of(answer)
    if not q or not a or len(a) > 2.4 * len(q) + 2:
        return False
    own = Counter(q)
    alien = sum(k for w, k in Counter(a).items() if w not in own)
    if alien > max(1, 0.15 * len(a)):
        if abs(len(a) - len(q)) > 3 or SequenceMatcher(None, " ".join(q), " ".join(a), autojunk=False).ratio() < 0.85:
            return False
        return True
    parts = [words_of(p) for _, _, p in stretches(question)] + [q]
    have = Counter(a)
    # How much of the question, or of one of several, is there; and in its order.
    for p in parts:
        if len(p) < 2:
            continue
        held = sum(min(k, have[w]) for w, k in Counter(p).items())
        if held >= 0.7 * len(p) and SequenceMatcher(None, p, a, autojunk=False).ratio() >= 0.5:
            return True
    return False


_SENTENCE = re.compile(r"[^.!?…。！？\n]+[.!?…。！？]*[\"'”’»)\]]*")


def _readable(answer: str) -> str:
    return plain(_CITATION.sub(" ", answer))


class Declines:
    """Whether a sentence declines: it has a phrase of REFUSAL, or its n-grams are likelier in refusals (``refusals``). Sentences seen together are judged together."""

    def __init__(self, refusals: Refusals, sentences: list[str]) -> None:
        self.refusals = refusals
        self.odds = dict(zip(sentences, refusals.odds(sentences)))

    def likely(self, s: str) -> bool:
        if s not in self.odds:
            self.odds[s] = self.refusals.odds([s])[0]
        return self.odds[s] >= LEAST_ODDS and (len(words_of(s)) >= 3)

    def at(self, s: str) -> int | None:
        """Where the part that declines ends, None if none does."""
        if m := REFUSAL.search(s):
            return m.end()
        if not self.likely(s):
            return None
        m = GOES_ON.search(s)
        return m.start() if m and m.start() else len(s)

    def __call__(self, s: str) -> bool:
        return self.at(s) is not None


def is_refusal(question: str, answer: str, declines: Declines) -> bool:
    """Declines, or says that the sources give no answer, and gives none: every sentence declines, points elsewhere, is a phrase or repeats the question."""
    refused = False
    asked = None
    for found in _SENTENCE.finditer(_readable(answer)):
        s = found.group()
        words = words_of(s)
        if (at := declines.at(s)) is not None:
            on = GOES_ON.search(s, at)
            if on and not declines(s[on.end() :]) and not FOLLOW_UP.search(s, on.end()) and len(words_of(s[on.end() :])) >= 4:
                return False
            # A sentence that declines stays short; one that goes on has more to say.
            if len(words) > (60 if _HAN.search(s) else 32):
                return False
            refused = True
        elif FOLLOW_UP.search(s) and len(words) <= 24:
            continue
        elif len(words) >= 5:
            asked = Counter(words_of(question)) if asked is None else asked
            if sum(w in asked for w in words) < 0.8 * len(words):
                return False
    return refused


# ---- languages

#: How languages are called where an answer in one of them is asked for; fixed values.
CALLED = {
    "eng": "english|englisch|английск|anglais|inglés|ingles|inglês|inglese|engels|angielsk|英语|英文",
    "rus": "russian|russisch|русск|russe|ruso|russo|rosyjsk|俄语|俄文",
    "pli": "pali|pāli|палийск|palijsk|巴利",
    "deu": "german|deutsch|немецк|allemand|alemán|aleman|alemão|tedesco|duits|niemieck|德语|德文",
    "fra": "french|französisch|французск|français|francais|francés|frances|francês|francese|frans|francusk|法语|法文",
    "spa": "spanish|spanisch|испанск|espagnol|español|espanol|castellano|espanhol|spagnolo|spaans|hiszpańsk|西班牙",
    "por": "portuguese|portugiesisch|португальск|portugais|portugués|português|portoghese|portugees|portugalsk|葡萄牙",
    "ita": "italian|italienisch|итальянск|italien|italiano|italiaans|włosk|意大利",
    "nld": "dutch|niederländisch|нидерландск|голландск|néerlandais|neerlandés|holandés|holandês|olandese|nederlands|niderlandzk|holendersk|荷兰",
    "pol": "polish|polnisch|польск|polonais|polaco|polonês|polacco|pools|polsk|波兰",
    "zho": "chinese|chinesisch|китайск|chinois|chino|chinês|cinese|chinees|chińsk|中文|汉语|chinese",
    "san": "sanskrit|санскрит", "sin": "sinhala|сингальск", "tha": "thai|тайск", "kor": "korean|корейск", "jpn": "japanese|японск|日语",
}
_ASKING = re.compile(r"answer|repl|respond|write|translat|ответ|отвеч|напиш|перевед|antwort|schreib|übersetz|répon|écri|tradui|respuest|contest|escrib|traduz|traduc|respost|escrev|rispo|scriv|tradu|antwoord|schrijf|vertaal|odpowie|napisz|przetłumacz|回答|用|翻译|译")
_CALLED = [(code, re.compile(rf"(?:\b|(?<=[-用]))(?:{names})")) for code, names in CALLED.items()]


def asked_for(question: str) -> set[str]:
    """Languages in which the question asks to be answered."""
    t = plain(question)
    out = set()
    for s in _SENTENCE.findall(t):
        if _ASKING.search(s):
            out |= {code for code, p in _CALLED if p.search(s)}
    return out


def fit_bayes(texts: dict[str, str]) -> NaiveBayes:
    """The classifier, from the training text of each language (see ``language``), in all its spellings."""
    return NaiveBayes.fit({code: [f for line in t.split("\n") for f in spellings(code, line)] for code, t in texts.items()})


LEAST_LETTERS, MARGIN = 12, 0.12


def languages_apart(bayes: NaiveBayes, pairs: list[tuple[str, str]]) -> list[bool]:
    """For each question and answer: whether the answer's language is none of the question's, nor asked for."""
    answers = [plain(re.sub(r"\([^()]*\)", " ", _CITATION.sub(" ", a))) for _, a in pairs]
    parts, owner = [], []
    for i, (q, _) in enumerate(pairs):
        own = [p for _, _, p in stretches(q)] or [q]
        parts += [plain(p) for p in own]
        owner += [i] * len(own)
    of_answer = bayes.sums(answers)
    of_part = bayes.sums(parts)
    spoken: list[set[int]] = [set() for _ in pairs]
    for i, row in zip(owner, of_part):
        spoken[i].add(int(row.argmax()))
    out = []
    for i, (q, _) in enumerate(pairs):
        best = int(of_answer[i].argmax())
        if best in spoken[i]:
            out.append(False)
            continue
        allowed = spoken[i] | {bayes.classes.index(c) for c in asked_for(q) if c in bayes.classes}
        if best in allowed or len(_LETTER.findall(answers[i])) < (LEAST_LETTERS // 3 if _HAN.search(answers[i]) else LEAST_LETTERS):
            out.append(False)
            continue
        lead = (of_answer[i, best] - max(of_answer[i, j] for j in allowed)) / max(1, 3 * len(answers[i]))
        out.append(bool(lead > MARGIN))
    return out


# ---- ends of texts

_MARKS = ".!?…。！？,;:[]()”“\"'’-—–*•/»«，；：（）|#>"
_KINDS = 6 + len(_MARKS)
_CLASS = None


def classes(data: np.ndarray) -> np.ndarray:
    """Class of each character: letter, digit, Chinese character, blank, line end, mark by mark, other."""
    global _CLASS
    if _CLASS is None:
        t = np.zeros(0x110000, np.int64)
        for cp in range(0x30000):
            ch = chr(cp)
            t[cp] = 1 if ch.isalpha() or unicodedata.combining(ch) else 2 if ch.isdigit() else 4 if ch.isspace() else 0
        t[0x3400:0xA000] = 3
        t[10] = 5
        for i, ch in enumerate(_MARKS):
            t[ord(ch)] = 6 + i
        _CLASS = t
    return _CLASS[data]


def _ending(answer: str) -> str:
    """What the end is judged by: without blanks, invisible characters, marks of emphasis and an ellipsis at the end."""
    t = answer.rstrip()
    while t and (t[-1].isspace() or unicodedata.category(t[-1]) == "Cf" or t[-1] in "*_`"):
        t = t[:-1]
    while t.endswith(("...", "…")):
        t = t[:-3] if t.endswith("...") else t[:-1]
        t = t.rstrip()
    return t


def end_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of class trigrams within texts, and at their ends."""
    within, at_end = np.zeros(_KINDS**3, np.int64), np.zeros(_KINDS**3, np.int64)
    joined = "\n\n\n".join(["", *texts])
    c = classes(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32))
    if len(c) < 3:
        return within, at_end
    g = (c[:-2] * _KINDS + c[1:-1]) * _KINDS + c[2:]
    within += np.bincount(g, minlength=_KINDS**3)
    at = np.cumsum([3 + len(t) for t in texts]) - 1  # last character of each text
    at_end += np.bincount(g[at[[len(t) > 2 for t in texts]] - 2], minlength=_KINDS**3) if texts else 0
    return within, at_end


class Ends:
    """Log ratio of the likelihood of a text's last characters at an end of text to that within texts, with back-off from three characters to one."""

    def __init__(self, within: np.ndarray, at_end: np.ndarray, weight: float = 20.0) -> None:
        w, e = within.reshape((_KINDS,) * 3).astype(float), at_end.reshape((_KINDS,) * 3).astype(float)
        ratio = None
        for axes in ((0, 1), (0,), ()):
            a, b = w.sum(axis=axes), e.sum(axis=axes)
            pa_, pb = a / max(1.0, w.sum()), b / max(1.0, e.sum())
            prior = 1.0 if ratio is None else np.broadcast_to(ratio, a.shape)
            expect = pa_ * max(1.0, e.sum())
            ratio = (b + weight / 10 * prior) / (expect + weight / 10)
            del pb
        self.ratio = ratio
        #: What ends of texts usually have: the median over all of them.
        logs, weight_ = np.log(np.maximum(ratio, 1e-12)).ravel(), e.ravel()
        order = np.argsort(logs)
        total = np.cumsum(weight_[order])
        self.typical = float(logs[order][np.searchsorted(total, total[-1] / 2)]) if total[-1] else 0.0

    def of(self, text: str) -> float:
        c = classes(np.array([0, 0, 0, *map(ord, text[-3:])], np.int64))[-3:]
        return float(np.log(self.ratio[tuple(c)]))


#: By how much (in logarithms) the end of a text that breaks off is less likely than the usual end.
BELOW_TYPICAL = 1.5


def is_truncated(answer: str, ends: Ends) -> bool:
    """Breaks off: a bracket stays open at the end, or the last characters are far less likely at an end of text than what texts usually end with (a number that opens an item of a list, too)."""
    t = _ending(answer)
    tail = t[-80:]
    for o, z in ("[]", "()", "（）"):
        if tail.rfind(o) > tail.rfind(z):
            return True
    return len(t) > 0 and ends.of(t) < ends.typical - BELOW_TYPICAL


def end_counts(df: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Class trigrams within and at the end of all texts of ``df``: one row per trigram and task is shuffled, and their number is fixed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        within, at_end = np.zeros(_KINDS**3, np.int64), np.zeros(_KINDS**3, np.int64)
        for b in batches:
            for at in range(0, len(b), 500):
                w, e = end_grams([_ending(t) for t in b.column(0).slice(at, 500).to_pylist() if not is_empty(t)])
                within += w
                at_end += e
        used = np.flatnonzero(within)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(within[used]), pa.array(at_end[used])], names=["g", "w", "e"])

    rows = df.select(text).mapInArrow(run, "g LONG, w LONG, e LONG").groupBy("g").agg(F.sum("w").alias("w"), F.sum("e").alias("e")).collect()
    within, at_end = np.zeros(_KINDS**3, np.int64), np.zeros(_KINDS**3, np.int64)
    for r in rows:
        within[r["g"]], at_end[r["g"]] = r["w"], r["e"]
    return within, at_end


def fit_refusals(texts: dict[str, str]) -> Refusals:
    """The likelihoods of refusals, against the training text of all languages."""
    return Refusals([plain(line) for t in texts.values() for line in t.split("\n")], [plain(s) for s in labelled()])


def judge(pairs: list[tuple[str | None, str | None]], bayes: NaiveBayes, ends: Ends, refusals: Refusals) -> list[str | None]:
    """The defect of each pair, or None; the first of DEFECTS that holds."""
    out: list[str | None] = ["empty" if is_empty(a) else "copy" if is_copy(q or "", a) else None for q, a in pairs]
    open_ = [i for i, d in enumerate(out) if d is None]
    first = [m.group() for i in open_ if (m := _SENTENCE.search(_readable(pairs[i][1])))]
    declines = Declines(refusals, list(dict.fromkeys(first)))
    for i in open_:
        if is_refusal(pairs[i][0] or "", pairs[i][1], declines):
            out[i] = "refusal"
    rest = [i for i, d in enumerate(out) if d is None]
    apart = languages_apart(bayes, [(pairs[i][0] or "", pairs[i][1]) for i in rest])
    for i, far in zip(rest, apart):
        out[i] = "other_language" if far and pairs[i][0] else "truncated" if is_truncated(pairs[i][1], ends) else None
    return out


def defects(rows: DataFrame, texts: dict[str, str]) -> DataFrame:
    """The defective records of ``rows`` (src, trace_id, question, answer): src, trace_id, defect.

    At most one row per src and trace_id: where rows of one id differ, the first
    defect by the order of DEFECTS. A null answer is empty; a null question is
    compared with nothing. Records without defect have no row.
    """
    sent = rows.sparkSession.sparkContext.broadcast((fit_bayes(texts), Ends(*end_counts(rows, "answer")), fit_refusals(texts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = judge(list(zip(b.column(2).to_pylist(), b.column(3).to_pylist())), *sent.value)
            at = [i for i, d in enumerate(got) if d]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), b.column(1).take(pa.array(at, pa.int64())), pa.array([DEFECTS.index(got[i]) for i in at], pa.int32())], names=["src", "trace_id", "rank"])

    schema = T.StructType([rows.schema["src"], rows.schema["trace_id"], T.StructField("rank", T.IntegerType())])
    found = rows.select("src", "trace_id", "question", "answer").mapInArrow(run, schema)
    first = found.groupBy("src", "trace_id").agg(F.min("rank").alias("rank"))
    return first.select("src", "trace_id", F.element_at(F.array(*map(F.lit, DEFECTS)), F.col("rank") + 1).alias("defect"))
