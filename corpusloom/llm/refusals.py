"""How likely a sentence is one that declines to answer, by character n-grams.

Two likelihoods are compared: that of the sentence under what refusals say, and
that under what texts of the corpus say. The first is a mixture of the n-grams
of labelled sentences (below) and the second, so that words neither has seen
speak for no side. Its numbers are fitted when a run starts; sentences that are
put otherwise than the labelled ones are found as far as they share word parts.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np

from corpusloom.llm.ngrams import BUCKETS, NaiveBayes, _own, code_points, framed, gram_ids

# Labelled sentences of refusals, written for this purpose: what can't be done, what sources lack, what isn't known, what one would rather not say.
LABELLED = {
    "eng": """I am not able to answer this. I am unable to respond to your question. I cannot help with that request. I can't assist you here. There is no way for me to answer. It is not possible to give an answer. It is beyond what I can discuss. This is not something I can talk about.
The sources do not mention this. The texts do not address the question. The passages say nothing about it. None of the documents covers this matter. The chapters are silent on the point. The retrieved material does not contain an answer. The excerpts do not speak to this. No relevant passage was found.
I have no information on this subject. There is no information about that. I do not know. I could not find an answer in the sources. I did not find anything relevant. There is not enough data to say. The available information is insufficient.
I would rather not say. I prefer not to comment. I must decline to answer. I will refrain from answering. I would leave the question open. I am sorry, but I have to refuse. Unfortunately this cannot be answered.""",
    "rus": """Я не могу ответить на этот вопрос. Я не в состоянии помочь. Невозможно дать ответ. Мне трудно ответить. Ответить на это нельзя. Я не способен обсуждать эту тему.
В источниках об этом ничего не говорится. Тексты не упоминают об этом. Отрывки не касаются этого вопроса. В материалах нет ответа. Тексты молчат об этом. Найденные фрагменты не содержат сведений.
У меня нет информации по этой теме. У меня нет сведений об этом. Я не знаю. Я не нашёл ответа в источниках. Недостаточно данных для ответа. Сведений недостаточно.
Я предпочту не отвечать. Я вынужден отказаться от ответа. Я воздержусь от комментариев. К сожалению, ответить не получится. Извините, я не стану отвечать.""",
    "deu": """Ich kann diese Frage nicht beantworten. Ich bin nicht in der Lage zu antworten. Dabei kann ich nicht helfen. Es ist mir nicht möglich, darauf zu antworten. Leider kann ich dazu nichts sagen. Hier kann ich nicht weiterhelfen.
Die Quellen sagen dazu nichts. Die Texte erwähnen das nicht. Die Stellen geben darüber keine Auskunft. Das Material enthält keine Antwort. Die Texte schweigen darüber. In den Auszügen steht nichts davon.
Dazu habe ich keine Informationen. Ich weiß es nicht. Ich habe keine Antwort in den Quellen gefunden. Es liegen nicht genügend Angaben vor. Die Angaben reichen nicht aus.
Ich möchte mich dazu nicht äußern. Ich muss die Antwort ablehnen. Ich enthalte mich einer Antwort. Es tut mir leid, das muss offen bleiben. Bedauerlicherweise ist keine Antwort möglich.""",
    "fra": """Je ne peux pas répondre à cette question. Je ne suis pas en mesure de vous aider. Il m'est impossible de répondre. Je suis incapable de répondre. Il n'est pas possible de donner une réponse.
Les sources n'en parlent pas. Les textes ne mentionnent pas ce point. Les passages ne disent rien à ce sujet. Les extraits ne contiennent aucune réponse. Les textes sont muets à ce propos. Les documents restent silencieux sur la question.
Je n'ai pas d'information à ce sujet. Je ne dispose pas de données suffisantes. Je ne sais pas. Je n'ai pas trouvé de réponse dans les sources. Les informations sont insuffisantes. Aucune information n'est disponible.
Je préfère ne pas me prononcer. Je dois refuser de répondre. Je m'abstiens de tout commentaire. Désolé, je dois décliner. Malheureusement, on ne peut pas répondre.""",
    "spa": """No puedo responder a esta pregunta. No soy capaz de contestar. No me es posible ayudarle. No estoy en condiciones de responder. Me resulta imposible dar una respuesta.
Las fuentes no hablan de esto. Los textos no mencionan este punto. Los pasajes no dicen nada al respecto. Los fragmentos no contienen ninguna respuesta. Los textos guardan silencio al respecto. Los documentos no tratan la cuestión.
No tengo información sobre este tema. No dispongo de datos suficientes. No lo sé. No he encontrado una respuesta en los textos. La información es insuficiente. No hay información disponible.
Prefiero no opinar. Debo negarme a responder. Me abstengo de comentar. Lo siento, debo declinar. Lamentablemente no se puede responder.""",
    "por": """Não posso responder a esta pergunta. Não sou capaz de ajudar. Não me é possível responder. Não estou em condições de responder. É impossível dar uma resposta.
As fontes não falam disso. Os textos não mencionam este ponto. As passagens nada dizem a respeito. Os trechos não contêm nenhuma resposta. Os textos silenciam sobre o assunto. Os documentos não tratam da questão.
Não tenho informações sobre o assunto. Não disponho de dados suficientes. Não sei. Não encontrei uma resposta nos textos. A informação é insuficiente. Não há informação disponível.
Prefiro não opinar. Devo recusar a resposta. Abstenho-me de comentar. Lamento, tenho de recusar. Infelizmente não se pode responder.""",
    "ita": """Non posso rispondere a questa domanda. Non sono in grado di aiutarla. Mi è impossibile rispondere. Non riesco a dare una risposta. Non è possibile rispondere.
Le fonti non ne parlano. I testi non menzionano questo punto. I passi non dicono nulla al riguardo. I brani non contengono alcuna risposta. I testi tacciono al riguardo. I documenti non trattano la questione.
Non ho informazioni su questo tema. Non dispongo di dati sufficienti. Non lo so. Non ho trovato una risposta nei testi. Le informazioni sono insufficienti. Non ci sono informazioni disponibili.
Preferisco non esprimermi. Devo rifiutare di rispondere. Mi astengo da ogni commento. Mi dispiace, devo declinare. Purtroppo non si può rispondere.""",
    "nld": """Ik kan deze vraag niet beantwoorden. Ik ben niet in staat te helpen. Het is mij niet mogelijk te antwoorden. Daar kan ik niets over zeggen. Een antwoord is niet mogelijk.
De bronnen zeggen hier niets over. De teksten vermelden dit niet. De passages gaan hier niet op in. De fragmenten bevatten geen antwoord. De teksten zwijgen erover. De documenten behandelen de vraag niet.
Ik heb hierover geen informatie. Ik beschik niet over genoeg gegevens. Ik weet het niet. Ik heb geen antwoord in de teksten gevonden. De informatie is onvoldoende.
Ik wil mij daar liever niet over uitlaten. Ik moet het antwoord weigeren. Ik onthoud mij van commentaar. Het spijt me, ik moet dit afwijzen. Helaas kan dit niet beantwoord worden.""",
    "pol": """Nie mogę odpowiedzieć na to pytanie. Nie jestem w stanie pomóc. Nie da się udzielić odpowiedzi. Odpowiedź nie jest możliwa. Nie potrafię na to odpowiedzieć.
Źródła o tym nie mówią. Teksty nie wspominają o tym. Fragmenty nie dotyczą tej sprawy. Materiały nie zawierają odpowiedzi. Teksty milczą o tym. Dokumenty nie poruszają tego pytania.
Nie mam informacji na ten temat. Nie posiadam wystarczających danych. Nie wiem. Nie znalazłem odpowiedzi w tekstach. Informacje są niewystarczające. Brak dostępnych informacji.
Wolę się nie wypowiadać. Muszę odmówić odpowiedzi. Powstrzymam się od komentarza. Przykro mi, muszę odmówić. Niestety nie można odpowiedzieć.""",
    "zho": """我无法回答这个问题。我不能回答。这个问题回答不了。对此无法作答。很抱歉，我帮不了您。我没有办法回答。
资料中没有提到这一点。这些文本没有谈到此事。经文对此没有说明。材料里没有答案。文中未涉及这个问题。资料里找不到答案。查不到相关的资料。
我没有这方面的信息。我不知道答案。没有足够的资料。信息不足。对此没有答案。
我不便评论。我拒绝回答。恕我不能回答。很遗憾，无法给出答案。""",
    "pli": """Na sakkomi vissajjetuṃ. Nāhaṃ jānāmi. Na sakkā mayā byākātuṃ. Natthi etassa vissajjanaṃ. Imasmiṃ pāṭhe na vuttaṃ. Na icchāmi kathetuṃ. Potthakesu natthi byākaraṇaṃ. Na vissajjemi taṃ pañhaṃ.""",
}

#: Share of the labelled sentences in the mixture; how much a single n-gram may say; mean log odds from which a sentence declines.
SHARE, MOST, LEAST = 0.5, 4.0, 0.6


def labelled() -> list[str]:
    return [s for block in LABELLED.values() for s in re.split(r"(?<=[.。])\s*", block) if s.strip()]


class Refusals:
    """Mean log odds of sentences to be refusals, of texts in lower case (``language.plain``)."""

    def __init__(self, background: Sequence[str], labelled: Sequence[str], smooth: float = 0.3) -> None:
        p, q = self._counts(labelled), self._counts(background) + smooth
        odds = np.log((1 - SHARE) + SHARE * (p / max(1.0, p.sum())) / (q / q.sum()))
        self.bayes = NaiveBayes(["odds"], np.minimum(odds, MOST)[:, None].astype(np.float32))

    @staticmethod
    def _counts(texts: Sequence[str]) -> np.ndarray:
        counts = np.zeros(BUCKETS)
        data, edges = code_points([framed(t) for t in texts])
        own = _own(edges)
        for ids in gram_ids(data):
            counts += np.bincount(ids[own], minlength=BUCKETS)
        return counts

    def odds(self, sentences: Sequence[str]) -> np.ndarray:
        """The mean over the n-grams of each sentence."""
        if not len(sentences):
            return np.zeros(0)
        return self.bayes.sums(sentences)[:, 0] / (3.0 * np.maximum(1, np.array([len(s) + 2 for s in sentences])))
