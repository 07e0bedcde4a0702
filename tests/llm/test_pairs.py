import pytest

from corpusloom.llm import pairs
from corpusloom.llm.language import SEEDS, training_texts

TEXTS = training_texts({})
DONE = [f"{s.strip()} It ends here [mj1]." for s in SEEDS["eng"].split("?")] * 5 + ["The river is long.", "They went home!"] * 20


@pytest.fixture(scope="module")
def judge():
    bayes, ends, refusals = pairs.fit_bayes(TEXTS), pairs.Ends(*pairs.end_grams(DONE)), pairs.fit_refusals(TEXTS)
    return lambda q, a: pairs.judge([(q, a)], bayes, ends, refusals)[0]


Q = "Where do the texts say how a person should live?"


@pytest.mark.parametrize("answer", [None, "", " \n", "​", "—", "n/a.", "NULL", "> ", "()", "[mj1]", "[mj1] [mj2]", "…", "**"])
def test_empty(judge, answer):
    assert judge(Q, answer) == "empty"


@pytest.mark.parametrize("answer", [Q, Q.upper(), "where do the texts say how a person should live", f"“{Q}”", f"{Q} {Q}", "Where do texts say how a person should live? [mj1]"])
def test_copy(judge, answer):
    assert judge(Q, answer) == "copy"


@pytest.mark.parametrize("answer", ["I cannot answer this question.", "The sources do not contain an answer. Please consult a teacher.", "К сожалению, данных для ответа недостаточно.", "Je préfère ne pas me prononcer.", "现有的段落不足以回答。"])
def test_refusal(judge, answer):
    assert judge(Q, answer) == "refusal"


# Wordings that are not among the labelled sentences. FIRST was written before those by who wrote them, and the threshold was set with it
# in view: a development list. SECOND and THIRD were written after all was fixed and measured once: 17 of 26 and 14 of 23.
FIRST = [
    "I'm sorry, but I have no way of answering that.",
    'Sorry, this is beyond what I am able to discuss.',
    'The retrieved chapters do not speak to this matter.',
    'Unfortunately there is no information about this in the library.',
    'I would prefer to leave this question open.',
    'That is not something I can assist with.',
    "I couldn't find an answer in the available sources.",
    'The texts are silent on this point.',
    'Извините, я не в состоянии ответить на этот вопрос.',
    'В имеющихся источниках ничего не говорится об этом.',
    'К сожалению, у меня нет сведений по этой теме.',
    'Тексты об этом молчат.',
    'Я воздержусь от ответа.',
    'Es tut mir leid, dazu habe ich keine Informationen.',
    'Leider kann ich Ihnen hier nicht weiterhelfen.',
    'Die Texte schweigen zu diesem Punkt.',
    'Darüber geben die Stellen keine Auskunft.',
    'Ich bin nicht in der Lage, das zu beantworten.',
    'Désolé, je ne suis pas en mesure de répondre.',
    'Les textes sont muets sur ce point.',
    "Je n'ai trouvé aucune réponse dans les sources.",
    "Je ne dispose d'aucune information à ce sujet.",
    "Je m'abstiendrai de répondre.",
    'Lo siento, no soy capaz de responder a eso.',
    'Los textos guardan silencio sobre este punto.',
    'No he encontrado respuesta en las fuentes.',
    'No cuento con información suficiente.',
    'Me abstengo de responder.',
    'Lamento, não sou capaz de responder.',
    'Os textos nada dizem sobre isso.',
    'Não encontrei resposta nas fontes.',
    'Não tenho informações suficientes.',
    'Abstenho-me de responder.',
    'Mi spiace, non sono in grado di rispondere.',
    'I testi tacciono su questo punto.',
    'Non ho trovato risposta nelle fonti.',
    'Non dispongo di informazioni sufficienti.',
    'Mi astengo dal rispondere.',
    'Sorry, ik ben niet in staat dit te beantwoorden.',
    'De teksten zwijgen hierover.',
    'Ik heb geen antwoord gevonden in de bronnen.',
    'Ik beschik niet over voldoende informatie.',
    'Przepraszam, nie jestem w stanie odpowiedzieć.',
    'Teksty milczą na ten temat.',
    'Nie znalazłem odpowiedzi w źródłach.',
    'Nie posiadam wystarczających informacji.',
    '抱歉，我回答不了这个问题。',
    '这些经文没有谈及此事。',
    '资料里查不到相关内容。',
    '对此我没有答案。',
]
SECOND = [
    "I'm afraid I can't say anything about this.",
    'Nothing in the collection deals with your question.',
    'We lack the evidence to give an answer.',
    'Sorry, I must pass on this one.',
    'Увы, в найденных текстах этот вопрос не рассматривается.',
    'Простите, мне нечего ответить.',
    'Ответа в собрании нет.',
    'Zu dieser Frage findet sich in der Sammlung nichts.',
    'Ich muss leider passen.',
    'Das lässt sich anhand der Texte nicht klären.',
    'La collection ne traite pas de cette question.',
    'Je regrette, je ne saurais répondre.',
    'Rien dans les textes ne permet de trancher.',
    'La colección no trata esta pregunta.',
    'Disculpe, no sabría responder.',
    'Nada en los textos permite decidirlo.',
    'A coleção não aborda esta pergunta.',
    'Desculpe, não saberia responder.',
    'La raccolta non affronta questa domanda.',
    'Mi scusi, non saprei rispondere.',
    'De verzameling behandelt deze vraag niet.',
    'Neem me niet kwalijk, dat weet ik niet.',
    'Zbiór nie porusza tej kwestii.',
    'Przepraszam, nie umiem odpowiedzieć.',
    '文集里没有讨论这个问题。',
    '不好意思，我答不上来。',
]


THIRD = [
    "I must leave this unanswered.",
    "The library offers nothing on the subject you raise.",
    "That lies outside of what I can speak about.",
    "My material does not reach that far.",
    "I'd rather leave that to a teacher.",
    "На это я вам ничего сказать не сумею.",
    "Материалов по вашему вопросу нет.",
    "Darauf weiß ich keine Antwort.",
    "Zu Ihrer Frage liegt mir nichts vor.",
    "Je n'ai pas la réponse.",
    "Cette question dépasse ce que je peux dire.",
    "No tengo la respuesta.",
    "Esa pregunta queda fuera de mi alcance.",
    "Não sei responder a isso.",
    "Sobre isso não encontro nada.",
    "Non ho la risposta.",
    "Questa domanda va oltre ciò che posso dire.",
    "Dat weet ik helaas niet.",
    "Hier heb ik geen bronnen over.",
    "Nie znam odpowiedzi.",
    "W zbiorach nic o tym nie ma.",
    "这个问题超出了我的能力。",
    "我这里没有相关的记载。",
]


def test_refusals_that_were_not_labelled(judge):
    found = lambda answers: sum(judge(Q, a) == "refusal" for a in answers) / len(answers)
    assert found(FIRST) >= 0.9 and found(SECOND) >= 0.6 and found(THIRD) >= 0.55
    content = ["The teacher could not find the path, but the novice showed it to her.", "Silence is the answer of the wise, and patience follows it.", "Ученик не мог найти тропу, но наставник показал её."]
    assert found(content) == 0


def test_a_number_that_opens_an_item_is_no_end():
    done = [*DONE, *["1. The child went home.\n2. The man stayed there.\n3. They met at the river."] * 300]
    ends = pairs.Ends(*pairs.end_grams(done))
    assert pairs.is_truncated("The old man went home.\n2. The child went to the river.\n3.", ends)
    assert not pairs.is_truncated(done[-1], ends)


def test_other_language_unless_asked_for(judge):
    german = "Der alte Mann und das Kind gingen zum Haus am Fluss, aber niemand war da."
    assert judge(Q, german) == "other_language"
    assert judge(Q + " Please answer in German.", german) is None
    assert judge(Q + " Was bedeutet das und warum ist es wichtig?", german) is None


@pytest.mark.parametrize("answer", ["The old man and the child went to the house by the", "The old man went there. They lived by the river because", "The old man went there [mj", "The old man and the child went to the house…", "The old man went home,"])
def test_truncated(judge, answer):
    assert judge(Q, answer) == "truncated"


@pytest.mark.parametrize("answer", ["No.", "Yes, for most people.", "The old man and the child went to the house by the river.", f"{Q} The old man went to the house by the river, and the child too.", "The elder said: “I cannot answer this,” and yet the old man went to the house by the river.", "The old man went to the house by the river [mj1]."])
def test_no_defect(judge, answer):
    assert judge(Q, answer) is None


def test_one_row_per_record_whatever_the_columns(spark):
    rows = [("answers", "1", Q, None), ("answers", "1", Q, None), ("feedback", "1", Q, Q), ("answers", "2", None, "They went home!"), ("answers", "3", "", "")]
    df = spark.createDataFrame(rows, "src STRING, trace_id STRING, question STRING, answer STRING").selectExpr("*", "1 AS rank", "'x' AS defect")
    got = {tuple(r) for r in pairs.defects(df, TEXTS).collect()}
    assert {("answers", "1", "empty"), ("feedback", "1", "copy"), ("answers", "3", "empty")} <= got
    assert len(got) == len({g[:2] for g in got})
    assert pairs.defects(df.where("false"), TEXTS).count() == 0
