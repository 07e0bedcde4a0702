import itertools
from pathlib import Path

import pyarrow.parquet as pq
import pytest

from corpusloom.llm import residue as K

COMMON = ["The old man went to the house by the river, and the child was in the garden of the page.", "A page of the text is read again in the evening.", "Этот текст читают вечером на странице книги."]
INDEX = None
DOCUMENTS = "/root/testdata/sf0.1/documents.parquet"


def stretches(text):
    global INDEX
    if INDEX is None:
        from collections import Counter

        texts = COMMON * 40
        if Path(DOCUMENTS).exists():  # words as frequent as in texts
            texts += [t for t in pq.read_table(DOCUMENTS, columns=["text"]).column(0).to_pylist() if t]
        c = Counter(w for t in texts for w in K.vocabulary().intersection(K.words_of(t)))
        INDEX = K.Index(c, len(texts))
    return [(text[a:z].strip(), label) for a, z, label, _ in K.residue_of(text, INDEX)]


@pytest.mark.parametrize(
    "text",
    [
        "404 Not Found", "Error 503: Service Unavailable", "Please enable JavaScript to read this text.", "You need to enable JavaScript to run this app.", "Страница не найдена", "Seite nicht gefunden Go back to the start page.",
        "Lorem ipsum dolor sit amet consectetur adipiscing elit.", "asdf asdf asdf qwerty", "qwerty\nqwerty\nqwerty", "Blindtext, Blindtext, Blindtext, Blindtext", "Your text goes here.", "Traceback (most recent call last):\nKeyError: 'uid'",
        "Dear {{ first_name }},", "Chapter {2} of ${title}", "By [INSERT NAME HERE] on NaN/NaN/NaN", "The child went to %(place)s with <?php echo $x; ?> and came back.", "The talk was given by XXXX-XX-XX in the year TBD (verse).", "&lt;excerpt&gt;", "Источник: undefined", "The old man went undefined to the house.", "By undefined on NaN/NaN/NaN", "Chapter 3 of undefined",
    ],
)
def test_residue_alone_and_beside_content(text):
    assert stretches(text)
    assert stretches(f"{COMMON[0]} {COMMON[1]}\n\n{text}\n\n{COMMON[2]}")


def test_residue_within_a_sentence():
    assert stretches("The old man went to Bitte aktivieren Sie JavaScript, um fortzufahren the house by the river.")
    assert stretches("The child listens to Lorem ipsum nostrud irure lorem adipiscing in the evening.")


@pytest.mark.parametrize(
    "text",
    [
        *COMMON, "", " ", "\n", "The teacher joked that a mind is like a page that answers “404 Not Found” whenever you look for it.", "В письме говорили о том, почему надпись «Страница не найдена» учит терпению.",
        "A visitor once asked why printers use lorem ipsum at all.", "In our tool the field written as `{{first_name}}` is replaced by its value.", "Two editors wrote down why [INSERT NAME HERE] must never be left in a finished page.",
        "Variant reading: {si. ka.} adds <araññe>, [the monks] is supplied by the editor.", "The set {1, 2, 3} lists the verses.", "if (a < b) { return a; } counts, x_{i+1} = x_{i} + 1", 'f"{uid}.json" is its name', "He said [laughs] that everything undefined was decided by the elder [see mj10].",
        "We had a test in the evening.", "The word remains undefined until the end.", "It is an undefined term.", "They were gone.", "stray<s></s> characters �", "The page is 404 words long and was not found dull.",
    ],
)
def test_no_residue(text):
    assert stretches(text) == []


def test_index_loses_no_exemplar():
    stretches("")
    for i, (_, words, number) in enumerate(INDEX.order):
        from collections import Counter

        assert i in INDEX.retrieve(Counter(words), True)


def test_rows_of_every_kind(spark):
    rows = [(1, COMMON[0]), (2, None), (3, ""), (4, "404 Not Found"), (5, "404 Not Found"), (6, COMMON[0] + " {{ name }} " + COMMON[1] * 3000), (None, COMMON[1]), (4, "404 Not Found")] + [(10 + i, COMMON[i % 3]) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING").selectExpr("*", "1 AS start", "'x' AS label")
    assert {r["doc_id"] for r in K.residue(df).collect()} == {4, 5, 6}
    clean = K.without_residue(df)
    assert clean.columns == df.columns and {r["doc_id"] for r in clean.collect()} == {r[0] for r in rows} - {4, 5, 6}
    assert K.residue(df.where("false")).count() == 0


def test_every_shape_of_a_placeholder_passes_the_pretest():
    shapes = [
        "{{ name }}", "{% if x %}", "<%= x %>", "<?php echo 1 ?>", "${name}", "#{name}", "%(name)s", "%%NAME%%", "@@name@@", "__NAME__", "$NAME$", "{name}", "{2}", "[INSERT NAME]", "[your name]", "[text goes here]", "[вставьте имя]",
        "<title missing>", "&lt;name&gt;", "TBD", "TBA", "TODO: add a title", "FIXME", "TODO:", "[object Object]", "NaN/NaN", "Invalid Date", "undefined", *("-".join(p) for p in itertools.product(("XXXX", "xxxx", "YYYY", "DDDD"), ("XX", "xx", "MM"), ("XX", "xx", "DD"))),
    ]
    for shape in shapes:
        assert K.SLOT.search(shape) and K.TRIGGER.search(shape), shape
    assert stretches("The talk was given on YYYY-MM-DD in the garden.") == [("YYYY-MM-DD", "placeholder")]


@pytest.mark.parametrize(
    "part, label",
    [("页面未找到", "error_page"), ("请开启JavaScript后继续", "script_notice"), ("Bitte aktivieren Sie JavaScript, um fortzufahren", "script_notice"), ("Lorem ipsum nostrud irure adipiscing", "filler")],
)
def test_residue_within_a_chinese_sentence(part, label):
    whole = f"那位老人走到河边的时候{part}然后回家继续读书，孩子们也在花园里听他讲经。"
    assert (part, label) in stretches(whole)
    assert stretches(f"The old man went to the house 那位老人 {part} by the river.")
    assert stretches(whole.replace(part, f"“{part}”")) == [] == stretches(whole.replace(part, ""))


#: Written after the families and not used to choose them; those that aren't found stay in the list.
HELD_OUT = [
    ("Our service is currently unavailable due to scheduled maintenance.", "error_page"), ("The server encountered an error and could not complete your request.", "error_page"), ("Your session timed out, please log in again.", "error_page"),
    ("Your account has reached the maximum number of requests, please try again later.", "error_page"), ("Unser Server ist derzeit nicht erreichbar.", "error_page"), ("Ce serveur est actuellement indisponible.", "error_page"),
    ("Сайт временно недоступен, повторите попытку позже", "error_page"), ("We use cookies to improve your experience on our website.", "script_notice"), ("We use cookies to personalise ads and analyse traffic.", "script_notice"),
]


#: Wordings of no exemplar. FIRST was written before the general families, by who wrote those, and SECOND after them; the thresholds of
#: ``together`` were set with both in view, so recall on them is that of a development set. THIRD was written when all was fixed and is
#: the held-out one: it was measured once, and nothing was changed for it.
FIRST = [
    'Sorry! That page cannot be located.',
    'The link you followed may be broken, or the page may have been removed.',
    'We are experiencing technical difficulties. Please check back later.',
    'Your request could not be processed at this time.',
    'The server could not understand your request.',
    'You need permission to view this content. Please sign in.',
    'Too many requests from your network. Try again in an hour.',
    'The service is down for planned maintenance until Monday.',
    'An unknown error has occurred. Our team has been notified.',
    'The connection to the database was lost.',
    'This resource is no longer available.',
    'Gateway error: the upstream server did not respond in time.',
    'To view this website, please turn JavaScript on in your browser settings.',
    'Our pages require scripting to be enabled.',
    'You must allow cookies to use this service.',
    'Your browser has JavaScript turned off.',
    'Please wait while we verify that you are human.',
    'This application needs JavaScript in order to work.',
    'Please upgrade your browser to see this content.',
    'Insert your content here.',
    'Add a description of the product.',
    'This is placeholder text that should be replaced.',
    'Write your introduction in this space.',
    'Content will be added shortly.',
    'Replace this paragraph with your own words.',
    'Headline goes here',
    'Die Seite konnte nicht gefunden werden.',
    'Der Zugriff auf diese Seite ist nicht erlaubt.',
    'Bitte schalten Sie JavaScript in Ihrem Browser ein.',
    'Hier fehlt noch der Text.',
    "Cette page n'a pas été trouvée.",
    "Vous n'avez pas l'autorisation d'accéder à cette page.",
    'Vous devez activer JavaScript dans votre navigateur.',
    'Texte à remplacer.',
    'No se encuentra la página.',
    'No tiene permiso para acceder a esta página.',
    'Debe activar JavaScript en su navegador.',
    'Texto de ejemplo.',
    'Такой страницы не существует.',
    'У вас нет прав для просмотра этой страницы.',
    'Включите поддержку JavaScript в браузере.',
    'Здесь скоро появится текст.',
    '您访问的页面不存在。',
    '您没有权限访问此页面。',
    '请在浏览器中启用JavaScript。',
]
SECOND = [
    "We're sorry, this page has moved.",
    "The site encountered a fatal error and has been shut down.",
    "You must be logged in to see this article.",
    "The requested document could not be retrieved from the server.",
    "Access from your country is blocked.",
    "Please activate scripts in your browser and refresh the page.",
    "This content requires cookies; please accept them to proceed.",
    "Are you a robot? Confirm that you are human to continue.",
    "Enter some text here.",
    "Caption goes here.",
    "This section has not been written yet; content will follow.",
    "Die angeforderte Datei existiert nicht auf dem Server.",
    "Bitte erlauben Sie Skripte in Ihrem Browser.",
    "Le serveur a rencontré une erreur inattendue.",
    "Activez JavaScript pour continuer.",
    "El servidor encontró un error inesperado.",
    "Habilite las cookies en su navegador.",
    "Сервер вернул ошибку, попробуйте позже.",
    "Для просмотра сайта включите JavaScript.",
    "服务器发生错误，请稍后再试。",
]


@pytest.mark.skipif(not Path(DOCUMENTS).exists(), reason="no texts to count words in")
def test_recall_of_the_development_lists():
    known = {tuple(words) for _, words, _ in K.exemplars()}
    share = {}
    for name, texts in (("first", FIRST), ("second", SECOND)):
        new = [t for t in texts if tuple(K.words_of(t)) not in known]
        share[name] = sum(bool(stretches(f"{COMMON[0]} {t} {COMMON[1]}")) for t in new) / len(new)
    assert share["first"] >= 0.8 and share["second"] >= 0.8, share
    for t in FIRST[:10]:
        assert stretches(f"Why does the sign say: “{t}” to those who come late?") == []


THIRD = [
    "Oh no, we could not reach the page.",
    "The article you were looking for is gone.",
    "Bad gateway. Please reload in a moment.",
    "Your subscription does not include this page.",
    "Server overload, requests are being dropped.",
    "Invalid token. Authentication failed.",
    "Content blocked in your region.",
    "The query took too long and was cancelled by the server.",
    "Scripts must be permitted for this page to load.",
    "Kindly switch off private mode and enable scripts.",
    "We need to confirm you are not a bot.",
    "Cookie consent is needed before the page opens.",
    "Put your paragraph here.",
    "Draft text, to be completed by the author.",
    "Write two or three sentences about the event.",
    "Image description pending.",
    "Die Webseite ist zurzeit überlastet.",
    "Ihre Sitzung ist abgelaufen.",
    "Ohne JavaScript kann diese Seite nicht angezeigt werden.",
    "Cette ressource a été supprimée du serveur.",
    "Votre session a expiré.",
    "Su sesión ha caducado.",
    "El recurso solicitado fue eliminado.",
    "Ваша сессия истекла, войдите снова.",
    "Запрошенный файл удалён с сервера.",
    "会话已过期，请重新登录。",
    "此内容已被删除。",
    "Sessione scaduta, accedi di nuovo.",
    "Sua sessão expirou.",
    "Sesja wygasła, zaloguj się ponownie.",
]


@pytest.mark.skipif(not Path(DOCUMENTS).exists(), reason="no texts to count words in")
def test_recall_on_the_held_out_list_is_low():
    """5 of 30 when measured: wordings far from the exemplars are not found. A record of that, not a claim."""
    assert sum(bool(stretches(t)) for t in THIRD) >= 5


def test_held_out_wordings():
    known = {tuple(words) for _, words, _ in K.exemplars()}
    assert not any(tuple(K.words_of(text)) in known for text, _ in HELD_OUT)
    got = [(text, label) for text, label in HELD_OUT if [x for _, x in stretches(text)] == [label]]
    assert len(got) >= 5
    assert all(stretches(f"{COMMON[0]}\n\n{text}\n\n{COMMON[2]}") for text, _ in got)


@pytest.mark.parametrize("text", ["The session of the council was long, and the elder left it early.", "We use bowls to carry the rice, and cookies are given to the children.", "The gate of the monastery was closed while the roof was repaired.", "The limit of what the mind can bear has been reached by few."])
def test_prose_near_the_families(text):
    assert stretches(text) == []
