"""Problem 9: template residue, filler and error-page text.

Method: labelled residue exemplars are retrieved through an inverted index and
held against windows of passages by TF-IDF containment.

- The exemplars (below) are short texts labelled as error page, notice, filler,
  stack trace or keyboard noise. An inverted index leads from each of their
  words to them. An unfilled placeholder is a word of the index, too: its shapes
  are few, and its exemplar is that word alone.
- Document frequencies of the exemplars' words are counted over all documents;
  they weigh the words. The words of an exemplar are sorted by weight, and only
  so many of the heaviest go into the index as any window must share one of
  if it is to contain the exemplar (prefix filtering: nothing is lost by it).
- A window is a sentence or line of a document, or a placeholder within it. An
  exemplar is retrieved if the window holds enough of its weight; the window is
  residue if the retrieved exemplars, all of one kind or not, cover enough of
  the weight of the window. Where none is contained, exemplars of one label that
  share rare words with the window must cover enough of it together.
  A sentence that quotes an error page holds the exemplar, but the exemplar
  does not cover the sentence: it is no residue.
- A placeholder is residue unless its sentence speaks about it, it is quoted as
  code, or it is part of a notation.

Two narrow passes over the documents; what is shuffled is one count per word
of the exemplars and task, what is broadcast is bounded by the exemplar list.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Labelled exemplars of residue. N stands for a number.
ERROR_PAGES = """
N Not Found | Error N: Not Found | HTTP N Not Found | N Forbidden | N Unauthorized | N Bad Gateway | N Gateway Timeout | N Service Unavailable | N Gone
N Internal Server Error | N Too Many Requests | N Bad Request | N Method Not Allowed | N Request Timeout | HTTP N | Error N | Page not found | Service Unavailable
We can't find that page | We could not find the page you were looking for | The page you requested may have been moved or deleted | The requested URL was not found on this server
Access denied | Access to this resource is denied | You do not have permission to view this text | You don't have permission to access this page | Please log in to continue
Something went wrong | Oops! | An unexpected error occurred | Please try again later | If the problem persists, contact the administrator | Go back to the start page | Return to the home page
This account has been suspended | Your session has expired | Database connection failed | Error establishing a database connection | This site is under maintenance | Sorry, this content is no longer available
nginx-like server at texts.example | nginx server | Apache Server at localhost Port N | Ref #N | Request ID N
Seite nicht gefunden | Die angeforderte Seite wurde nicht gefunden | Bitte versuchen Sie es später noch einmal | Zugriff verweigert | Interner Serverfehler
Page introuvable | La page demandée n'existe pas | Accès refusé | Veuillez réessayer plus tard | Erreur interne du serveur
La página solicitada no existe | Página no encontrada | El sitio está en mantenimiento | Acceso denegado | Inténtelo de nuevo más tarde
Страница не найдена | Запрашиваемая страница не существует | Ошибка сервера | Попробуйте обновить страницу позже | Доступ запрещён | Сайт временно недоступен
Pagina non trovata | Página não encontrada | Strona nie została znaleziona | Pagina niet gevonden | 页面未找到 | 找不到该页面 | 服务器错误 | 访问被拒绝
"""
SCRIPT_NOTICES = """
Enable JavaScript and cookies to continue | Scripts are blocked in your browser | Scripts and cookies are required
Loading… If nothing appears, allow scripts for this site | If nothing appears, allow scripts for this site | Loading… | Noscript: this reader does not work without client-side scripting | This page requires JavaScript | JavaScript is disabled in your browser
Checking your browser before you can read on… This takes a few seconds | This takes a few seconds | Your browser is not supported | Your browser does not support this feature
Bitte aktivieren Sie JavaScript, um diese Seite zu lesen | Bitte aktivieren Sie JavaScript, um fortzufahren | Veuillez activer JavaScript pour afficher cette page | Este sitio necesita JavaScript para funcionar | Active JavaScript para continuar
Для работы сайта необходим JavaScript | Для работы сайта включите JavaScript в настройках браузера | Abilita JavaScript per continuare | Ative o JavaScript para continuar | Włącz JavaScript, aby kontynuować | Schakel JavaScript in om verder te gaan | 请启用JavaScript | 请开启JavaScript后继续
"""
#: Notices made of a demand and its purpose: every demand with every purpose is an exemplar.
DEMANDS = "Please enable JavaScript | You need to enable JavaScript | JavaScript must be switched on | Scripts are blocked in your browser; turn them on | Please turn on JavaScript | JavaScript must be enabled"
PURPOSES = "to read this text | to run this app | to continue | and reload the page | to view this page | in order to view this page | to use this site"
#: Families of messages, not taken from any table: every subject with every state is an exemplar.
FAMILIES = (
    ("error_page", "This site | This website | Our website | The website | The server | This service | The service | The application",
     "is currently unavailable | is temporarily unavailable | is currently down for maintenance | is undergoing scheduled maintenance | is temporarily overloaded, please try again in a few minutes | is temporarily unable to handle your request | encountered an internal error and could not complete your request | is offline for scheduled maintenance, please check back soon"),
    ("error_page", "Your session | Your login session | Your login",
     "has timed out, please sign in again | has expired, please log in again | timed out due to inactivity | is no longer valid, please sign in again"),
    ("error_page", "You have | Your account has | Your IP address has",
     "exceeded the request limit | exceeded your quota | reached the maximum number of requests | exceeded the rate limit, please try again later | reached your download limit | sent too many requests, please slow down"),
    ("error_page", "Der Server | Diese Seite | Unsere Website", "ist vorübergehend nicht erreichbar | ist derzeit wegen Wartungsarbeiten nicht verfügbar"),
    ("error_page", "Le serveur | Ce site | Notre site", "est temporairement indisponible | est actuellement en maintenance"),
    ("error_page", "El servidor | Este sitio | Nuestro sitio", "no está disponible temporalmente | está temporalmente fuera de servicio por mantenimiento"),
    ("error_page", "Сервер | Этот сайт | Наш сайт", "временно недоступен из-за технических работ | перегружен, повторите попытку позже"),
    ("script_notice", "This site uses cookies | We use cookies | This website uses cookies | We and our partners use cookies",
     "to improve your experience | to give you the best experience on our website | to analyse our traffic | to personalise content and ads | by continuing to browse you agree to our use of cookies"),
    ("script_notice", "Accept all cookies | Manage cookie preferences | Reject all cookies | Cookie settings", "Privacy policy | Manage your consent choices"),
)
#: Messages of servers, sites and editors in general, by label and language, not taken from any table: what is held against a window is what those of them say that share its rare words.
GENERAL = {
    "error_page": """
The page could not be loaded | This page does not exist | The requested file was not found | The address may be wrong or the link is broken | The link you clicked is outdated | Check the address and try again | Use the search or go to the homepage | We were unable to locate the resource
An error occurred while processing your request | There was a problem with the server | The server did not respond | The server returned an invalid response | The upstream connection timed out | Unable to connect to the database | Technical problems, please check back soon | We have been notified and are working on a fix
You are not authorized to view this page | You need permission to access this content | Sign in or register to view this content | Your account has been locked | Login required | Wrong password | Your request was blocked for security reasons | Too many requests from your address | Try again in a few minutes
The site is offline for planned maintenance | The system is temporarily down, sorry for the inconvenience | The requested resource has been removed or is unavailable | The connection was lost or reset | The certificate has expired | The request was malformed and could not be understood
Die Seite existiert nicht | Die Seite konnte nicht geladen werden | Die Adresse ist falsch oder der Link ist veraltet | Es ist ein Fehler aufgetreten | Der Server antwortet nicht | Die Verbindung zur Datenbank ist fehlgeschlagen | Sie haben keine Berechtigung für diese Seite | Zugriff nicht erlaubt | Bitte melden Sie sich an | Wegen Wartung nicht erreichbar
La page n'existe pas | La page n'a pas pu être trouvée | Le lien est rompu ou l'adresse est erronée | Une erreur s'est produite | Le serveur ne répond pas | La connexion à la base de données a échoué | Vous n'êtes pas autorisé à accéder à cette page | Vous n'avez pas les droits nécessaires | Veuillez vous connecter | Site en maintenance
La página no existe | No se pudo encontrar la página | El enlace está roto o la dirección es incorrecta | Se ha producido un error | El servidor no responde | Error de conexión con la base de datos | No tiene autorización para acceder | No dispone de permisos para ver esta página | Inicie sesión para continuar
A página não existe | Não foi possível encontrar a página | Ocorreu um erro inesperado | O servidor não responde | Você não tem permissão para acessar esta página | Faça login para continuar | Site em manutenção
La pagina non esiste | Impossibile trovare la pagina | Si è verificato un errore imprevisto | Il server non risponde | Non hai il permesso di accedere a questa pagina | Effettua il login per continuare | Sito in manutenzione
De pagina bestaat niet | De pagina kon niet worden gevonden | Er is een fout opgetreden | De server reageert niet | U heeft geen toegang tot deze pagina | Log in om verder te gaan | De website is in onderhoud
Strona nie istnieje | Nie można znaleźć strony | Wystąpił błąd serwera | Serwer nie odpowiada | Nie masz uprawnień do tej strony | Zaloguj się, aby kontynuować | Trwa konserwacja serwisu
Страница не существует | Не удалось найти страницу | Ссылка устарела или адрес указан неверно | Произошла ошибка | Сервер не отвечает | Ошибка соединения с базой данных | У вас нет доступа к этой странице | Недостаточно прав для просмотра | Войдите, чтобы продолжить | На сайте ведутся технические работы
页面不存在 | 您访问的页面找不到了 | 链接已失效 | 服务器没有响应 | 发生错误 | 您没有访问权限 | 您无权查看此页面 | 请先登录 | 网站正在维护
""",
    "script_notice": """
JavaScript is turned off in your browser | Turn on JavaScript in your browser settings | Enable scripting to use this application | This website requires JavaScript to work properly | This app needs scripts in order to run | Cookies are disabled, allow cookies to use this site | Please wait while we check that you are human | Verify that you are not a robot | Complete the captcha to proceed | Your browser is outdated, upgrade or update it to view this content | Disable your ad blocker and reload
JavaScript ist in Ihrem Browser ausgeschaltet | Schalten Sie JavaScript ein | Diese Anwendung benötigt JavaScript | Bitte erlauben Sie Cookies | Ihr Browser wird nicht unterstützt
JavaScript est désactivé dans votre navigateur | Vous devez autoriser JavaScript | Cette application nécessite JavaScript | Veuillez accepter les cookies | Votre navigateur n'est pas pris en charge
JavaScript está desactivado en su navegador | Debe habilitar JavaScript | Active JavaScript en la configuración del navegador | Esta aplicación requiere JavaScript | Acepte las cookies
O JavaScript está desativado no seu navegador | Habilite o JavaScript | JavaScript è disattivato nel browser | Attiva JavaScript nelle impostazioni | JavaScript is uitgeschakeld in uw browser | Zet JavaScript aan | JavaScript jest wyłączony w przeglądarce | Włącz obsługę JavaScript
JavaScript отключён в вашем браузере | Включите JavaScript в браузере | Необходима поддержка JavaScript | Разрешите использование cookies | Ваш браузер устарел
您的浏览器已禁用JavaScript | 请在浏览器设置中启用脚本 | 需要JavaScript才能运行 | 请更新您的浏览器
""",
    "filler": """
This is placeholder text | Replace this text with your own words | Your content goes here | Insert your text here | Add your description here | Write something about yourself | Enter a title or headline | Type your message here | Headline goes here | Subtitle here | Content will be added soon | More information to follow shortly | This section is under construction | Image caption goes here | Example text to be replaced | Edit this paragraph
Hier folgt in Kürze Text | Platzhalter, bitte ersetzen | Beispieltext | Der Text fehlt noch | Fügen Sie hier Ihren Text ein | Inhalt folgt
Texte à remplacer | Votre texte ici | Exemple de texte | Contenu à venir | Insérez votre texte | Titre ici
Texto de ejemplo | Escriba su texto aquí | Contenido próximamente | Reemplace este texto | Título aquí | Inserte aquí su texto
Texto de exemplo | Escreva o seu texto aqui | Conteúdo em breve | Testo di esempio | Inserisci qui il tuo testo | Contenuto in arrivo | Voorbeeldtekst | Voer hier uw tekst in | Inhoud volgt binnenkort | Przykładowy tekst | Wpisz tutaj swój tekst | Treść wkrótce
Текст будет добавлен позже | Скоро здесь появится содержание | Пример текста | Введите ваш текст | Вставьте сюда описание | Раздел в разработке
示例文本 | 在此输入您的文字 | 内容即将上线 | 此处为占位文字
""",
}
TRACES = """
Traceback (most recent call last): | File "/srv/app/page.py", line N, in render | KeyError: 'uid' | Warning: Undefined index: uid in /srv/www/read.php on line N | Fatal error: Uncaught Exception in /var/www/index.php on line N | NullPointerException at com.example.Main
"""
FILLER = """
Blindtext | Dummy text | Testo segnaposto | Texte de remplissage | Tekst zastępczy | Текст-заглушка | Texto de relleno | Placeholder paragraph | This is sample text | Sample text | Your text goes here | Text goes here
Aquí va el texto | Hier steht später der Text | Hier kommt der Text hin | Здесь будет текст статьи | Ici le texte | Insert introduction | Insert text here | Description to be written | Content coming soon | Coming soon | To be filled in by the editor
A short summary of about fifty words should stand in this box | Dummy copy for layout only | Replace it with your own content before publishing | Click here to edit this block | Remove after review | Do not publish | Bitte ersetzen | Замените его перед публикацией | Please replace
"""
LOREM = """
lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat
duis aute irure in reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum
"""
#: Words that are filler if nothing else stands beside them; repeated or together they are keyboard noise.
NOISE = "test text текст asdf qwerty blah bla xxx foo bar lorem ipsum тест проба xyz abc asdfgh"

#: Shapes of unfilled placeholders, fixed values.
SLOT = re.compile(
    r"""\{\{\s*[\w.]+(?:\s*\|[^{}\n]*)?\s*\}\}|\{%[^{}\n]*%\}|<%=?[^<>\n]*%>|<\?(?:php|=)[^<>\n]*\?>|[$\#]\{\s*[\w.]+\s*\}|%\(\w+\)[sd]|%%\w+%%|@@\w+@@|(?<![\w])__[A-Z]\w*?__(?!\w)"""
    r"""|\$[A-Z][A-Z0-9_]+\$|(?<![\w"'{])\{(?:[A-Za-z][\w]*(?:\.\w+)*|\d)\}(?![\w.]*\.\w|[\w}])|\[(?:INSERT|YOUR|ENTER|ADD|TITLE|NAME)\b[^\]\n]{0,40}\]|\[[Yy]our [^\]\n]{1,40}\]|\[[^\]\n]{1,40} (?:goes here|einfügen|here|eintragen)\]"""
    r"""|\[(?:вставьте|insert|insérer|insertar|inserire|вставить)\b[^\]\n]{0,40}\]|<[^<>\n]{1,40} missing>|&lt;[\w ]{1,30}&gt;|(?<![\w-])[XxYD]{4}-[XxM]{2}-[XxD]{2}(?![\w-])|\bTBD\b|\bTBA\b|\bTODO: ?(?:add|insert|write|fill)\b[^\n.,;]*|\bFIXME\b|\bTODO:"""
    r"""|\[object Object\]|\bNaN/NaN(?:/NaN)?|\bInvalid Date\b|\bundefined\b"""
)
#: A text has a slot only if it has one of these characters or words: a cheap test before the pattern.
TRIGGER = re.compile(r"[{$%@<\[]|__[A-Z]|&lt;|[XxM]{2}-[XxD]{2}|TB[DA]|TODO|FIXME|NaN/|Invalid Date|undefined")
#: Words by which a sentence speaks about a sign instead of leaving it unfilled, fixed values.
MENTION = re.compile(
    r"\b(?:why|sign|signs|written as|notation|symbol|called|named|variable|placeholders?|marks a|marks the|stands for|is replaced|are replaced|left in|shows? before|means|spelled|catalogue uses|everything undefined|remains? undefined|was undefined|is undefined|are undefined|were undefined|leaves? undefined|left undefined"
    r"|почему|знак|надпись|обозначает|означает|warum|zeichen|bedeutet|(?<!c'est )pourquoi|signe|signifie|por qué|signo|significa|segno|dlaczego|znak|oznacza|waarom|teken|betekent|porque o sinal|sinal)\b|为什么|符号|表示",
    re.IGNORECASE,
)
QUOTED = re.compile(r"`[^`]*`|“[^”]*”|«[^»]*»|„[^“”]*[“”]|\"[^\"]*\"|「[^」]*」")
QUOTES = {"`": "`", "“": "”", "«": "»", "„": "“", '"': '"', "「": "」"}
#: Where undefined is a word of the text and no missing value: after a pronoun, a copula or a verb of leaving, or before what can be so; fixed values.
UNDEFINED_WORD = re.compile(
    r"\b(?:everything|something|anything|nothing|all|that|is|are|was|were|be|been|being|remains?|remained|left|leaves?|leaving|stays?|stayed|still|yet|often|largely|somewhat|vaguely|deliberately|and|or|as|of)\s+undefined\b"
    r"|\bundefined\s+(?:terms?|concepts?|words?|notions?|quantit\w+|behaviou?rs?|values?|variables?|areas?|meanings?|status|numbers?|periods?|time|role|sense|symbols?|by|until|because)\b",
    re.IGNORECASE,
)
FRAME = re.compile(r"\b(?:By|Dear|Chapter|Translated by|published|Previous:|Next:|Источник:|in the year|of)\s+undefined\s*(?:[,.|—\n]|on\b|$)")

WORD = re.compile(r"[㐀-鿿]+|[^\W\d_㐀-鿿]+")  # Chinese and other letters are words of their own, with or without a blank between
WINDOW = re.compile(r"[^\n]*?(?:[.!?…。！？]+[\"'”’»)\]]*(?=\s|$)|[。！？]|(?=\n)|$)", re.MULTILINE)
CONTAINED, COVERED = 0.75, 0.7
#: Share of a window's weight that exemplars of one label must cover together where none of them is contained, the weight from which a word (of four letters) is rare, and the rare words they need at least, a fifth of the window's words in longer ones.
TOGETHER, RARE, RARE_WORDS = 0.5, 4.0, 2
#: Words of any text, which tell nothing however seldom they are in a corpus; fixed values.
PLAIN_WORDS = frozenset("they them their there these those this that with from your have been were will would could should what when where which while some more than then into only also very much such each other about after again before here just like made make most must over same said take well were".split())
#: The word of the index that stands for every unfilled placeholder.
SLOT_WORD = "\x00slot"


def placed(text: str) -> Iterator[tuple[int, int, str]]:
    """Start, end and lower-case form of each word; Chinese ones by pairs of characters."""
    for m in WORD.finditer(text):
        a, z, w = *m.span(), m.group()
        if "㐀" <= w[0] <= "鿿" and z - a > 1:
            yield from ((a + i, a + i + 2, w[i : i + 2]) for i in range(z - a - 1))
        else:
            yield a, z, w.lower()


def words_of(text: str) -> list[str]:
    """Lower-case words; Chinese ones by pairs of characters."""
    out = []
    for w in WORD.findall(text.lower()):
        if "㐀" <= w[0] <= "鿿":
            out += [w[i : i + 2] for i in range(len(w) - 1)] or [w]
        else:
            out.append(w)
    return out


def exemplars() -> list[tuple[str, list[str], bool]]:
    """Label and words of each exemplar, and whether a number belongs to it."""
    out = []
    for label, block in (("error_page", ERROR_PAGES), ("script_notice", SCRIPT_NOTICES), ("trace", TRACES), ("filler", FILLER)):
        parts = re.split(r"[|\n]", block + "\n" + GENERAL.get(label, ""))
        if label == "script_notice":
            parts += [f"{d} {p}" for d in DEMANDS.split("|") for p in PURPOSES.split("|")]
        parts += [f"{a} {b}" for of, subjects, states in FAMILIES if of == label for a in subjects.split("|") for b in states.split("|")]
        for e in parts:
            if words := [w for w in words_of(e) if w != "n"]:
                out.append((label, words, bool(re.search(r"\bN\b", e))))
    out.append(("placeholder", [SLOT_WORD], False))
    out += [("noise", [w], False) for w in NOISE.split()]
    return list({(label, tuple(words)): (label, words, number) for label, words, number in out}.values())


LOREM_WORDS = frozenset(LOREM.split())
NOISE_WORDS = frozenset(NOISE.split())


def vocabulary() -> frozenset[str]:
    return frozenset(w for _, ws, _ in exemplars() for w in ws) | LOREM_WORDS | NOISE_WORDS | {SLOT_WORD}


class Index:
    """Inverted index over the exemplars, weighted by document frequencies of ``n`` documents."""

    def __init__(self, df: dict[str, int], n: int) -> None:
        self.idf = {w: math.log((n + 1) / (df.get(w, 0) + 1)) + 0.1 for w in vocabulary()}
        self.other = sum(self.idf.values()) / len(self.idf)  # a word that no exemplar has
        self.order = exemplars()
        self.items = [(label, Counter(ws)) for label, ws, _ in self.order]
        self.total = [sum(self.idf[w] * k for w, k in c.items()) for _, c in self.items]
        self.heads: dict[str, list[int]] = {}
        for i, (_, c) in enumerate(self.items):
            left = self.total[i]
            for w in sorted(c, key=lambda w: (-self.idf[w], w)):
                # A window without any of the words so far holds no more than what is left.
                if left < CONTAINED * self.total[i]:
                    break
                self.heads.setdefault(w, []).append(i)
                left -= self.idf[w] * c[w]
        #: Exemplars by their rare words, for windows that no single one is contained in.
        self.rare: dict[str, list[int]] = {}
        for i, (label, c) in enumerate(self.items):
            for w in c if label not in ("noise", "placeholder") else ():
                if self.idf[w] >= RARE and (len(w) >= 4 or "㐀" <= w[0] <= "鿿") and w not in PLAIN_WORDS:
                    self.rare.setdefault(w, []).append(i)
        self.rare_words = frozenset(self.rare)
        #: A window without any of these words can't be residue and isn't taken apart.
        self.leads = frozenset(self.heads) | self.rare_words | {w for w in LOREM_WORDS if len(w) >= 5} | NOISE_WORDS

    def retrieve(self, window: Counter, number: bool) -> list[int]:
        """Exemplars of whose weight the window holds enough; ``number``: whether it has digits."""
        seen = {i for w in window if w in self.heads for i in self.heads[w]}
        hold = lambda i: sum(self.idf[w] * min(k, window[w]) for w, k in self.items[i][1].items() if w in window)
        return [i for i in seen if (number or not self.order[i][2]) and hold(i) >= CONTAINED * self.total[i]]

    def within(self, text: str, lo: int, hi: int) -> list[tuple[int, int, str, float]]:
        """Residue in the midst of a sentence: an exemplar word for word, or a run of filler words, that nothing quotes or speaks about."""
        found = [(a + lo, z + lo, w) for a, z, w in placed(text[lo:hi])]
        out = []
        words = [w for _, _, w in found]
        here = Counter(words)
        for i in self.retrieve(here, any(ch.isdigit() for ch in text[lo:hi])):
            label, own, number = self.order[i]
            if len(own) < 2 or sum(self.idf[w] for w in own) < 1.5 * self.other:
                continue
            for k in range(len(words) - len(own) + 1):
                a, z = found[k][0], found[min(k + len(own), len(found)) - 1][1]
                beside = re.search(r"\d\W{0,3}$", text[lo:a]) or re.match(r"\W{0,3}\d", text[z:hi])
                if words[k : k + len(own)] == own and (beside or not number):
                    out.append((found[k][0], found[k + len(own) - 1][1], label, 1.0))
        k = 0
        while k < len(words):
            n = k
            while n < len(words) and words[n] in LOREM_WORDS:
                n += 1
            if n - k >= 4 and any(len(w) >= 5 for w in words[k:n]):
                out.append((found[k][0], found[n - 1][1], "filler", 1.0))
            k = max(n, k + 1)
        return [r for r in out if not spoken_about(text, r[0], r[1], lo, hi)]

    def score(self, window: str) -> tuple[float, str | None]:
        """Share of the window's weight that retrieved exemplars cover, and the label of the heaviest."""
        words = words_of(window)
        if not words:
            return 0.0, None
        c = Counter(words)
        whole = sum(self.idf.get(w, self.other) * k for w, k in c.items())
        lorem = sum(self.idf[w] * k for w, k in c.items() if w in LOREM_WORDS)
        latin = [w for w in words if w in LOREM_WORDS]
        if len(latin) >= 4 and lorem >= COVERED * whole and any(len(w) >= 5 for w in latin):
            return lorem / whole, "filler"
        got = [i for i in self.retrieve(c, any(ch.isdigit() for ch in window)) if self.items[i][0] != "noise"]
        if got:
            cover = {w for i in got for w in self.items[i][1]}  # several notices may stand in one window
            part = sum(self.idf[w] * k for w, k in c.items() if w in cover) / whole  # however often it is repeated
            if part >= COVERED:
                return part, self.items[max(got, key=lambda i: self.total[i])][0]
        return self.together(window, c)

    def together(self, window: str, c: Counter) -> tuple[float, str | None]:
        """The same where no exemplar is contained: by all exemplars of one label that share a rare word with the window. What is quoted doesn't count, and a window that speaks about signs is none."""
        best: tuple[float, str | None] = (0.0, None)
        least = max(RARE_WORDS, sum(c.values()) / 5)
        if len(self.rare_words.intersection(c)) < least or MENTION.search(window):
            return best
        window = QUOTED.sub(" ", window)
        if any(q in window for q in "“”«»„「」"):  # a quotation that goes on before or after it
            return best
        c = Counter(words_of(window))
        rare = self.rare_words.intersection(c)
        whole = sum(self.idf.get(w, self.other) * k for w, k in c.items())
        seen: dict[str, set[str]] = {}
        for i in {i for w in rare for i in self.rare[w]}:
            seen.setdefault(self.items[i][0], set()).update(self.items[i][1])
        for label, cover in sorted(seen.items()):
            if len(rare & cover) >= least:
                part = sum(self.idf[w] * k for w, k in c.items() if w in cover) / whole
                if part >= TOGETHER and part > best[0]:
                    best = part, label
        return best

    def is_noise(self, words: list[str]) -> bool:
        """Whether exemplars of keyboard noise cover all of the words."""
        if not words or not NOISE_WORDS.issuperset(words):
            return False
        covered = {w for i in self.retrieve(Counter(words), False) for w in self.items[i][1] if self.items[i][0] == "noise"}
        return covered.issuperset(words)

    def placeholders(self, text: str) -> list[tuple[int, int, str, float]]:
        """Unfilled placeholders, as windows of their own: each is a word of the index, retrieved by it and covered by its exemplar, unless it is quoted or spoken about."""
        window = Counter([SLOT_WORD])
        out = []
        for a, z in slots(text):
            for i in self.retrieve(window, False):
                out.append((a, z, self.items[i][0], self.idf[SLOT_WORD] / self.total[i]))
        return out


def sentence_around(text: str, a: int, z: int) -> tuple[int, int]:
    """Start and end of the sentence or line around an offset range."""
    lo = max(text.rfind("\n", 0, a), *(text.rfind(e, 0, a) for e in (". ", "! ", "? ", "… ", "。", "！", "？")))
    ends = [p for e in ("\n", ". ", "! ", "? ", "。", "！", "？") if (p := text.find(e, z)) >= 0]
    return lo + 1, min(ends, default=len(text))


def spoken_about(text: str, a: int, z: int, lo: int, hi: int) -> bool:
    """Whether the sentence from lo to hi quotes what stands from a to z, or speaks about it."""
    before, after = text[lo:a], text[z:hi]
    if any((q != e and before.count(q) > before.count(e) and e in after) or (q == e and before.count(q) % 2 and q in after) for q, e in QUOTES.items()):
        return True
    return bool(MENTION.search(before) or MENTION.search(after))


def slots(text: str) -> list[tuple[int, int]]:
    """Offsets of unfilled placeholders that nothing quotes or speaks about."""
    if not TRIGGER.search(text):
        return []
    out = []
    for m in SLOT.finditer(text):
        a, z = m.span()
        lo, hi = sentence_around(text, a, z)
        around = text[lo:hi]
        if spoken_about(text, a, z, lo, hi):
            continue
        if m.group() == "undefined" and UNDEFINED_WORD.search(text[max(lo, a - 24) : z + 24]) and not FRAME.search(around):
            continue
        out.append((a, z))
    return out


def windows(text: str) -> Iterator[tuple[int, int]]:
    """Offsets of the sentences and lines of a text."""
    for m in WINDOW.finditer(text):
        if m.group().strip():
            yield m.span()


def residue_of(text: str, index: Index, words: list[str] | None = None) -> list[tuple[int, int, str, float]]:
    """Stretches of residue in a text: start, end, label, share covered."""
    out = index.placeholders(text)
    if not index.leads.isdisjoint(words if words is not None else words_of(text)):
        run: list[tuple[int, int]] = []  # windows of keyboard noise on end, and their words
        for a, z in [*windows(text), (len(text), len(text))]:
            part = words_of(text[a:z])
            if index.is_noise(part):
                run.append((a, z))
                continue
            if run and (sum(len(words_of(text[x:y])) for x, y in run) >= 3 or not words_of(text[: run[0][0]] + " " + text[run[-1][1] :])):
                out.append((run[0][0], run[-1][1], "filler", 1.0))
            run = run if not part and a < len(text) else []
            if not index.leads.isdisjoint(part):
                share, label = index.score(text[a:z])
                if label is not None:
                    out.append((a, z, label, share))
                else:
                    out += index.within(text, a, z)
    return out


def document_frequencies(df: DataFrame, text: str = "text") -> tuple[dict[str, int], int]:
    """In how many of all documents each word of the exemplars stands, and how many documents there are.

    One count per word and batch leaves a task; the words are those of the
    exemplars, so the result is bounded by their list.
    """
    vocab = vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()
        n = 0
        for b in batches:
            n += len(b)
            for t in b.column(0).to_pylist():
                if t:
                    c.update(vocab.intersection(words_of(t)))
                    c.update([SLOT_WORD] if slots(t) else ())
        yield pa.RecordBatch.from_arrays([pa.array([*c.keys(), ""]), pa.array([*c.values(), n], pa.int64())], names=["w", "n"])

    rows = df.select(text).mapInArrow(run, "w STRING, n LONG").groupBy("w").agg(F.sum("n").alias("n")).collect()
    got = {r["w"]: r["n"] for r in rows}
    return got, got.pop("", 0)


def residue(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The stretches of residue in each row of ``df``: key, start, end, label, share.

    Null, empty and blank texts have none. Rows with the same text have the same
    stretches each under its own key. Texts are taken whole.
    """
    counts, n = document_frequencies(df, text)
    sent = df.sparkSession.sparkContext.broadcast((counts, n))
    made: dict[str, Index] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made["index"] = Index(*sent.value)
        for b in batches:
            keys, rows = b.column(0), []
            for k, t in enumerate(b.column(1).to_pylist()):
                if t:
                    rows += [(k, *r) for r in residue_of(t, made["index"])]
            if rows:
                at, a, z, label, share = zip(*rows)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(at)), pa.array(a, pa.int32()), pa.array(z, pa.int32()), pa.array(label), pa.array(share, pa.float64())], names=[key, "start", "end", "label", "share"])

    schema = T.StructType([df.schema[key], *T._parse_datatype_string("start INT, end INT, label STRING, share DOUBLE").fields])
    return df.select(key, text).mapInArrow(run, schema)


def without_residue(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` without the rows that hold residue (a row with a null key stays)."""
    return df.join(residue(df, key, text).select(key).distinct(), key, "left_anti").select(*df.columns)
