"""Preparing texts, the delimiters of placeholders, and phrase rules that give weak labels for training.

Only ``prepared``, ``holes`` and ``split`` take part in judging a text; the phrases
label the training sample and nothing else.  They are fixed values: general wording
of filler, HTTP errors and script notices in the languages of the corpus.
"""

from __future__ import annotations

import html
import re
import unicodedata
from functools import lru_cache

_BROKEN = re.compile("[Â-ô][\u0080-¿]")
_INVISIBLE = re.compile("[\u200b\u200c\u2060\ufeff\u00ad]")


def clean(text: str) -> str:
    """Undo what does not change the wording: wrong decoding, entities, invisible characters, odd spaces."""
    if text.isascii() and "&" not in text:
        return text
    if _BROKEN.search(text):
        for codec in ("latin-1", "cp1252"):
            try:
                text = text.encode(codec).decode("utf-8")
                break
            except UnicodeError:
                continue
        else:
            text = re.sub("[\u0080-ÿ]{2,}", lambda m: _repaired(m.group()), text)
    text = html.unescape(text) if "&" in text else text
    text = unicodedata.normalize("NFC", _INVISIBLE.sub("", text))
    return re.sub("[  -   　]", " ", text)


def _repaired(part: str) -> str:
    try:
        return part.encode("latin-1").decode("utf-8")
    except UnicodeError:
        return part


#: Quoted spans: what is quoted is mentioned, not meant.
QUOTED = re.compile('"[^"\n]+"|“[^“”]+”|„[^„“”"]+[“”"]|«[^«»]+»|「[^「」]+」|『[^『』]+』')
_TITLE = re.compile(r"<(?:title|h1)\b[^<>]*>", re.I)
_TAG = re.compile(r"</?(?:p|div|br|html|head|title|body|h[1-6]|noscript|span|b|i|em|strong|ul|li|s|center|hr|script|style)\b[^<>]*/?>", re.I)
#: Special tokens of tokenizers are ordinary text.
_SPECIAL = re.compile(r"<\|\w+\|>|</?s>|<(?:unk|pad|mask|bos|eos|cls|sep)>|\[(?:UNK|PAD|MASK|CLS|SEP|BOS|EOS|INST)\]|\[/INST\]|<<SYS>>|<</SYS>>|<start_of_turn>|<end_of_turn>|<0x[0-9A-F]{2}>")

_NAME = r"(?!ref\b|update\b|edit\b|sic\b)[^\W\d][\w.!'-]*(?: {1,3}[\w.!'-]+){0,2}"
#: Delimiters of template languages around a field name, of any length.
PLACEHOLDER = re.compile(
    r"\{\{\{?[^{}\n]+\}\}\}?"
    r"|\{%-?[^%\n]+-?%\}|<%[=-]?[^%\n]+%>|\$\{[^{}\n]+\}|#\{[^{}\n]+\}"
    r"|@@[^@\n]+@@|##[^#\n]+##|\[\[[^\[\]\n]+\]\]|<<[^<>\n]+>>|\*\|[^|\n]+\|\*"
    rf"|\{{(?:{_NAME}|\d)\}}|\[{_NAME}\]|<(?!/){_NAME}>|\|{_NAME}\||(?<![\w$])\${_NAME}\$(?!\w)|(?<![\w%])%{_NAME}%(?!\w)"
    r"|(?<![\w:]):[a-z][a-z_.]{2,}:(?![\w:])"
    r"|(?<!\w)__[^\W_](?:[\w. ]*?[^\W_])?__(?!\w)|(?<![\w%])%(?:\d\$|\([\w. ]+\))?[sd](?![A-Za-z0-9%])|\{{1,3}\s*\}{1,3}|(?<!_)_{4,}(?!_)",
)
FAILED = re.compile(r"(?<![A-Za-z0-9_])(?:undefined|UNDEFINED|Undefined|null|NULL|NaN|NAN)(?![A-Za-z0-9_])|\[object Object\]|<no value>|#(?:REF|N/A|VALUE|NAME\?)!?")
HOLE = "\ue000"  # stands for a placeholder
TITLE = "\ue001"  # stands before the text of a title or first heading
SIGNED = "\ue002"  # stands before the one line that follows a line of dashes
#: A failed value followed by a common noun is an adjective ("the undefined shape of").
ADJECTIVE = re.compile(rf"{HOLE}\s+(?:shape|form|size|value|result|hypothesis|and void|area|feeling|purpose|state|behaviou?r|edges?|colou?r of)\b", re.I)
#: Sentences that speak of brackets, labels or templates mention a placeholder.
MENTION = re.compile(
    r"\bbrackets\b|\bprint(?:ed|s)?\b|\btemplate\b|\bimpres[oa]\b|\bmuster\w*etikett|\bmention\b|\bvorgedruckt\b|\bstampat[oa]\b|\bsegnaposto\b|напечатан|印字|印刷"
    r"|\b(?:as|comme|como|come|als) (?:an? )?(?:example|exemple|ejemplo|esempio|beispiel)\b",
    re.I,
)

_STATUS = r"(?:4\d\d|5\d\d)"
#: Status lines, titles and advice of error pages, and lines of stack traces.
ERROR = re.compile(
    rf"\b(?:http|error|fehler|erreur|errore|ошибка|エラー|code|status)\W{{0,3}}{_STATUS}\b|^\W*{_STATUS}\W*$|^\W*{_STATUS}\b(?!\s*(?:g|kg|euros?|days?|stars?)\b)"
    r"|page not found|\bnot found\b|internal server error|bad gateway|service (?:temporarily )?unavailable|gateway time-?out|access denied|\bforbidden\b|session expired|too many requests"
    r"|something went wrong|\boops\b|could not complete your request|page you asked for|content is no longer available|permission to (?:see|view|access)|server did not answer"
    r"|return to the home ?page|try again (?:later|in a few)|log in again|team has been told"
    r"|seite nicht gefunden|zugriff verweigert|interner serverfehler|dienst nicht verfügbar|sitzung abgelaufen|angeforderte seite|zurück zur startseite|später erneut|melden sie sich erneut"
    r"|page introuvable|accès refusé|erreur interne|service indisponible|session expirée|page demandée|retour à l.accueil|réessayer plus tard"
    r"|página no encontrada|acceso denegado|error interno|servicio no disponible|sesión ha caducado|página solicitada|volver al inicio|intentarlo más tarde"
    r"|pagina non trovata|accesso negato|errore del server|servizio non disponibile|sessione scaduta|pagina richiesta|torna alla home|riprova più tardi"
    r"|страница не найдена|доступ запрещ[её]н|ошибка сервера|сервис недоступен|сессия истекла|запрошенная страница|вернуться на главную|повторите попытку"
    r"|ページが見つかりません|アクセスが拒否|サーバーエラー|サービスを利用でき|セッション.{0,6}切れ|もう一度お試し|トップページ"
    r"|\w+(?:exception|error)\b\s*:|^\s*at [\w.$]+\(|traceback \(most recent|^\s*file .+, line \d+",
    re.I | re.M,
)
#: Words that stand for failed values, and how placeholders begin: a text without either needs no closer look.
_FAILED_WORDS = ("undefined", "UNDEFINED", "Undefined", "null", "NULL", "NaN", "NAN", "[object", "<no", "#REF", "#N/A", "#VALUE", "#NAME")
MARKED = re.compile(r"[{\[<]|@@|##|#\{|\*\||\|[^\W\d]|\$(?:\{|[^\W\d])|%(?:[^\W\d]|\d\$|\()|:(?=[a-z])(?<![\w:]:)|__")
STATUS_NUMBER = re.compile(rf"(?<![\d,.-]){_STATUS}(?![\d,.-])")
WORD = re.compile(r"[^\W_]+")
_OBJECT = re.compile(r'\{\s*"[^"{}]+"\s*:[^{}]*\}')
_TAIL = re.compile(r"[\s(]+\d{2,}\)?\s*$")
_TRACE = re.compile(r"\b\w+(?:Exception|Error)\b\s*:|\bat [\w.$]+\(|Traceback \(most recent|, line \d+", re.I)

_SCRIPT = r"(?:java\s?script|\bjs\b|(?:client-side )?script(?:s|ing)\b|skripte?|скрипт\w*|スクリプト|cookies)"
#: Orders and statements of notices that scripts are required.
NOTICE = re.compile(
    rf"(?:requires?|(?:please|must|need to) (?:enable|turn on|allow|switch on)|\benable\b|switch on|turn on|reviews? (?:below )?needs?|not support(?: or has disabled)?|has disabled|disabled)\b.{{0,40}}{_SCRIPT}"
    rf"|{_SCRIPT}.{{0,30}}(?:is|are) (?:required|disabled|turned off|switched off)"
    rf"|(?:benötigt|aktivieren sie|fehlt|brauchen sie|erlauben sie|schalten sie).{{0,30}}{_SCRIPT}"
    rf"|(?:nécessite|veuillez (?:activer|autoriser)|autorisez|activez).{{0,30}}{_SCRIPT}"
    rf"|(?:necesita|debe (?:permitir|activar)|active|habilite|permita|active).{{0,30}}{_SCRIPT}"
    rf"|(?:richiede|attiv(?:a|are|i)|abilit(?:a|are|i)|consent(?:a|i|ire)|necessita|serv(?:e|ono)|ha bisogno di).{{0,30}}{_SCRIPT}"
    rf"|(?:включите|нуж(?:ен|ны)|требу\w+|разрешите).{{0,30}}{_SCRIPT}|{_SCRIPT}.{{0,30}}(?:отключ|не поддерж)"
    rf"|{_SCRIPT}.{{0,20}}(?:有効|必要|オン|許可)",
    re.I,
)
_PERSONAL = re.compile(
    r"\b(?:i|me|my|their shop|asked me|j'ai|il a fallu|tuve que|ho dovuto|mi ha|musste|ich|wollte|asked|пришлось|мне)\b.{0,40}" + _SCRIPT, re.I
)
#: Wording of texts that were never written.
SAMPLE = re.compile(
    r"text goes here|insert text|your (?:review|text|comment) here|to be (?:written|done|added)|\bplaceholder\b|test review|sample (?:review|text|comment)|dummy (?:content|text|review)|example (?:comment|review|text)|lorem ipsum"
    r"|blindtext|platzhalter|mustertext|beispieltext|text folgt|nur ein test|testbewertung|ihre bewertung hier"
    r"|votre avis ici|texte d.exemple|texte à venir|faux texte|avis de test|texte de (?:test|remplissage)|à rédiger"
    r"|texto de (?:ejemplo|relleno|prueba)|escriba aquí|reseña de prueba|su opinión aquí|pendiente de redactar"
    r"|testo (?:di (?:prova|esempio)|segnaposto|fittizio)|recensione di prova|scrivi qui|solo una prova|da scrivere|la tua recensione qui"
    r"|пример текста|здесь будет ваш отзыв|тестовый отзыв|образец|заполнитель|рыба-текст|текст-рыба"
    r"|サンプルテキスト|ダミー|ここに.{0,12}(?:入力|書)|テスト(?:投稿|レビュー)|文章が入ります",
    re.I,
)
#: Words of the customary Latin filler that no living language uses (fixed values).
LATIN = frozenset("lorem ipsum dolor amet consectetur adipiscing eiusmod tempor incididunt aliqua veniam nostrud ullamco laboris commodo consequat".split())
#: Rows of keys and the alphabets: words along them are typed to fill a box (fixed values).
ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "yxcvbnm", "abcdefghijklmnopqrstuvwxyz", "1234567890")
_STEPS = frozenset(a + b for row in ROWS for x in (row, row[::-1]) for a, b in zip(x, x[1:]))
_SLASH = re.compile(r" / (?=\D)")
_SPACES = re.compile(r"[ \t\r\f\v]+")
_NUMBERED = re.compile(r"\w*\d[\w.,:/-]*")
_DIGITS = re.compile(r"(?<=\D)\d+$")


def prepared(text: str) -> str:
    """Cleaned text: what is quoted emptied, tags as line breaks, titles marked, placeholders as one character each.

    The strings of JSON objects are no quotes.
    """
    text = clean(text)
    if "<" in text or "[" in text:
        text = _TAG.sub("\n", _TITLE.sub(f"\n{TITLE}", _SPECIAL.sub(" ", text)))
    bare = text.strip()
    if bare[:1] in "[{" and bare[-1:] in "]}" and '"' in bare and ":" in bare:
        text = text.replace('"', "")
    else:
        text = _OBJECT.sub(lambda m: m.group().replace('"', ""), text) if "{" in text else text
        text = QUOTED.sub(' "" ', text) if any(map(text.__contains__, '"“„«「『')) else text
    return holes(_SPACES.sub(" ", text) if any(map(text.__contains__, ("  ", "\t", "\r", "\f", "\v"))) else text)


def holes(text: str) -> str:
    """Placeholders and failed values replaced by one character each: the exact check of their delimiters."""
    if MARKED.search(text):
        text = PLACEHOLDER.sub(HOLE, text)
    return FAILED.sub(HOLE, text) if any(map(text.__contains__, _FAILED_WORDS)) else text


def _sentences(text: str) -> list[str]:
    """Parts between line breaks, ends of sentences, and bars or slashes between blanks (blanks are single ones)."""
    for end in ".!?…":
        text = text.replace(end + " ", end + "\n")
    if not text.isascii():
        for end in "。！？":
            text = text.replace(end, end + "\n")
    text = text.replace(" | ", "\n")
    return (_SLASH.sub("\n", text) if " / " in text else text).split("\n")


def split(text: str | None) -> list[str]:
    """Sentences and lines of the whole text that say anything; lines of one or two words that follow each other are one segment.

    A single line or sentence after a line of dashes is marked as a signature.
    """
    if not text or not text.strip():
        return []
    out: list[str] = []
    lone, dashes = False, -1
    for s in _sentences(prepared(text)):
        s = s.strip()
        if s == "--":
            lone, dashes = False, len(out)
        if not s or not (s[0].isalnum() or s[-1].isalnum() or any(c.isalnum() or c == HOLE for c in s)):
            continue
        short = s.count(" ") < 2 and s[-1] not in ".!?…。！？"
        if lone and short and HOLE not in s and HOLE not in out[-1] and TITLE not in s + out[-1]:
            out[-1] += " " + s
        else:
            out.append(s)
        lone = short
    if 0 < dashes == len(out) - 1:
        out[-1] = SIGNED + out[-1]
    return out


def pieces(segment: str, size: int) -> list[str]:
    """Parts of at most ``size`` characters, cut at blanks where there are some; a placeholder is one character and never cut."""
    if len(segment) <= size:
        return [segment]
    out, lo = [], 0
    while len(segment) - lo > size:
        blank = segment.rfind(" ", lo + size // 2, lo + size)
        hi = blank + 1 if blank > 0 else lo + size
        out.append(segment[lo:hi])
        lo = hi
    return [*out, segment[lo:]]


@lru_cache(maxsize=50_000)
def typed(word: str) -> tuple[str, bool]:
    """(word without digits at its end, does it run along a row of keys or repeat one letter?)"""
    w = _DIGITS.sub("", word)
    return w, len(w) >= 3 and (all(w[k : k + 2] in _STEPS for k in range(len(w) - 1)) or len(set(w)) == 1)


def variety(words: list[str]) -> tuple[float, float]:
    """(share of different words, share of words along rows of keys)."""
    if not words:
        return 1.0, 0.0
    plain = [typed(w) for w in words]
    return len({w for w, _ in plain}) / len(plain), sum(keys for _, keys in plain) / len(plain)


def normal(segment: str) -> str:
    """Form in which segments are compared: small letters, words with digits alike."""
    return _NUMBERED.sub("#", segment.lower())


def filler(words: list[str]) -> bool:
    """Weak label of a whole text: customary Latin, keys struck at random, or a handful of words again and again."""
    latin = sum(w in LATIN for w in words)
    if latin >= 2 and latin >= 0.08 * len(words):
        return True
    different, keys = variety(words)
    return (len(words) >= 3 and keys >= 0.5) or (len(words) >= 6 and different <= 0.5 and different * len(words) < 6)


def kind_of(segment: str) -> str:
    """Weak label of one segment: error, notice, sample or text; short ones are remembered."""
    return _kind_of_short(segment) if len(segment) <= 500 else _kind_of(segment)


def _kind_of(segment: str) -> str:
    bare = _TAIL.sub("", segment.replace("_", " ")).strip(" .!?…·-–—:;,()[]*#\"'" + TITLE)
    if not any(c.isalpha() for c in bare):
        return "error" if re.fullmatch(rf"\(?{_STATUS}\)?", bare) else "text"
    low = bare.lower()
    if ("script" in low or "skript" in low or "js" in low or "скрипт" in low or "スクリプト" in low or "cookies" in low) and NOTICE.search(bare):
        return "text" if _PERSONAL.search(bare) else "notice"
    if ERROR.search(low) or _TRACE.search(segment):
        return "error"
    return "sample" if SAMPLE.search(low) else "text"


_kind_of_short = lru_cache(maxsize=30_000)(_kind_of)


def seeds() -> list[str]:
    """The literal phrases of the rules, one by one: every one of them is residue."""
    out = []
    for pattern in (ERROR, SAMPLE):
        for part in pattern.pattern.split("|"):
            phrase = re.sub(r"\\[bsSwW]|[\\^$]|\(\?:|\(\?![^)]*\)|[()?*+]|\{[^}]*\}|\[[^\]]*\]|\.", " ", part).strip()
            if len(phrase) > 4:
                out.append(phrase)
    need = ("this page requires", "please enable", "you need to turn on", "to read this, switch on", "your browser does not support")
    return out + [f"{a} {b}{c}" for a in need for b in ("javascript", "scripts", "javascript and cookies") for c in ("", " to continue", " in your browser settings")]
