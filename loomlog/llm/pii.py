"""Problem 1: personal information inside free text and working directories.

Detection runs in Arrow batches: cheap substring tests decide which of the compiled patterns a text needs.
Every detected value becomes an entity; equal entities (after folding case, width and punctuation) get one
keyed surrogate of their type and format, distinct entities never share one nor get a value that is really in
the data, and the text is rebuilt around them. A name keeps its script, the number of its words and the gender
that titles give it, a phone number its country, an address its kind of street and form, an identity number
its kind and a valid check letter. Without the key the surrogates say nothing about the values; whoever has it
can undo those of numbers, so it has to be kept like the data itself, and there is no default.

The parts of names that ``name_hints`` lists help to tell names. Up to a number they travel with the code of a
task; more are joined to the words of the texts, and each text travels with those it holds.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import discard, settle

#: Name parts that may be sent to every task; of more, each text gets its own by a join.
MOST_HINTS = 100_000
#: Characters between a bare id and other data of the person.
BESIDE = 12
#: Distinct working directories a task remembers.
FOLDER_CACHE = 50_000
FIELDS = ("item_text", "item_content", "cwd")
#: Draws of a surrogate before a number is worked into it.
ROUNDS = 6

# Each ``_MAY_`` test lets pass whatever the patterns behind it match (by tests).
# --- emails ---------------------------------------------------------------------------------------------
_LOCAL = r"[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-]"
_DOMAIN = r"(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"
_SPELLED_DOMAIN = r"[A-Za-z0-9-]+(?:{dot}[A-Za-z0-9-]+)*{dot}[A-Za-z]{{2,}}"
_DOT = r"(?: dot | ?\(dot\) ?| ?\[dot\] ?)"
EMAIL = re.compile(
    rf"(?<![A-Za-z0-9._%+@/-]){_LOCAL}[@＠]{_DOMAIN}(?![A-Za-z0-9-]|:[A-Za-z0-9/~])"
    rf"|(?<![A-Za-z0-9._%+@/-])(?:{_LOCAL}{_DOT})*{_LOCAL}(?: at | ?\(at\) ?| ?\[at\] ?){_SPELLED_DOMAIN.format(dot=_DOT)}(?![A-Za-z0-9-])"
    rf"|(?<![A-Za-z0-9._%+@/-])(?:{_LOCAL}{_DOT})*{_LOCAL} ?(?:\(at\)|\[at\]) ?{_DOMAIN}(?![A-Za-z0-9-])"
)
_MAY_EMAIL = re.compile(r"[@＠]|[ (\[]at[ )\]]")

# --- phones (full-width digits are folded first; folding keeps positions) -------------------------------
_WIDE = str.maketrans("０１２３４５６７８９＋－（）．　", "0123456789+-(). ")
PHONE = re.compile(
    r"(?<![\w.+/-])(?:"
    r"\+\d{1,3}[ .-]?\(\d{1,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}"  # +1 (212) 555-0188
    r"|\+\d{1,3}(?:[ .-]\d{1,6}){2,6}"  # +33 1 99 00 57 77, +49 30 23125 340
    r"|\+\d{10,14}"  # +447700900621
    r"|00\d{1,3}(?: \d{1,6}){2,5}"  # 001 206 555 0171
    r"|\(\d{3}\) ?\d{3}[ .-]\d{4}"  # (646) 555-0130
    r"|\d{3}([.-])\d{3}\1\d{4}"  # 312-555-0169, 415.555.0141
    r"|0\d{3}-\d{3}-\d{3}"  # 0491-570-445
    r"|0\d{4} \d{3} \d{3}"  # 07700 900 069
    r"|0\d(?:([ .-])\d{2})(?:\2\d{2}){3}"  # 01.99.00.53.29
    r"|0\d{2,4}/\d{5,9}"  # 030/23125466
    r"|01[5-7]\d \d{7,8}"  # 0151 23456789
    r"|0\d{2,4} \d{3,4} \d{4}"  # 020 7946 0827
    r")(?![\w-]|\.\d)(?: ?(?:ext\.?|x) ?\d{1,5})?"
)
_MAY_PHONE = re.compile(r"\d{3}[-. /)]|\+\d|\d{2}[ .-]\d{2}|[０-９]{3}")

# --- identity numbers -----------------------------------------------------------------------------------
_NI = r"[A-Za-z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Da-d]"
_CUED = r"(?:\bssn|\bsocial security(?: number)?|\bNI number|\bNINO|\bnational insurance(?: number)?|\bDNI|\bNIF|\bpassport(?: number)?|\bid(?:entity)?(?: ?(?:no|number|card)\b\.?)?)"
_BARE_ID = re.compile(r"\bid[ \t]*[:=#]?[ \t]*[\"']?$", re.IGNORECASE)
IDNUM = re.compile(
    r"(?<![\w.+/-])(?:"
    r"\d{3}([- ])\d{2}\1\d{4}"  # 944-21-5267
    rf"|{_NI}"  # QQ 27 90 94 B
    r"|\d{8}-?[A-Za-z]"  # 99645747-H
    r"|[A-Za-z]{2} ?\d{7}"  # ZZ1064110
    r")(?![\w-]|\.\d)"
)
CUED_IDNUM = re.compile(
    rf"(?:{_CUED}[ \t]*[:=#]?[ \t]*[\"']?|\('[^'\n]*', ')((?:\d{{9}}|\d{{3}}([- .]?)\d{{2}}\2\d{{4}}|[A-Za-z]\d{{8}}|[A-Za-z]{{1,2}}[ -]?\d{{6,7}}|\d{{8}}[- ]?[A-Za-z]))(?![\w-]|\.\d)", re.IGNORECASE
)
_MAY_IDNUM = re.compile(r"\d{2} ?\d{2} ?\d{2}|\d{3}[-.]\d{2}[-.]\d{4}")

# --- addresses ------------------------------------------------------------------------------------------
_CAP = r"[A-ZÀ-Þ][\w'’-]*"
# Words for flats, and kinds of streets by language.
_FLAT = r"(?:Apt|Apartment|Flat|Unit|Suite|Ste|Room)\.? ?#?\d{1,5}[A-Za-z]?,? "
_EN = "Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Drive|Dr|Court|Ct|Close|Crescent|Terrace|Place|Pl|Square|Sq|Boulevard|Blvd|Way|Row|Walk|Hill|Gardens|Grove|Parkway|Highway"
_FR = "rue|avenue|boulevard|quai|place|allée|impasse|chemin|cours|passage|route|square|sentier|faubourg"
_DE = r"(?:straße|strasse|str\.|gasse|weg|ring|allee|platz|ufer|damm|steig|graben|markt|hof)"
_ES = "Calle|Avenida|Avda\\.?|Paseo|Plaza|Camino|Carretera|Ronda|Travesía|Callejón|Rambla|C/"
_IT = "Via|Viale|Piazza|Piazzale|Corso|Largo|Vicolo|Strada"
_TOWN = rf"(?:, \d{{1,2}}[ºª°] ?[A-Z]?\b)?(?:, (?:\d{{4,6}} )?{_CAP}(?: \d{{4,6}}\b)?)?"
ADDRESS = re.compile(
    "(?:"
    rf"(?<![\w.+/-])(?<!the )(?:{_FLAT})?\d{{1,5}}[A-Za-z]? (?:{_CAP} ){{1,3}}(?:{_EN})\b(?! map\b)"
    rf"|(?<![\w.+/-])(?:{_FLAT})?\d{{1,5}}(?: ?(?:bis|ter|[A-D]))?,? (?:{_FR}|{_FR.title()}) (?:(?:de la|de l['’]|des|du|de|d['’]|aux|la|le|les) ?)?{_CAP}(?:[ -]{_CAP})*"
    rf"|(?<![\w-])(?:{_FLAT})?(?:{_CAP}{_DE}|(?:(?:Am|An der|Auf dem|Im|Zum|Zur|Unter den|{_CAP}) )?{_CAP}[ -](?:Straße|Strasse|Str\.|Gasse|Weg|Ring|Allee|Platz|Ufer|Damm)) ?\d{{1,4}}(?:[a-z]\b)?"
    + rf"|(?<![\w-])(?:{_FLAT})?(?:{_ES}) (?:(?:de las|de los|de la|del|de|las|los|la|el) )*{_CAP}(?:[ -](?:de |del |la )?{_CAP})*,? (?:n\.?º ?)?\d{{1,4}}\b"
    + rf"|(?<![\w-])(?:{_FLAT})?(?:{_IT}) (?:(?:della|delle|dei|degli|del|di|dell['’]) ?)*{_CAP}(?: {_CAP})*,? (?:n\. ?)?\d{{1,4}}\b"
    + f"){_TOWN}"
)
_MAY_ADDRESS = re.compile(rf" (?:{_EN})\b|\d[A-Za-z]?(?: ?(?:bis|ter|[A-D]))?,? (?:{_FR}|{_FR.title()})\b|(?:{_DE}|Straße|Strasse|Str\.|Gasse|Weg|Ring|Allee|Platz|Ufer|Damm) ?\d|(?:{_ES}|{_IT}) ")

# --- names ----------------------------------------------------------------------------------------------
_W = r"[^\W\d_](?:[^\W\d_]|['’-](?=[^\W\d_]))+"
_I = r"[^\W\d_]\."
NAME = rf"(?:{_W}, {_W}(?: {_I})?|{_I}(?: ?{_I})? {_W}|{_W}(?: {_I})+ {_W}|{_W} {_W})"
# Words after which a person is named, with what follows the name where that is needed.
_TITLE = r"(?:(?:Mr|Mrs|Ms|Miss|Dr|Prof|Sr|Sra|Herr|Frau|Mme|Mlle)\.? )?"
_CUES = [
    r"(?:Maintainer|Reviewed-by|Signed-off-by|Co-authored-by|Acked-by|Tested-by|Reported-by|Author|Committer|Owner|Assignee|Contact|Customer|Patient|deliver to|ship to|Attn|Name): ",
    r"\b(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Mme|Mlle)\.? ",
    r"\b(?:owner|author|maintainer|assignee|name|full_name|customer|contact_name) ?[=:] ?[\"']?",
    r"\"(?:owner|author|maintainer|assignee|name|full_name|customer|contact_name)\": ?\"",
    r"\bVALUES \('",
    r"\bbelongs to ",
    r"\btitular ",
    r"\brow \d+: ",
    r"\bassignee ",
    r"\b[Mm]y name is ",
    r"\bich heiße ", r"\bme llamo ", r"\bje m['’]appelle ",
    r"<(?:name|owner|author|customer)>",
]
CUED_NAME = re.compile(rf"(?:{'|'.join(_CUES)}){_TITLE}({NAME})(?![\w@])")
# Cues so common that the text after the name has to agree.
FRAMED_NAME = re.compile(
    rf"\bBitte {_TITLE}({NAME}) unter [+\d(＋０-９]|\bcc {_TITLE}({NAME})(?=, (?:phone|tel|mail)|\n|$| <|,)|\bAsk {_TITLE}({NAME}) \(|\b(?:From|To|Cc): {_TITLE}({NAME})(?= <)|({NAME})(?= <[^<>\s@＠]*(?:[@＠]| at | ?[(\[]at))|({NAME}) reported it"
)
# Small words inside of family names.
_PARTICLE = "(?:van|von|der|den|de|da|di|dos|du|la|le|al|el|bin|ben|ter|zu|Ó|Ní|Mac)"
# Words before a name in running text; two capitalised words have to follow.
_SAID = (
    "talk to|talked to|speak to|speak with|spoke to|spoke with|met with|meet with|approved by|assigned to|reviewed by|written by|reported by|requested by|signed by|owned by|maintained by|introduced by|thanks to|according to|contact|emailed|called|pinged|ask|asked|tell|told|"
    "regards,|sincerely,|cheers,|gruß,|grüßen,|cordialement,|saludos,"
)
SAID_NAME = re.compile(rf"\b(?:{'|'.join(w[0].join('[]').replace(w[0], w[0].upper() + w[0]) + w[1:] for w in _SAID.split('|'))})[ \t\n]+{_TITLE}({_W}(?: {_PARTICLE})+ {_W}|{NAME})(?![\w@])")
# Capitalised words that make a phrase no person.
NO_PERSON = frozenset("team group support sales admin office department service services code review request pull data platform project product engineering security release build pipeline server client bot agent assistant user users monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december".split())
_MAY_NAME = re.compile(
    r"(?:" + "|".join(re.escape(w[1:]) for w in _SAID.split("|")) + r")[ \t\n]|(?:-by|[Mm]aintainer|[Aa]uthor|[Oo]wner|[Aa]ssignee|Customer|customer|Contact|contact_name|Committer|Patient|Attn|deliver to|ship to|belongs to|titular|[Mm]y name is|Bitte|Ask|cc|VALUES|row \d+|From|To|Cc|[nN]ame|M[rs]s?|Miss|Dr|Prof|Herr|Frau|Mme|Mlle|heiße|llamo|appelle)[ :.='\">(]| reported it| <[^<>\s@＠]*(?:[@＠]| at | ?[(\[]at)"
)
# Words that open a phrase but are no names.
NO_NAME = frozenset("the a an this that these those it its is was my your our and or not for with from to of in on at by if when then let use no yes please next first last all any der die das ein eine el la los las un una le les".split())
_FALLBACK = re.compile(rf"(?<![\w@.+/＠-]){NAME}(?![\w@＠]|[.+_-]\w)")

# --- folders --------------------------------------------------------------------------------------------
_PERSONAL = re.compile(r"(?:^|[/\\])(?:home|Users|users|share|Documents and Settings|profiles)[/\\]([^/\\]+)")
# Accounts that are no persons.
ACCOUNTS = frozenset("ubuntu dev runner build root admin administrator user users git ci deploy jenkins node app apps work www www-data guest public default shared share vagrant ec2-user azureuser runneradmin circleci gitlab-runner docker postgres mysql nobody service svc test tester data projects team teams tools".split())
_PARTS = re.compile(r"^([^\W\d_](?:[^\W\d_]|['’-](?=[^\W\d_]))*)(?:[ ._]|%20|, ?)+([^\W\d_](?:[^\W\d_]|['’-](?=[^\W\d_]))*)$")


_NEXT = re.compile(r"[\s,.]")


def _any_of(words: Iterable[str]) -> Callable[[str], bool]:
    """Whether any of ``words`` (lower case) occurs in a text, without regard to case."""
    words = sorted(words)
    if not words:
        return lambda s: False
    try:
        import ahocorasick
    except ImportError:
        pattern = re.compile("|".join(map(re.escape, words)))
        return lambda s: pattern.search(s.lower()) is not None
    automaton = ahocorasick.Automaton()
    for w in words:
        automaton.add_word(w, w)
    automaton.make_automaton()
    return lambda s: next(automaton.iter(s.lower()), None) is not None


def fold(s: str) -> str:
    return s.translate(_WIDE)


class Detector:
    """Finds personal data in one text. ``given`` and ``family`` are known name parts, in lower case."""

    def __init__(self, given: Iterable[str] = (), family: Iterable[str] = ()) -> None:
        self.given, self.family = frozenset(given), frozenset(family)
        self.hinted = _any_of(self.given | self.family)
        self.folder = lru_cache(FOLDER_CACHE)(self._folder)

    def know(self, given: Iterable[str], family: Iterable[str]) -> None:
        """Go on with these parts, which are few."""
        self.given, self.family = frozenset(given), frozenset(family)
        self.hinted = lambda s: bool(self.given or self.family)
        self.folder = self._folder

    def text(self, s: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) of the values in ``s``, by position; of overlapping ones the first kind wins."""
        found: list[tuple[str, int, int]] = []
        taken: list[tuple[int, int]] = []

        def take(kind: str, a: int, b: int) -> None:
            if b > a and all(b <= x or a >= y for x, y in taken):
                taken.append((a, b))
                found.append((kind, a, b))

        if _MAY_EMAIL.search(s):
            for m in EMAIL.finditer(s):
                take("email", *m.span())
        if _MAY_ADDRESS.search(s):
            for m in ADDRESS.finditer(s):
                take("address", *m.span())
        flat = s if s.isascii() else fold(s)
        bare: list[tuple[int, int]] = []
        if _MAY_IDNUM.search(flat):
            for m in CUED_IDNUM.finditer(flat):
                if m[1].isdigit() and _BARE_ID.search(flat, m.start(), m.start(1)):
                    bare.append(m.span(1))
                else:
                    take("idnum", *m.span(1))
            for m in IDNUM.finditer(flat):
                take("idnum", *m.span())
        if _MAY_PHONE.search(flat):
            for m in PHONE.finditer(flat):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 20:
                    take("phone", *m.span())
        if _MAY_NAME.search(s):
            for pattern in (CUED_NAME, FRAMED_NAME):
                for m in pattern.finditer(s):
                    i = next(i for i, g in enumerate(m.groups(), 1) if g)
                    if self._plausible(m[i]):
                        take("name", *m.span(i))
            for m in SAID_NAME.finditer(s):
                if self._person_words(m[1]):
                    take("name", *m.span(1))
        if self.hinted(s):
            at = 0
            while m := _FALLBACK.search(s, at):
                if self._certain(m[0]):
                    take("name", *m.span())
                    at = m.end()
                else:  # on to the next word, which may open a name
                    nxt = _NEXT.search(s, m.start())
                    at = nxt.end() if nxt else len(s)
        # A bare "id" is one of anything; it is a person's beside other data of the person.
        for a, b in bare:
            if any(0 <= a - y <= BESIDE or 0 <= x - b <= BESIDE for x, y in taken):
                take("idnum", a, b)
        found.sort(key=lambda x: x[1])
        return found

    def _person_words(self, name: str) -> bool:
        """In running text both words have to be capitalised and none may be one of no person."""
        words = [w for w in re.split(r"[ ,]+", name) if not re.fullmatch(_PARTICLE, w)]
        return len(words) > 1 and all(w[:1].isupper() and w.lower().strip(".") not in NO_NAME | NO_PERSON for w in words) and not any(w.isupper() and len(w) > 2 for w in words)

    def _plausible(self, name: str) -> bool:
        """After a cue any two words are a name, an initial being one, but for words that open a phrase."""
        return not any(w.lower() in NO_NAME for w in re.split(r"[ ,]+", name))

    def _certain(self, name: str) -> bool:
        """Outside of cues: known parts in the places of a full name."""
        words = [w for w in re.split(r"[ ,]+", name) if w]
        low = [w.lower() for w in words]
        if any(w in NO_NAME for w in low):
            return False
        full = [(w, x) for w, x in zip(words, low, strict=True) if not w.endswith(".")]
        if len(full) == 1:
            return full[0][1] in self.family
        (a, x), (b, y) = full[0], full[-1]
        if "," in name:
            return x in self.family and y in self.given
        if x in self.given and y in self.family:
            return True
        return a[0].isupper() and b[0].isupper() and (x in self.given or y in self.family) and a.isupper() == b.isupper()

    def _folder(self, s: str) -> list[tuple[str, int, int]]:
        found: list[tuple[str, int, int]] = []
        for kind, pattern in (("email", re.compile(rf"(?<![A-Za-z0-9._%+-]){_LOCAL}[@＠]{_DOMAIN}(?![A-Za-z0-9-]|:)")), ("idnum", re.compile(rf"(?<![^/\\])(?:\d{{3}}-?\d{{2}}-?\d{{4}}|{_NI}|\d{{8}}-?[A-Za-z]|[A-Za-z]{{2}}\d{{7}})(?![^/\\])"))):
            found += [(kind, *m.span()) for m in pattern.finditer(s)]
        for m in _PERSONAL.finditer(s):
            a, b = m.span(1)
            if m[1].lower() not in ACCOUNTS and all(b <= x or a >= y for _, x, y in found) and self._person(m[1], m[0]):
                found.append(("name", a, b))
        return sorted(found, key=lambda x: x[1])

    def _person(self, folder: str, where: str) -> bool:
        low = folder.lower()
        if m := _PARTS.match(folder):
            return not {m[1].lower(), m[2].lower()} & ACCOUNTS
        if "share" in where:
            return False
        for cut in range(1, len(low)):  # run together or hyphenated: mirabethcastrovel, mirabeth-lindemar, m-lindemar
            a, b = low[:cut].rstrip("-"), low[cut:].lstrip("-")
            if (a in self.given and len(b) > 1) or (b in self.family and a):
                return True
        return False


# --- surrogates -----------------------------------------------------------------------------------------
# Syllables of invented name parts by script, and the endings of given names (none known, f, m).
SYLLABLES = {
    "LATIN": ("B Br C D Dr F G Gr H J K L M N P R S T Tr V W Z", "a e i o u ai ea", "bin dor lan mar nik ros tan vel wen zan lio mir", ("e", "a", "o")),
    "CYRILLIC": ("Б В Г Д З К Л М Н П Р С Т Ф Х Ц", "а е и о у я", "бин дор лан мар ник рос тан вел зан лир мир нов", ("и", "а", "ий")),
    "GREEK": ("Β Γ Δ Ζ Θ Κ Λ Μ Ν Π Ρ Σ Τ Φ", "α ε η ι ο", "βιν δορ λαν μαρ νικ ροσ ταν βελ ζαν λιρ μιρ νοβ", ("ι", "α", "ος")),
    "CJK": ("安 本 村 林 森 田 山 石 原 沢 高 松", "一 介 太 和 光 明", "子 郎 彦 夫 美 人 平 司 男 代 里 香", ("", "", "")),
    "HANGUL": ("가 나 다 라 마 바 사 아 자 차 하 호", "민 서 지 현 수 영", "준 우 은 진 희 석 호 연 빈 아 율 원", ("", "", "")),
    "HIRAGANA": ("か さ た な は ま や ら わ", "い う え お", "きの しま ちか にし ひろ みや りこ ると", ("", "", "")),
    "KATAKANA": ("カ サ タ ナ ハ マ ヤ ラ ワ", "イ ウ エ オ", "キノ シマ チカ ニシ ヒロ ミヤ リコ ルト", ("", "", "")),
}
_SYLLABLES = {k: ([*a.split()], [*b.split()], [*c.split()], e) for k, (a, b, c, e) in SYLLABLES.items()}
# Country calling codes of one and two digits; all others have three.
CALLING = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
# Check letters of Spanish identity numbers, by remainder.
DNI_LETTERS = "trwagmyfpdxbnjzsqvhlcke"
# Words of addresses that stay, beside the kinds of streets.
_STAY = "apt apartment flat unit suite ste room bis ter de la l des du d aux le les del las los el n am an der auf dem im zum zur unter den della delle dei degli di dell str c"
STAY = frozenset([*_STAY.split(), *_EN.lower().split("|"), *_FR.split("|"), *(re.sub(r"\W", "", w.lower()) for w in f"{_ES}|{_IT}".split("|")), "straße", "strasse", "gasse", "weg", "ring", "allee", "platz", "ufer", "damm"])
_COMPOUND = re.compile(rf"(.{{2,}}?)({_DE[3:-1]}|str)")
_TOKEN = re.compile(r"[^\W_]+")
_NAME_TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
# Titles that tell a gender.
_GENDER = [("f", re.compile(r"\b(?:Mrs|Ms|Miss|Frau|Mme|Mlle|Sra)\.? $")), ("m", re.compile(r"\b(?:Mr|Herr|Sr)\.? $"))]


def gender(text: str, start: int) -> str:
    """What a title right before ``start`` says: f, m or nothing."""
    return next((g for g, p in _GENDER if p.search(text, max(0, start - 8), start)), "")


def canonical(kind: str, value: str) -> str:
    """What equal entities share: case, width, punctuation, spelling of an email, prefix of a phone number and order of a name are folded."""
    v = fold(value).lower()
    if kind == "email":
        v = re.sub(r" dot | ?[(\[]dot[)\]] ?", ".", v.replace("＠", "@"))
        return re.sub(r" at | ?[(\[]at[)\]] ?", "@", v)
    if kind == "phone":
        v = re.sub(r"[^0-9+]", "", re.split(r"ext|x", v)[0])
        return "+" + v[2:] if v.startswith("00") else v
    if kind == "idnum":
        return re.sub(r"[^0-9a-z]", "", v)
    if kind == "name":
        v = v.replace("%20", " ")
        if "," in v:
            a, _, b = v.partition(",")
            v = f"{b.strip()} {a}"
        return re.sub(r"[\s._]+", " ", v).strip()
    return re.sub(r"[\s,]+", " ", v).strip()


def full_names(found: list[tuple[str, str]]) -> dict[str, str]:
    """Of the names in one record those with an initial -> the one full name there that they stand for."""
    names = {e for kind, e in found if kind == "name"}
    out = {}
    for e in names:
        words = e.split(" ")
        if len(words[0]) == 1:
            like = [f for f in names if (w := f.split(" "))[1:] == words[1:] and len(w[0]) > 1 and w[0][0] == words[0]]
            if len(like) == 1:
                out[e] = like[0]
    return out


def _draw(key: bytes, *what: str) -> int:
    return int.from_bytes(hmac.new(key, "\0".join(what).encode("utf-8", "replace"), hashlib.blake2b).digest()[:16], "big")


def _script(word: str) -> str:
    return next((n for c in word if c.isalpha() and (n := unicodedata.name(c, "").split(" ")[0]) in _SYLLABLES), "LATIN")


def _word(n: int, like: str, ending: int | None = None) -> str:
    """An invented word in the script of ``like``; hyphens stay."""
    out = []
    for part in like.split("-"):
        on, mid, off, ends = _SYLLABLES[_script(part)]
        for parts in (on, mid, off, on, mid):
            n, i = divmod(n, len(parts))
            out.append(parts[i].lower() if out and out[-1] != "-" else parts[i])
            if parts is off and len(part) < 6:
                break
        out += [off[n % len(off)]] if len(part) >= 6 else []
        out.append("-")
    return "".join(out[:-1]) + ("" if ending is None else _SYLLABLES[_script(like)][3][ending])


def digits(key: bytes, kind: str, s: str) -> str:
    """A keyed permutation of digit strings of one length (a Feistel network), so no two values collide."""
    n = len(s)
    if n < 2:
        return s
    a, b = s[: n // 2], s[n // 2 :]
    for i in range(6):
        m = 10 ** len(a)
        a, b = b, f"{(int(a) + _draw(key, kind, str(n), str(i), b)) % m:0{len(a)}d}"
    return a + b


def _phone(k: bytes, entity: str) -> str:
    if entity.startswith("+"):
        n = next((i for i in (1, 2) if entity[1 : 1 + i] in CALLING), 3)
        return entity[: 1 + n] + digits(k, "phone" + entity[1 : 1 + n], entity[1 + n :])
    return "0" + digits(k, "phone0", entity[1:]) if entity.startswith("0") else digits(k, "phone", entity)


def _idnum(k: bytes, entity: str) -> str:
    d = digits(k, "idnum" + re.sub(r"\d", "9", re.sub(r"[a-z]", "a", entity)), re.sub(r"\D", "", entity))
    it, out = iter(d), []
    for i, c in enumerate(entity):
        if c.isdigit():
            out.append(next(it))
        elif re.fullmatch(r"\d{8}[a-z]", entity):
            out.append(DNI_LETTERS[int(d) % 23])
        else:
            low, n = ("a", 4) if i == len(entity) - 1 and c in "abcd" else ("a", 26)
            out.append(chr(ord(low) + (ord(c) - ord(low) + _draw(k, "letter", d, str(i))) % n))
    return "".join(out)


def _token(k: bytes, entity: str, i: int, word: str) -> str:
    """One word or number of an address."""
    if word in STAY:
        return word
    if m := re.fullmatch(r"(\d+)(\D*)", word):
        first = "" if m[1][0] != "0" else "0"
        n = _draw(k, "number", entity, str(i))
        body = "".join(str((n // 10**j) % 10) for j in range(len(m[1]) - len(first)))
        return first + ("1" + body[1:] if body.startswith("0") and not first else body) + "".join(chr(97 + (n >> 64) % 26) if "a" <= c <= "z" else c for c in m[2])
    if len(word) == 1:
        return _word(_draw(k, "letter", entity, str(i)), word)[0].lower()
    if m := _COMPOUND.fullmatch(word):
        return _word(_draw(k, "street", entity, str(i)), m[1]).lower() + m[2]
    return _word(_draw(k, "word", entity, str(i)), word).lower()


def surrogate(kind: str, entity: str, key: str, gender: str = "", round: int = 0) -> str:
    """A choice for ``entity``, another in each round; ``assign`` sees to it that no two get the same."""
    k = f"{key}\0{round}".encode()
    if kind == "phone":
        return _phone(k, entity)
    if kind == "idnum":
        return _idnum(k, entity)
    if kind == "address":
        return " ".join(_token(k, entity, i, w) for i, w in enumerate(_TOKEN.findall(entity)))
    n = _draw(k, kind, entity)
    if kind == "email":
        return f"{_word(n, 'abc')}.{_word(n >> 60, 'abcdef')}@example.com".lower()
    words = _NAME_TOKEN.findall(entity)
    given = next((i for i, w in enumerate(words) if len(w) > 1), 0)
    ending = {"": 0, "f": 1, "m": 2}[gender]
    return " ".join(_word(_draw(k, "initial", entity, str(i)), "a")[0] if len(w) == 1 and i else _word(_draw(k, kind, entity, str(i)), w, ending if i == given and len(words) > 1 else None) for i, w in enumerate(words))


def _styled(word: str, like: str) -> str:
    if like.isupper() and len(like) > 1:
        return word.upper()
    return word[:1].upper() + word[1:] if like[:1].isupper() else word.lower() if like.islower() else word


def dress(kind: str, surrogate: str, value: str) -> str:
    """The surrogate in the case, order and format of the written value."""
    if kind in ("phone", "idnum"):
        flat = fold(value)
        it = iter(re.sub(r"[^0-9a-z]", "", ("00" if kind == "phone" and flat.startswith("00") else "") + surrogate.lower()))
        wide = lambda d, c: chr(ord(d) + 0xFEE0) if c > "9" else d
        # An extension belongs to no entity; its digits are blanked.
        return "".join(wide(next(it, "0"), c) if c.isdigit() else (next(it, c).upper() if c.isupper() else next(it, c)) if kind == "idnum" and c.isalpha() else c for c in value)
    if kind == "email":
        if "＠" in value:
            surrogate = surrogate.replace("@", "＠")
        elif m := re.search(r" at | ?[(\[]at[)\]] ?", value, re.IGNORECASE):
            dot = re.search(r" dot | ?[(\[]dot[)\]] ?", value, re.IGNORECASE)
            surrogate = surrogate.replace("@", m[0]).replace(".", dot[0] if dot else ".")
        return surrogate.upper() if value.isupper() else surrogate
    pattern, words = (_NAME_TOKEN, surrogate.split(" ")) if kind == "name" else (_TOKEN, surrogate.split(" "))
    text = value.replace("%20", "\0") if kind == "name" else value
    spots = list(pattern.finditer(text))
    if kind == "name" and "," in text:  # the family name was written first
        n = sum(m.start() < text.index(",") for m in spots)
        words = words[len(spots) - n : len(spots)] + words[: len(spots) - n] + words[len(spots) :]
    out, at = [], 0
    for m, w in zip(spots, words, strict=False):
        out += [text[at : m.start()], _styled(w[:1] if kind == "name" and len(m[0]) == 1 else w, m[0])]
        at = m.end()
    return "".join([*out, text[at:], *(f" {w}" for w in words[len(spots) :])]).replace("\0", "%20")


# --- the operator ---------------------------------------------------------------------------------------
_FOUND_DDL = "record_id long, field_name string, pii_kind string, start_at long, length long, value string, entity string, gender string, mark long"
_FOUND = pa.schema([("record_id", pa.int64()), ("field_name", pa.string()), ("pii_kind", pa.string()), ("start_at", pa.int64()), ("length", pa.int64()), ("value", pa.string()), ("entity", pa.string()), ("gender", pa.string()), ("mark", pa.int64())])


def _parts(name_hints: DataFrame) -> DataFrame:
    return name_hints.filter("name_part is not null").select(F.lower("name_part").alias("word"), (F.coalesce("part_kind", F.lit("")) == "family").alias("family")).distinct()


def known_parts(name_hints: DataFrame) -> tuple[list[str], list[str]] | None:
    """(given, family) in lower case; None where they are more than ``MOST_HINTS``."""
    rows = _parts(name_hints).limit(MOST_HINTS + 1).collect()
    if len(rows) > MOST_HINTS:
        return None
    return sorted(r[0] for r in rows if not r[1]), sorted(r[0] for r in rows if r[1])


def _with_own_parts(rows: DataFrame, name_hints: DataFrame) -> DataFrame:
    """Add ``given`` and ``family``: the listed parts that a row's texts hold, also as the begin or end of a folder's name."""
    mark = [F.xxhash64(F.lit(salt), *FIELDS) for salt in (0, 1)]
    marked = rows.withColumns({"m1": mark[0], "m2": mark[1]})
    split = lambda c: F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}'’-]+")
    cuts = lambda w: F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.array(F.substring(w, F.lit(1), i), F.substring(w, i, F.length(w)))))
    words = F.array_distinct(F.concat(split(F.col("item_text")), split(F.col("item_content")), F.flatten(F.transform(split(F.col("cwd")), cuts))))
    held = marked.select("m1", "m2", F.explode(words).alias("word")).distinct().join(_parts(name_hints), "word")
    pick = lambda family: F.collect_set(F.when(F.col("family") == family, F.col("word")))
    return marked.join(held.groupBy("m1", "m2").agg(pick(False).alias("given"), pick(True).alias("family")), ["m1", "m2"], "left").select(*rows.columns, "given", "family")


def detect(claude_session: DataFrame, name_hints: DataFrame) -> DataFrame:
    """One row per detected value, with its entity, the gender that a title gives it and the mark of its text.

    ``start_at`` and ``length`` count characters (code points), from 1. Null and empty texts give no rows;
    texts are searched whole, however long. A name written with an initial belongs to the one full name of its
    record that it fits.
    """
    parts = known_parts(name_hints)
    rows = claude_session.select("record_id", *FIELDS, *[F.xxhash64(f).alias(f"mark_{f}") for f in FIELDS])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector = Detector(*(parts or ((), ())))
        for batch in batches:
            out = []
            for ident, *texts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if parts is None:
                    detector.know(texts[-2] or (), texts[-1] or ())
                found = []
                for name, s, mark in zip(FIELDS, texts[:3], texts[3:6], strict=True):
                    for kind, a, b in (detector.folder if name == "cwd" else detector.text)(s) if s else ():
                        found.append((ident, name, kind, a + 1, b - a, s[a:b], canonical(kind, s[a:b]), gender(s, a) if kind == "name" else "", mark))
                if found:
                    full = full_names([(r[2], r[6]) for r in found])
                    out += [(*r[:6], full.get(r[6], r[6]), *r[7:]) if r[2] == "name" else r for r in found]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _FOUND, strict=True)], schema=_FOUND)

    return (rows if parts is not None else _with_own_parts(rows, name_hints)).mapInArrow(run, _FOUND_DDL)


_CHOICE_DDL = "pii_kind string, entity string, gender string, surrogate string, taken string"


def _choices(key: str, round: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, names, genders = (batch.column(c).to_pylist() for c in ("pii_kind", "entity", "gender"))
            made = [surrogate(k, e, key, g, round) for k, e, g in zip(kinds, names, genders, strict=True)]
            taken = [canonical(k, s) for k, s in zip(kinds, made, strict=True)]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in (kinds, names, genders, made, taken))], names=["pii_kind", "entity", "gender", "surrogate", "taken"])

    return run


def assign(found: DataFrame, key: str) -> DataFrame:
    """(pii_kind, entity, surrogate): one per distinct entity, no two alike within a kind, none a value of the data.

    In each round every entity still without a surrogate draws one. It is kept if it is no entity of the data,
    nobody's from an earlier round, and nobody's with a smaller name in this one. What is open after ``ROUNDS``
    draws, hardly anything, gets a number worked in. Where titles disagree an entity has no gender.
    """
    if not key:
        raise ValueError("surrogates need a key")
    told = F.when(F.col("gender") != "", F.col("gender"))
    one = F.when(F.min(told) == F.max(told), F.min(told)).otherwise("")
    every = settle(found.groupBy("pii_kind", "entity").agg(one.alias("gender")), "entities")
    pending, done = every, None
    for round in range(ROUNDS):
        drawn = settle(pending.select("pii_kind", "entity", "gender").mapInArrow(_choices(key, round), _CHOICE_DDL), "drawn")
        free = drawn.join(every.select("pii_kind", F.col("entity").alias("taken")), ["pii_kind", "taken"], "left_anti")
        if done is not None:
            free = free.join(done.select("pii_kind", "taken"), ["pii_kind", "taken"], "left_anti")
        first = F.row_number().over(Window.partitionBy("pii_kind", "taken").orderBy("entity"))
        kept = settle(free.withColumn("n", first).filter("n = 1").drop("n").select(*drawn.columns), "kept")
        done = kept if done is None else done.unionByName(kept)
        pending = drawn.join(kept.select("pii_kind", "entity"), ["pii_kind", "entity"], "left_anti")
        if not pending.limit(1).count():
            discard(every)
            discard(drawn)
            return done.select("pii_kind", "entity", "surrogate")
    rank = F.row_number().over(Window.partitionBy("pii_kind", "taken").orderBy("entity"))
    rest = pending.withColumn("surrogate", F.concat("surrogate", F.when(F.col("pii_kind").isin("name", "address"), " n").otherwise("-"), rank.cast("string")))
    return done.unionByName(rest).select("pii_kind", "entity", "surrogate")


def entities(claude_session: DataFrame, name_hints: DataFrame, key: str) -> DataFrame:
    """The detected values with their settled surrogates.

    Texts are searched once; the values are written to the shared folder. The surrogates are settled on distinct
    entities and joined back, so an entity that holds a third of all values is one row while collisions are
    checked, and an ordinary skewed key in the join.
    """
    found = settle(detect(claude_session, name_hints), "found")
    return found.join(assign(found, key), ["pii_kind", "entity"])


def redact(claude_session: DataFrame, name_hints: DataFrame, key: str, mode: str = "placeholder") -> DataFrame:
    """(record_id, field_name, redacted): the fields that held personal data, with it replaced.

    ``placeholder`` writes ``<KIND:surrogate>``, ``surrogate`` the surrogate alone in the value's own format.
    Everything between the values stays as it is. Fields without a value have no row. Each text carries a mark,
    so rows that share a record_id stay apart.
    """
    placeholder = mode == "placeholder"
    place = ["record_id", "field_name", "mark"]
    spans = entities(claude_session, name_hints, key).groupBy(*place).agg(F.array_sort(F.collect_set(F.struct("start_at", "length", "pii_kind", "surrogate"))).alias("spans"))
    texts = claude_session.select("record_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("t")) for f in FIELDS])).alias("x")).select("record_id", "x.*").filter("t is not null").withColumn("mark", F.xxhash64("t"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for s, spans in zip(batch.column("t").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                at, parts = 0, []
                for x in spans:
                    a = x["start_at"] - 1
                    b = a + x["length"]
                    if a >= at:
                        worn = dress(x["pii_kind"], x["surrogate"], s[a:b])
                        parts += [s[at:a], f"<{x['pii_kind'].upper()}:{worn}>" if placeholder else worn]
                        at = b
                out.append("".join([*parts, s[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column("record_id"), batch.column("field_name"), pa.array(out, pa.string())], names=["record_id", "field_name", "redacted"])

    a, b = texts.alias("a"), spans.alias("b")
    same = [F.col("a.record_id").eqNullSafe(F.col("b.record_id")), F.col("a.field_name") == F.col("b.field_name"), F.col("a.mark") == F.col("b.mark")]
    return a.join(b, same).select("a.record_id", "a.field_name", "a.t", "b.spans").mapInArrow(run, "record_id long, field_name string, redacted string")
