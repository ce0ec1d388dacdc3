"""Personal information in free text, found and replaced by typed placeholders.

Method: a semi-Markov conditional random field (crf.py). Whole candidate segments carry features: their form, the
words around them, what the name hints and the corpus say of their words. Dynamic programming over the segments
chooses boundaries and types together; entities are bounded (MOST_CHARS), which keeps it linear in the text.

Weights are trained here by likelihood on a bounded sample of rows. No labelled rows exist, so rows are labelled
in part by rules that don't use the field (label): a number beside a general word for a telephone or an identity
document, a name of which the hints know every part, an address with street and number, an e-mail address with its
sign. All else stays open, and the likelihood sums over it; so the field learns forms of numbers, sentence frames
and boundaries from the corpus itself. PRIOR holds the means of the weights' prior, not the weights."""

from __future__ import annotations

import bisect
import copy
import math
import re
import unicodedata
from collections.abc import Callable, Collection, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsift.llm.crf import OPEN, RIGHT, WRONG, Segment, Weights, decode, fit, marginals
from kinsift.session import spread

KINDS = ("email", "phone", "id_number", "address", "name")
#: No segment is longer than this.
MOST_CHARS = 160
#: Nor has a name more words (with its initials and particles) before the one that is known or rare.
MOST_WORDS = 16
#: Chinese characters beside a name that are worth at least this much tell family names that the hints lack.
SIGN = 0.15
#: Levels of a capitalised word's document frequency, each twice the one before; from EVERYDAY on it is no name by itself.
MOST_LEVEL, EVERYDAY = 4, 3
_EVERYDAY = frozenset(f"freq={n}" for n in range(EVERYDAY, MOST_LEVEL + 1))


def _class(*categories: str) -> str:
    """The characters of Unicode categories as ranges of a character class."""
    own = [c for c in range(0x250 * 0x100) if unicodedata.category(chr(c)) in categories]
    starts = [c for c, before in zip(own, [-2, *own]) if c != before + 1]
    ends = [c for c, after in zip(own, [*own[1:], -2]) if c != after - 1]
    return "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends))


#: Capital and small letters of every script that has them.
_UP, _LOW = _class("Lu", "Lt"), _class("Ll")
_L = _UP + _LOW
_WORD = rf"[{_UP}][{_L}]*(?:['’-][{_L}]+)*"

# ---------------------------------------------------------------- e-mail
_AT = r"(?:@|\s?[\[({]\s?at\s?[\])}]\s?|\s@\s|\sat\s)"
_DOT = r"(?:\.|\s?[\[({]\s?dot\s?[\])}]\s?|\sdot\s)"
_EMAIL = re.compile(rf"(?<![A-Za-z0-9._+-])[A-Za-z0-9][A-Za-z0-9._+'-]*{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+", re.I)
_HAS_EMAIL = re.compile(r"[@\[({dD](?:(?<=@)|(?<=[\[({])\s?[aA][tT]\s?[\])}]|(?<=[dD])[oO][tT]\b)")

# ---------------------------------------------------------------- numbers
_DIGIT = r"[0-9０-９]"
_NUMERIC = re.compile(rf"(?<![\w.+-])(?:[+＋]|\()?{_DIGIT}(?:[ .()/–－—-]{{0,3}}{_DIGIT})+(?![\w])", re.ASCII)
_EXTENSION = re.compile(r"\s?(?:ext\.?|extension|x|доб\.?|poste|转)\s?\d{1,5}(?!\w)", re.I)
_CHUNK = re.compile(r"[A-Za-z0-9]+")
_CODE = re.compile(r"(?<![A-Za-z0-9])[A-Z0-9]+(?:[ .-][A-Z0-9]+)*(?![A-Za-z0-9])")
_HAS_NUMBER = re.compile(rf"{_DIGIT}(?:[A-Z .()/–－—-]{{0,3}}{_DIGIT}){{5}}")
#: Dates, dotted network addresses and book numbers: 9 a digit.
_NO_PERSONAL = re.compile(r"(?:9{4}-9{2}-9{2}(?: 9{2})?|9{2}[./]9{2}[./]9{4}(?: 9{2})?|9{1,3}(?:\.9{1,3}){3}|9{3}-9-9{2,7}-9{1,6}-9)\Z")

# General words for what a number is, the seeds that rows are labelled by.
SEEDS = {
    "phone": "phone telephone tel mobile cell cellphone fax telefon telefonnummer handy mobil rufnummer téléphone portable tél teléfono móvil телефон тел факс call dial rufen anrufen appelez llame звоните позвоните 电话 手机 传真 拨打 致电",
    "id_number": "id ssn social passport card personal identity identification national ausweis ausweisnummer personalausweis karte steuernummer identité carte passeport matricule dni nie nif pasaporte identidad carné паспорт удостоверение личный снилс инн 身份证 护照 证件",
    "none": "part lot batch build version release isbn order invoice page section chapter code serial item teil teilenummer charge auftrag seite abschnitt pièce commande pieza lote pedido página sección деталь партия заказ страница раздел 零件 批次 订单",
}
_SEED_OF: dict[str, list[str]] = {}
for _kind, _words in SEEDS.items():
    for _w in _words.split():
        _SEED_OF.setdefault(_w, []).append(_kind)
_HAN = re.compile(r"[㐀-鿿]")
_HAN_SEEDS = [(w, ks) for w, ks in _SEED_OF.items() if _HAN.match(w)]


# ---------------------------------------------------------------- addresses
def _address_patterns(up: str, low: str) -> list[str]:
    """Street and number with the places that may follow or stand before, by the way a language writes addresses."""
    letter = up + low
    word = rf"[{up}][{letter}]*(?:['’-][{letter}]+)*"
    place = rf"(?:(?:г|пос|с|дер)\.\s)?{word}(?:(?: (?:del|de la|de|du|am|an der|im|on|sur) | )(?!(?:St|Rue)\b|[CDJLMNSTQ]['’]){word})?"
    post = r"(?:[A-Z]{1,2}\d[A-Z\d]?\s\d[A-Z]{2}|\d{5}(?:-\d{4})?)"
    town = rf"(?:,\s(?:\d{{5}}\s)?{place})?"
    en = rf"\d{{1,4}}[a-z]?\s(?:{word}\s){{1,3}}?(?:Street|Lane|Avenue|Road|Court|Drive|Way|Square|Close|Terrace|Place|Boulevard|Crescent|Grove|Row|(?:St|Ave|Rd|Ln|Ct|Dr|Blvd)\b\.?)"
    en = rf"(?:(?:(?:Apt|Apartment|Flat|Unit|Suite)\.?\s\d+[a-z]?,\s)?{en}|P\.?\s?O\.?\sBox\s\d+)"
    de = rf"(?:(?:(?:[{up}][{low}]*(?:straße|strasse|str\.|weg|gasse|allee|platz|ring|ufer|damm|zeile|graben|steig))|(?:Am|An der|An den|Im|In der|Auf der|Auf dem|Zum|Zur|Lange|Kurze|Alte|Neue|Hohe)\s{word}(?:\s{word})?)\s\d{{1,4}}(?:\s?[a-h]\b)?|Postfach\s\d+(?:\s\d+)*)"
    fr = rf"(?:\d{{1,4}}(?:\s(?:bis|ter|quater))?,?\s(?:rue|avenue|av\.|bd|boulevard|chemin|place|allée|impasse|quai|cours|route|square|passage)\s(?:(?:de la|de l['’]|du|des|de|d['’])\s?)?{word}(?:\s{word})?|BP\s\d+)"
    es = rf"(?:Calle|C/|Avda\.|Avenida|Plaza|Pza\.|Paseo|Camino|Ronda|Travesía|Apdo\.)\s(?:(?:del|de la|de los|de las|de)\s)?{word}(?:\s{word})?(?:,\sn\.º\s\d+|,\s\d+|\s\d+)(?:,\s\d+\.º\s(?:[A-Z]\b|\d+))?"
    ru_town = rf"(?:г|пос|с|дер)\.\s{word}(?:\s{word})?"
    ru = rf"(?:(?:ул|просп|пр|пер|пл|наб|бул|ш)\.\s{word}(?:\s{word})?|{word}\s(?:ул|просп|пр|пер|пл|наб|бул|ш)\.),\s(?:д\.\s)?\d+[а-я]?(?:,\sкв\.\s\d+)?"
    han = "(?![是到送址在于为往请从])[㐀-鿿]"
    zh = rf"(?:{han}){{1,4}}[街路巷道]\d+号(?:\d+[楼栋])?(?:\d+[室])?"
    return [
        rf"{en}(?:,\s{place}(?:\s{post})?)?", de + town, fr + town, es + town,
        rf"(?:(?:\d{{6}},\s)?{ru_town},\s)?{ru}(?:,\s{ru_town})?", rf"(?:(?:{han}){{2,3}}[市县镇区乡])?{zh}",
    ]


#: Pattern of an address, and a cheap sign that a text may hold one.
_ADDRESS = [
    (re.compile(whole), re.compile(sign))
    for whole, sign in zip(
        _address_patterns(_UP, _LOW),
        (r"\d[a-z]?\s[A-Z]|Box\s\d", r"[a-zß.]\s\d", r"\d,?\s(?:[a-z]|bis|ter)|BP\s\d", r"Calle|C/|Avda|Avenida|Plaza|Pza|Paseo|Camino|Ronda|Traves|Apdo", r"(?:ул|просп|пр|пер|пл|наб|бул|ш)\.", r"\d号"),
    )
]
_HAS_DIGIT = re.compile(r"\d")

# ---------------------------------------------------------------- names
_PART = r"(?:de|da|di|do|dos|das|van|von|der|den|zu|la|las|los|le|del|della|du|af|av|ter|ten|bin|ibn|al|el|y)"
_IS_PART = re.compile(_PART)
_INITIAL = rf"[{_UP}]\."
_HAS_INITIAL = re.compile(_INITIAL)
_OPEN = rf"[{_UP}](?<![{_L}'’-][\s\S])"  # a capital letter that opens a word
_FIRST = rf"{_OPEN}[{_L}]*(?:['’-][{_L}]+)*"
_NAMES = [
    re.compile(rf"{_OPEN}\.\s?(?:{_INITIAL}\s?)*(?:{_PART}\s){{0,3}}{_WORD}(?![{_L}'’])"),  # I. (I.) Family
    re.compile(rf"{_FIRST}(?:\s{_INITIAL})*\s(?:{_PART}\s){{0,3}}{_WORD}(?![{_L}'’])"),  # Given (I.) Family
    re.compile(rf"{_FIRST},\s{_WORD}(?![{_L}'’])"),  # Family, Given; particles before it are added
    re.compile(rf"{_FIRST}(?: (?:{_PART} ){{0,3}}{_WORD}){{2}}(?![{_L}'’])"),  # Given Given Family, Given Family Family
    re.compile(rf"{_FIRST}(?: (?:{_PART} ){{0,3}}{_WORD}){{3}}(?![{_L}'’])"),  # Given Given Family Family
    re.compile(rf"{_FIRST}(?![{_L}'’])"),  # Family, after a title; particles before it are added
]
_WITH_PARTICLES = re.compile(rf"\b(?:{_PART}\s)+{_WORD}")
_PARTICLES = re.compile(rf"(?<![{_L}'’-])(?:{_PART}\s){{1,3}}\Z")
_ALONE = 5
#: What stands before a name that may be a family name alone.
_TITLE = r"(?<![^\W_])(?:(?:[Dd]r|[Pp]rof|[Mm]rs?|[Mm]s|[Mm]me|[Mm]lle|[Ss]ra?|[Ss]rta)\.?|[Mm]iss|[Pp]rofessor|Frau|Herrn?|Fräulein|Monsieur|Madame|[Ss]eñora?|[Dd]oña|господин|госпожа)\s"
_TITLED = re.compile(_TITLE + r"\Z")
_TITLES = frozenset("dr mr mrs ms miss prof professor frau herr herrn fräulein mme mlle monsieur madame señor señora sra sr srta doña господин госпожа".split())
_HAN_TITLE = re.compile("先生|女士|老师|教授|博士")
_STREET = frozenset("street lane avenue road court drive way square close terrace place boulevard ave st rd weg box apt postfach calle plaza avda rue".split())
_MORE_NAME = re.compile(rf"(?: {_PART})* (?:{_INITIAL}|[{_UP}][{_LOW}])")
_NAME_WORD = re.compile(rf"[{_L}'’-]+")

# Means of the prior: what a feature is worth where the rows say nothing.
PRIOR: Weights = {
    "email": {"bias": 4.0, "bare": -9.0},
    "phone": {"bias": -3.0, "seed=phone": 4.5, "seed=id_number": -2.0, "seed=none": -5.0, "part": -4.0, "no": -8.0, "letters": -9.0, "plus": 1.5, "intl": 4.5, "grouped": 0.5, "short": -2.0, "long": -4.0, "ext": 2.0},
    "id_number": {"bias": -3.0, "seed=id_number": 4.5, "seed=phone": -2.0, "seed=none": -5.0, "part": -4.0, "no": -8.0, "plus": -6.0, "letters": 0.5},
    "address": {"bias": 2.5, "element": 1.0, "common_end": -4.0, "two": 0.0, "opens": 1.0, "more": -1.0},
    "name": {"bias": -3.5, "given": 3.0, "family": 2.5, "initials": 1.5, "upper": 0.8, "common": -4.0, "freq=3": -1.0, "freq=4": -2.0, "titled": 3.5, "street": -6.0, "comma": -0.8, "comma_known": 1.5, "middle": 0.2, "middle_known": 0.8, "words": 0.3, "more": -3.0, "han": 2.0, "han_title": 2.0, "given_often": 1.0, "given_never": -4.0},
}


def _spread(feature: str) -> float:
    """How far the rows may move a weight: those of single words and forms less than those of general features."""
    return 1.0 if "=" in feature and not feature.startswith("seed=") else 2.0


class Lexicon:
    """Given and family names from the hints, the the words that are common in small letters, how frequent
    capitalised words are, how often each Chinese character stands in a given name's place."""

    def __init__(self, given: Iterable[str], family: Iterable[str], common: Iterable[str], han_share: dict[str, float] | None = None, frequent: dict[str, int] | None = None) -> None:
        given, family = list(given), list(family)
        self.given = frozenset(x.lower() for x in given)
        self.family = frozenset(x.lower() for x in family)
        self.common = frozenset(common)
        self.parts = frozenset(w for x in self.given | self.family for w in (x, *x.split("-"), *x.split(" ")) if not _IS_PART.fullmatch(w))
        self.han_share = dict(han_share or {})
        self._set_han(x for x in family if _HAN.match(x))
        self.frequent = dict(frequent or {})
        self._marks: dict[str, str] = {}  # memory of mark()

    def _set_han(self, family: Iterable[str]) -> None:
        self.han_family = sorted(family, key=lambda x: (-len(x), x))
        self.han = re.compile("(?:" + "|".join(map(re.escape, self.han_family)) + r")[㐀-鿿]{1,2}") if self.han_family else None

    def with_han(self, family: Iterable[str]) -> Lexicon:
        out = copy.copy(self)
        out._set_han(family)
        return out

    def level(self, word: str) -> int:
        """How frequent a capitalised word is, written so or all in capitals; 0: hardly."""
        return self.frequent.get(word, 0) or (self.frequent.get(word.title(), 0) if word.isupper() else 0)

    def mark(self, word: str) -> str:
        """title, name (a capitalised word that is known for one, or not an everyday word) or nothing."""
        out = self._marks.get(word)
        if out is None:
            if len(self._marks) > 200_000:
                self._marks.clear()
            name = word[0].isupper() and (self.level(word) < EVERYDAY or self.knows(word))
            out = self._marks[word] = "title" if word.lower() in _TITLES else "name" if name else ""
        return out

    def knows(self, word: str) -> bool:
        w = word.lower()
        return w in self.parts or ("-" in w and any(p in self.parts for p in w.split("-")))


_LETTERS = re.compile(r"[^\W\d_]+")
_SENTENCE_END = re.compile(r"[.!?]\s|[。！？\n]")


class _Context:
    """Features of what stands before and after a position, each worked out once."""

    def __init__(self, text: str) -> None:
        self.text, self.left, self.right = text, {}, {}

    def before(self, at: int) -> tuple[tuple[str, ...], frozenset[str]]:
        """The two words before (in one sentence), or the Chinese characters; and the kinds that seed words say."""
        if at not in self.left:
            near = self.text[max(0, at - 32) : at]
            found = list(_LETTERS.finditer(near))[-2:]
            if len(found) == 2 and _SENTENCE_END.search(near[found[0].end() : found[1].start()]):
                found = found[1:]
            if found and self.text[at : at + 1].isalpha() and _SENTENCE_END.search(near[found[-1].end() :]):
                found = []  # before a number, a full stop may as well end an abbreviation
            words = [m.group().lower() for m in found][::-1]
            kinds = {k for w in words for k in _SEED_OF.get(w, ())}
            head = near.rstrip("：: ")
            if head and _HAN.match(head[-1]):
                words = [head[-2:], head[-1]]
                kinds |= {k for w, ks in _HAN_SEEDS if w in head[-6:] for k in ks}
            self.left[at] = tuple(f"b{i}={w}" for i, w in enumerate(words, 1)) or ("b1=",), frozenset(kinds)
        return self.left[at]

    def after(self, at: int) -> tuple[tuple[str, ...], frozenset[str]]:
        """The same for the next word; seed words may be among the next three."""
        if at not in self.right:
            near = self.text[at : at + 40]
            end = _SENTENCE_END.search(near)
            near = near[: end.start()] if end else near
            words = [m.group().lower() for m in _LETTERS.finditer(near)][:3]
            kinds = {k for w in words for k in _SEED_OF.get(w, ())}
            tail = near.lstrip(" ，")
            if tail and _HAN.match(tail[0]):
                words = [tail[:2]]
            self.right[at] = ((f"a1={words[0]}",) if words else ("a1=",)), frozenset(kinds)
        return self.right[at]

    def words(self, b: int, e: int) -> tuple[str, ...]:
        return self.before(b)[0] + self.after(e)[0]

    def seeds(self, b: int, e: int) -> list[str]:
        return [f"seed={k}" for k in sorted(self.before(b)[1] | self.after(e)[1])]


# ---------------------------------------------------------------- candidates
def _emails(text: str) -> Iterator[Segment]:
    if not _HAS_EMAIL.search(text):
        return
    for m in _EMAIL.finditer(text):
        item = m.group()
        plain = "@" in item or re.search(r"[\[({]\s?at", item, re.I) or re.search(r"(?i)dot|\[", item)
        yield m.start(), m.end(), "email", ("bias",) if plain else ("bias", "bare")


_GOES_ON = re.compile(r"[-.–－/]\s?[0-9０-９A-Z]|\s[0-9]{2}|[0-9]")
_CAME_FROM = re.compile(r"(?:[0-9０-９A-Z][-.–－/]|[0-9)]\s|[0-9+(])\Z")
_DIGITS = re.compile(f"{_DIGIT}+")
_OPENS = re.compile(r"(?<= )\(")
_GROUPED = re.compile(r"\+?\(?9{1,5}\)?(?:[ .()/–-]{1,3}9{1,8}){1,5}\Z")


def _shape(item: str) -> str:
    return "".join("9" if c.isdigit() else "A" if c.isalpha() else c for c in unicodedata.normalize("NFKC", item))


def _apart(text: str, shapes: dict[tuple[int, int], str]) -> tuple[dict, set]:
    """The segments that don't go on a longer number to their left, with where their list begins, and those that
    don't to their right. A number beside a space and another one of the same form is an item of a list, if that is
    apart itself."""
    begins, ends, left, right = {}, set(), {}, set()
    for b, e in shapes:
        s = shapes[b, e]
        start = left.get((b - 1, s)) if text[b - 1 : b] == " " else None
        if start is not None or not _CAME_FROM.search(text[max(0, b - 3) : b]):
            begins[b, e] = left[e, s] = b if start is None else start
    for b, e in reversed(shapes):
        s = shapes[b, e]
        if not _GOES_ON.match(text, e) or (text[e : e + 1] == " " and (e + 1, s) in right):
            ends.add((b, e))
            right.add((b, s))
    return begins, ends


def _form(shape: str) -> tuple[str, ...]:
    """General features of a number's form: its shape, digits, groups, separators and signs."""
    n = shape.count("9")
    groups = re.findall("[9A]+", shape)
    out = ["bias", f"s={shape}", f"n={n}", f"g={len(groups)}", "p=" + "".join(sorted({c for c in shape if c not in "9A"}))]
    if "A" in shape:
        out.append("letters")
    if _NO_PERSONAL.match(shape):
        out.append("no")
    if n < 7:
        out.append("short")
    if n > 15:
        out.append("long")
    if shape[0] == "+":
        out.append("plus")
        if 8 <= n <= 15 and "A" not in shape and (shape[1:].isdigit() or _GROUPED.match(shape)):
            out.append("intl")
    elif "A" not in shape and 7 <= n <= 15 and _GROUPED.match(shape) and len(groups) <= 6 and max(map(len, groups)) >= 2:
        out.append("grouped")
    return tuple(out)


def _number_spans(text: str) -> set[tuple[int, int]]:
    seen = set()
    for m in _NUMERIC.finditer(text):
        b, e = m.span()
        item = m.group()
        if item.count("(") != item.count(")"):
            continue
        if sum(map(str.isdigit, item)) >= 7:
            seen.add((b, e))
        if "(" in item[1:]:  # several numbers in a row, each with its own area code
            ends = [b + c.end() for c in _DIGITS.finditer(item)]
            for own in (b, *(b + c.start() for c in _OPENS.finditer(item))):
                for end in ends[bisect.bisect_right(ends, own) : bisect.bisect_right(ends, own + 24)]:
                    if text.count("(", own, end) == text.count(")", own, end) and sum(map(str.isdigit, text[own:end])) >= 7:
                        seen.add((own, end))
    for m in _CODE.finditer(text):
        if m.end() - m.start() < 6 or sum(map(str.isdigit, m.group())) < 6:
            continue
        chunks = [(m.start() + c.start(), m.start() + c.end()) for c in _CHUNK.finditer(m.group())]
        for i, (b, first) in enumerate(chunks):
            if text[b:first].isalpha() and (first - b > 3 or text[b:first].lower() in _SEED_OF):  # a word
                continue
            for begin, e in chunks[i:]:
                if text[begin:e].isalpha() and e - begin > 3:
                    break
                if e - b > 24:
                    break
                if sum(map(str.isdigit, text[b:e])) >= 6:
                    seen.add((b, e))
    return seen


def _numbers(text: str, context: _Context) -> Iterator[Segment]:
    if not _HAS_NUMBER.search(text):
        return
    shapes = {(b, e): _shape(text[b:e]) for b, e in sorted(_number_spans(text))}
    begins, well = _apart(text, shapes)
    for (b, e), shape in shapes.items():
        whole = (b, e) in begins and (b, e) in well
        start = begins.get((b, e), b)  # items of a list have what stands before the list
        features = (*_form(shape), *context.words(start, e), *context.seeds(start, e), *(() if whole else ("part",)))
        yield b, e, "id_number", features
        if "A" not in shape and (x := _EXTENSION.match(text, e)):  # a phone number includes its extension
            features = (*_form(shape), "ext", *context.words(start, x.end()), *context.seeds(start, x.end()), *(() if (b, e) in begins else ("part",)))
            e = x.end()
        yield b, e, "phone", features


def _addresses(text: str, lexicon: Lexicon, context: _Context) -> Iterator[Segment]:
    if not _HAS_DIGIT.search(text):
        return
    for number, (pattern, sign) in enumerate(_ADDRESS):
        for m in pattern.finditer(text) if sign.search(text) else ():
            item, ends = m.group(), {m.end()}
            for cut in re.finditer(r",\s|\s(?=[^\W\d_])", item):  # shorter ends: without place, or without its last word
                ends.add(m.start() + cut.start())
            for e in ends:
                own = text[m.start() : e]
                if len(own) > MOST_CHARS or not pattern.fullmatch(own):
                    continue
                elements = own.count(",")
                features = ["bias", f"form={number}", *["element"] * elements, *context.words(m.start(), e), f"next={text[e : e + 1].strip() or '_'}"]
                place = own.rpartition(",")[2].split() if elements else []
                if place and place[-1][0].isalpha():
                    features.append(f"place={' '.join(w for w in place if w[0].isalpha()).lower()}")
                if sum(w[0].isupper() for w in place) >= 2:
                    features.append("common_end" if re.split("['’-]", place[-1])[0].lower() in lexicon.common else "two")
                if e < m.end() and item[e - m.start()] == ",":
                    features.append("more")
                if (after := _LETTERS.match(text, e + 1)) and after.group().lower() in lexicon.common:
                    features.append("opens")
                yield m.start(), e, "address", tuple(features)


def _names(text: str, lexicon: Lexicon, context: _Context) -> Iterator[Segment]:
    marks = list(map(lexicon.mark, _LETTERS.findall(text)))
    if any(marks):
        titles = "title" in marks
        words = [(m.start(), m.group()) for m in _LETTERS.finditer(text)]
        near: set[int] = set()  # a name holds a word that is marked, or follows a title
        for j, mark in enumerate(marks):
            if mark:
                near.update(range(max(0, j - MOST_WORDS), min(len(words), j + 1 + MOST_WORDS * (mark == "title"))))
        for i in sorted(near):
            b, w = words[i]
            if not w[0].isupper() or (b and text[b - 1] in "'’-" and b > 1 and text[b - 2].isalpha()):
                continue
            after = i + 1  # a name goes on with a capital letter, after particles at most
            while after < len(words) and _IS_PART.fullmatch(words[after][1]):
                after += 1
            if "'" in text[b : b + len(w) + 1] or "’" in text[b : b + len(w) + 1] or (after < len(words) and words[after][1][0].isupper()):
                forms = range(len(_NAMES)) if titles else range(_ALONE)
            else:
                forms = (_ALONE,) if titles else ()
            for form in forms:
                if not (m := _NAMES[form].match(text, b)):
                    continue
                e, starts = m.end(), [b]
                if form in (2, _ALONE) and (before := _PARTICLES.search(text[max(0, b - 24) : b])):
                    starts.append(b - len(before.group()))
                for own in starts:
                    if features := _name_features(text, own, e, form, lexicon, context):
                        yield own, e, "name", features
    if lexicon.han and _HAN.search(text):
        at = 0
        while m := lexicon.han.search(text, at):
            at = m.start() + 1
            family = next(f for f in lexicon.han_family if m.group().startswith(f))
            for e in range(m.start() + len(family) + 1, m.end() + 1):
                given = text[m.start() + len(family) : e]
                shares = [lexicon.han_share.get(c, 0.0) for c in given]
                features = ["bias", "han", f"len={len(given)}", *context.words(m.start(), e)]
                features += ["given_often" if s >= 0.2 else "given_seen" if s >= 0.02 else "given_never" for s in shares]
                if _HAN_TITLE.match(text, e):
                    features.append("han_title")
                yield m.start(), e, "name", tuple(features)


def _name_features(text: str, b: int, e: int, form: int, lexicon: Lexicon, context: _Context) -> tuple[str, ...] | None:
    item = text[b:e]
    words = [w for w in _NAME_WORD.findall(item) if len(w) > 1 and not _IS_PART.fullmatch(w)]
    if not words or (0 < form < _ALONE and len(words) < 2) or words[0].lower() in _TITLES:
        return None
    titled = _TITLED.search(text[max(0, b - 12) : b]) is not None
    if form == _ALONE and not titled:
        return None
    around = context.words(b, e)
    known = any(map(lexicon.knows, words))
    levels = [lexicon.level(w) for w in words]
    if not known and not titled and min(levels) >= EVERYDAY:
        return None
    first, last = words[0], words[-1]
    family, given = (first, last) if form == 2 else (last, None if form in (0, _ALONE) else first)
    out = ["bias", f"form={form}", *around]
    if family.lower() in lexicon.family or any(m.group().lower() in lexicon.family for m in _WITH_PARTICLES.finditer(item)):
        out.append("family")
    if given and all(g.lower() in lexicon.given for g in given.split("-")):
        out.append("given")
    elif given and any(g.lower() in lexicon.given for g in given.split("-")):
        out.append("given_part")
    if _HAS_INITIAL.search(item):
        out.append("initials")
    if family.isupper():
        out.append("upper")
    out += ["common" for w in (given, family) if w and w.lower() in lexicon.common and w.lower() not in lexicon.given | lexicon.family]
    if form == 2:
        out += ["comma"] + ["comma_known"] * ("given" in out and "family" in out)
    for w in words[1:-1] if form in (3, 4) else ():
        out.append("common" if w.lower() in lexicon.common and not lexicon.knows(w) else "middle_known" if lexicon.knows(w) else "middle")
    if not known:
        out += ["unknown", *(f"freq={n}" for n in levels if n), *("common" for w in words[:1] if len(words) == 1 and w.lower() in lexicon.common)]
    if titled:
        out += ["titled"] + ["words"] * (len(words) - 1)
    if form == _ALONE and _MORE_NAME.match(text, e):
        out.append("more")
    if any(w.lower() in _STREET for w in words):
        out.append("street")
    return tuple(out)


def candidates(text: str, lexicon: Lexicon) -> list[Segment]:
    """(start, end, kind, features) of every candidate segment."""
    context = _Context(text)
    found = [*_emails(text), *_numbers(text, context), *_addresses(text, lexicon, context), *_names(text, lexicon, context)]
    return [c for c in found if c[1] - c[0] <= MOST_CHARS]


# ---------------------------------------------------------------- labels and training
#: Taken for wrong until the field holds it for likely: capitalised words and numbers of which nothing but their place
#: says that they are personal.
DOUBT = -2
LIKELY = {"name": 0.3, "phone": 0.03, "id_number": 0.03}


def _rule(c: Segment) -> int:
    """What one candidate is by rules that don't use the field."""
    kind, own = c[2], set(c[3])
    if kind == "email":
        return OPEN if "bare" in own else RIGHT
    if kind in ("phone", "id_number"):
        seeds = {f for f in own if f.startswith("seed=")}
        if "no" in own or "part" in own or seeds == {"seed=none"}:
            return WRONG
        if seeds == {f"seed={kind}"} and not (kind == "phone" and {"letters", "short", "long"} & own):
            return RIGHT
        if kind == "phone" and "intl" in own and not seeds:
            return RIGHT
        return WRONG if len(seeds) == 1 else OPEN if seeds else DOUBT
    if kind == "address":
        closed = any(f"next={c}" in own for c in ";,.。，；)\n")
        return WRONG if {"common_end", "more"} & own else RIGHT if closed or not ("two" in own or "next=_" in own) else OPEN
    if {"street", "more"} & own or ("unknown" in own and {"common", *_EVERYDAY} & own):
        return WRONG
    sure = {"given", "family"} <= own or ("titled" in own and "family" in own) or ("initials" in own and "family" in own) or ("han_title" in own and "given_never" not in own) or ("han" in own and not {"given_seen", "given_never"} & own)
    if sure and "common" not in own and "middle" not in own:
        return RIGHT
    return DOUBT if "unknown" in own and "titled" not in own else OPEN


def label(segments: list[Segment]) -> list[int]:
    """RIGHT, WRONG, DOUBT or OPEN for every candidate. Of right ones that overlap, the longest is kept, and what overlaps
    a right one is wrong."""
    marks = [_rule(c) for c in segments]
    kept: list[Segment] = []
    for i in sorted((i for i, m in enumerate(marks) if m == RIGHT), key=lambda i: (segments[i][0] - segments[i][1], segments[i][0])):
        if any(segments[i][0] < k[1] and k[0] < segments[i][1] for k in kept):
            marks[i] = WRONG
        else:
            kept.append(segments[i])
    return [WRONG if m in (OPEN, DOUBT) and any(c[0] < k[1] and k[0] < c[1] for k in kept) else m for c, m in zip(segments, marks)]


_HINTED = {"given", "family", "given_part", "comma_known", "middle_known", "titled", "han_title", "initials"}


def _blinded(segments: list[Segment]) -> list[Segment]:
    """The segments without the features that rules label by, so that the forms and words beside them are learned."""
    out = []
    for b, e, kind, own in segments:
        if kind == "name":
            own = (*(f for f in own if f not in _HINTED), "unknown")
        out.append((b, e, kind, tuple(f for f in own if not f.startswith("seed=") and f != "intl")))
    return out


def train(texts: list[str], lexicon: Lexicon, rounds: int = 3, sure: float = 0.9) -> Weights:
    """Weights by likelihood on the texts as label() labels them, each row seen twice, the second time without what
    its labels came from. After each round, open candidates that the field is sure of (marginal probability of at
    least `sure`, or at most 1 - sure) are labelled by it for the next."""
    rows = [(segments, label(segments)) for text in texts if (segments := candidates(text, lexicon))]
    weights: Weights = PRIOR
    for number in range(rounds):
        if number:
            rows = [(segments, _settled(segments, marks, weights, sure)) for segments, marks in rows]
        plain = [(segments, [OPEN if m == DOUBT else m for m in marks]) for segments, marks in rows]
        weights, _ = fit(plain + [(_blinded(segments), marks) for segments, marks in rows], PRIOR, _spread)
    return weights


def _settled(segments: list[Segment], marks: list[int], weights: Weights, sure: float) -> list[int]:
    """marks with the open ones set that the field is sure of, with and without what rules label by, and doubtful
    ones opened that it holds for likely."""
    seen = [marginals(s, weights) for s in (segments, _blinded(segments))]
    out = []
    for segment, mark, *both in zip(segments, marks, *seen):
        p = max(both)
        if mark == OPEN:
            mark = RIGHT if p >= sure else WRONG if p <= 1 - sure else OPEN
        elif mark == DOUBT:
            mark = RIGHT if p >= sure else OPEN if p >= LIKELY[segment[2]] else DOUBT
        out.append(mark)
    return out


def build_lexicon(documents: DataFrame, hints: DataFrame, share: float = 0.004) -> Lexicon:
    """Names from `hints` (token, kind; a fixed table) and statistics over all documents: words that stand in at
    least `share` of the documents (and in two), of which there can be no more than words a document / share; for Chinese characters, how much of a character's places follow a known family name (a table
    bounded by the script)."""
    rows = [r for r in hints.select("token", "kind").collect() if r.token]
    given, family = [r.token for r in rows if r.kind == "given"], [r.token for r in rows if r.kind == "family"]
    texts = documents.where("text is not null")
    words = texts.select(F.explode(F.array_distinct(F.split("text", r"[^\p{L}]++"))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    total = texts.agg(F.count("*").alias("total"))  # one row
    often = words.crossJoin(F.broadcast(total)).where((F.col("n") >= 2) & (F.col("n") >= share * F.col("total"))).select("w", (F.col("n") / F.col("total")).alias("share")).collect()
    common = [r.w for r in often if r.w.islower()]
    frequent = {r.w: min(MOST_LEVEL, int(math.log2(r.share / share)) + 1) for r in often if not r.w.islower()}
    return Lexicon(given, family, common, han_shares(texts, [f for f in family if _HAN.match(f)]), frequent)


def han_shares(texts: DataFrame, family: list[str]) -> dict[str, float]:
    """Of every Chinese character that follows one of the family names: the share of its places in the corpus that do."""
    if not family:
        return {}
    after = F.regexp_extract_all("text", F.lit(rf"(?:{'|'.join(sorted(family))})([㐀-鿿])"), F.lit(1))
    chars = lambda c, n: F.struct(c.alias("c"), F.lit(n).alias("named"))
    pieces = F.concat(F.transform(after, lambda c: chars(c, 1)), F.transform(F.split("text", ""), lambda c: chars(c, 0)))
    counts = texts.where(F.col("text").rlike("[㐀-鿿]")).select(F.inline(pieces)).where(F.col("c").rlike("[㐀-鿿]")).groupBy("c").agg(F.sum("named").alias("named"), F.sum(1 - F.col("named")).alias("n"))
    return {r.c: r.named / r.n for r in counts.collect() if r.named}


def han_families(texts: DataFrame, weights: Weights) -> list[str]:
    """Characters that stand twice or more, with one or two others, between two contexts that the field has learned to stand beside
    names; one script bounds their number."""
    signs = {side: sorted({f[3:] for f, w in weights.get("name", {}).items() if w >= SIGN and re.fullmatch(rf"{side}1=[㐀-鿿]{{2}}", f)}) for side in "ba"}
    if not signs["b"] or not signs["a"]:
        return []
    pattern = rf"(?:{'|'.join(signs['b'])})[：:]?([㐀-鿿])[㐀-鿿]{{1,2}}(?:{'|'.join(signs['a'])})"
    found = texts.where(F.col("text").rlike("[㐀-鿿]")).select(F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("c"))
    return [r.c for r in found.groupBy("c").agg(F.count("*").alias("n")).where("n >= 2").collect()]


_FOUND = "doc_id long, start_pos int, end_pos int, kind string, pii_text string"
_FOUND_ARROW = pa.schema([("doc_id", pa.int64()), ("start_pos", pa.int32()), ("end_pos", pa.int32()), ("kind", pa.string()), ("pii_text", pa.string())])
#: Long texts are read in windows so that no worker holds many features at once.
WINDOW = 20_000
#: What a candidate and its context reach beyond a window; a run of numbers is read whole, as its items are told apart from its ends.
MARGIN = MOST_CHARS + 48
_IN_RUN = re.compile(r"[0-9０-９A-Z .()/–－—+＋-]")


def spans_of(text: str, lexicon: Lexicon, weights: Weights) -> list[tuple[int, int, str]]:
    """(start, end, kind) in the whole text. Windows are read with what stands around them and end at the last
    place that no candidate spans, so that segments are chosen as if the text were read at once; one without
    such a place grows."""
    out, at, width = [], 0, WINDOW
    while at < len(text):
        end = min(len(text), at + width)
        start, stop = max(0, at - MARGIN), min(len(text), end + MARGIN)
        while start and _IN_RUN.match(text, start - 1):
            start -= 1
        while stop < len(text) and _IN_RUN.match(text, stop):
            stop += 1
        spans = [(start + b, start + e, *rest) for b, e, *rest in candidates(text[start:stop], lexicon)]
        spans = [c for c in spans if at <= c[0] < end]
        if end < len(text):
            for b, e in sorted({c[:2] for c in spans}, key=lambda c: c[1], reverse=True):
                if e <= end:
                    break
                end = min(end, b)
            if end <= at:
                width *= 2
                continue
        out += [c[:3] for _, c in decode([c for c in spans if c[1] <= end], weights)]
        at, width = end, WINDOW
    return out


def build_model(documents: DataFrame, hints: DataFrame, sample: int) -> tuple[Lexicon, Weights]:
    """The lexicon, with statistics over all documents, and weights fitted on at most `sample` rows, chosen by hash (of
    each the first WINDOW characters)."""
    lexicon = build_lexicon(documents, hints)
    rows = documents.where("text is not null").select(F.xxhash64("doc_id", "text").alias("h"), F.substring("text", 1, WINDOW).alias("text")).orderBy("h").limit(sample)
    weights = train([r.text for r in rows.collect()], lexicon)
    texts = documents.where("text is not null")
    if more := sorted(set(han_families(texts, weights)) - set(lexicon.han_family)):
        lexicon = lexicon.with_han([*lexicon.han_family, *more])
        lexicon.han_share = han_shares(texts, lexicon.han_family)
    return lexicon, weights


def _search(make: Callable[[list, list, Callable], pa.RecordBatch], lexicon: Lexicon, weights: Weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield make(batch, lambda text: spans_of(text, lexicon, weights))

    return run


def find_pii(documents: DataFrame, hints: DataFrame, sample: int = 8000) -> DataFrame:
    """(doc_id, start_pos, end_pos, kind, pii_text) of every item in documents.text, repeated ones too.

    documents: doc_id, text; hints: token, kind. Null and empty texts hold nothing. Positions are code points.
    Texts of any length are read whole. Without hints, names are found by their context only. The field is
    fitted on at most `sample` rows, see build_model(); statistics and search cover all rows.

    Scale: no shuffle but for two word counts that combine on the map side; the model (some thousand weights and
    words) is sent to the workers; documents pass in Arrow batches, each text by itself."""
    lexicon, weights = build_model(documents, hints, sample)

    def rows(batch: pa.RecordBatch, spans) -> pa.RecordBatch:
        out = [(doc, b, e, kind, text[b:e]) for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) for b, e, kind in spans(text)]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(_FOUND_ARROW.types)], schema=_FOUND_ARROW)

    return spread(documents.where("text is not null").select("doc_id", "text")).mapInArrow(_search(rows, lexicon, weights), _FOUND)


def redact(documents: DataFrame, hints: DataFrame, sample: int = 8000) -> DataFrame:
    """(doc_id, text): every item of find_pii() replaced by [EMAIL], [PHONE], [ID_NUMBER], [ADDRESS] or [NAME],
    the rest unchanged; null texts stay null."""
    lexicon, weights = build_model(documents, hints, sample)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def clean(batch: pa.RecordBatch, spans) -> pa.RecordBatch:
        out = []
        for text in batch.column("text").to_pylist():
            for b, e, kind in reversed(spans(text)) if text else ():
                text = f"{text[:b]}[{kind.upper()}]{text[e:]}"
            out.append(text)
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(out, pa.string())], schema=schema)

    return spread(documents.select("doc_id", "text")).mapInArrow(_search(clean, lexicon, weights), "doc_id long, text string")
