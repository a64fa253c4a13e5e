"""Personal information inside free text, by a skip-chain conditional random field."""

from __future__ import annotations

import functools
import re
import unicodedata
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.keys import opened, sealed
from corpusmill.functions.spread import spread
from corpusmill.scratch import durable

#: Documents, about, that are fitted at a time; the fits of all are averaged.
FIT_DOCUMENTS = 3_000
#: Documents in which the least counts of names and ordinary words are met; among more they are met in the same share.
COUNTED_IN = 3_000
#: Counts after which a task hands on what it has; counts are summed, so this bounds memory alone.
_COUNTS = 300_000
#: Share of capitalised rare words that fitting replaces by words made up of halves of others, so that names never met are known by their context.
UNSEEN = 0.3
LABELS = ("O", "email", "phone", "id_number", "B-address", "I-address", "B-person", "I-person")
O, EMAIL, PHONE, ID, B_ADR, I_ADR, B_PER, I_PER = range(8)
TYPES = {EMAIL: "email", PHONE: "phone", ID: "id_number", B_ADR: "street_address", I_ADR: "street_address", B_PER: "person_name", I_PER: "person_name"}
#: Label groups whose agreement the skip edges reward: other, number-like, address, person.
_GROUP = np.array([0, 1, 1, 1, 2, 2, 3, 3])
_CELLS = 1 << 16
_OFFSETS = (-3, -2, -1, 1, 2, 3)

# --- tokens ------------------------------------------------------------------------------

_AT = r"(?:[  ]?[@＠﹫][  ]?|[  ]?[\[({<][  ]?(?:at|AT|@)[  ]?[\])}>][  ]?)"
_DOT = r"(?:[.．]|[  ]?[\[({<][  ]?(?:dot|DOT|\.)[  ]?[\])}>][  ]?)"
_WORD_DOT = r"(?:[.．]|[  ](?:dot|DOT)[  ])"
_EMAIL = (
    rf"[\w+-]{{1,64}}(?:{_DOT}[\w+-]{{1,64}}){{0,9}}{_AT}[\w-]{{1,64}}(?:{_DOT}[\w-]{{1,64}}){{0,9}}{_DOT}[A-Za-z]{{2,24}}(?![\w@])"
    rf"|[\w+-]{{1,64}}(?:{_WORD_DOT}[\w+-]{{1,64}}){{0,9}}[  ](?:at|AT)[  ][\w-]{{1,64}}(?:[  ](?:dot|DOT)[  ][\w-]{{1,64}}){{1,9}}(?![\w@])"
)
_SEP = "[     .\\-‐‑‒–/]"
_NUMBER = rf"(?:\+[  ]?)?\(?\d+\)?(?:(?:{_SEP}\(?|\)?{_SEP}?|\s?\(|\)\s?|\s?/\s?|\s?-\s?)\d+\)?)*(?:-[A-Za-z]\b)?"
_CODE = r"\b[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]\b|\b(?=[A-Z\d/-]{0,40}\d)(?=[\d/-]{0,40}[A-Z])[A-Z\d]{1,40}(?:[-/][A-Z\d]{1,40}){0,9}\b"
TOKEN = re.compile(rf"(?P<email>{_EMAIL})|(?P<code>{_CODE})|(?P<number>{_NUMBER})|(?P<word>[A-ZÀ-ÖØ-Þ]\.(?=[   -]?[^\W\d_])|[^\W\d_]+(?:_|\d|[^\W\d_])*)|(?P<other>\n+|[^\w\s]|\w)")
#: Without the notations of e-mail addresses, for text that shows no sign of one.
_PLAIN_TOKEN = re.compile(rf"(?P<code>{_CODE})|(?P<number>{_NUMBER})|(?P<word>[A-ZÀ-ÖØ-Þ]\.(?=[   -]?[^\W\d_])|[^\W\d_]+(?:_|\d|[^\W\d_])*)|(?P<other>\n+|[^\w\s]|\w)")
_EMAIL_SIGN = re.compile(r"[@＠﹫]|[\[({<]\s?(?:at|AT)|\s(?:dot|DOT)\s")

# Words that show what follows or precedes.
FORMS = frozenset("mr mrs ms miss mx dr prof professor herr herrn frau madame monsieur mme mlle sr sra srta señor señora senhor senhora sig signor signora signore dott dottor dottoressa sir lady ing".split())
PARTICLES = frozenset("van von der den de da di del della do dos du la le al el bin ben ter ten zu".split())
STREET_WORDS = frozenset(
    "street st road rd avenue ave lane ln drive dr way terrace crescent close court place square boulevard blvd row walk hill gardens grove mews parade quay "
    "rue chemin allée impasse via viale piazza corso vicolo calle avenida paseo plaza rua largo travessa sector".split()
)
UNIT_WORDS = frozenset("flat apt apartment unit suite plot house shop room floor".split())
PHONE_WORDS = frozenset("tel telephone telefon phone fon fax dial call mobile mobil handy callback téléphone teléfono telefone telefono reach".split())
ID_WORDS = frozenset(
    "ssn social security nino ni insurance national aadhaar aadhar uidai uid dni nif nie identity id card ausweis personalausweis reisepass passport passeport pasaporte passaporte pan tax steuer "
    "codice fiscale sozialversicherungsnummer carte identité".split()
)
_ID_STRONG = frozenset("ssn nino aadhaar aadhar uidai uid dni nif nie reisepass passport passeport pasaporte passaporte pan personalausweis ausweis".split())
CODE_WORDS = frozenset("ticket batch invoice certificate reference version clause annex order number offer lane room".split())
FIRMS = frozenset("gmbh ag llp ltd inc pvt group plc kg limited corp sa sarl srl bv foods textiles energy steel systems logistics cloud pharma robotics dairy hotels".split())
INTRODUCERS = frozenset("participant contact interviewed by to with call reach for name dear lieber liebe chère cher estimada estimado best regards grüßen".split())


def number_shape(text: str) -> str:
    """Group lengths with the separators between them, so that a notation is one feature."""
    flat = re.sub("[    ]", " ", re.sub("[‐-–]", "-", text))
    return re.sub(r"\d+", lambda m: str(len(m[0])), re.sub(r"\s+", " ", flat))


def digits_of(text: str) -> str:
    return re.sub(r"\D", "", text)


def _class(kind: str, text: str, low: str) -> str:
    if kind == "email":
        return "EM"
    if kind == "number":
        n = len(digits_of(text))
        lead = "+" if text[0] == "+" else "(" if text[0] == "(" else "00" if text.startswith("00") else "0" if text[0] == "0" else ""
        return f"N{min(n, 13)}{lead}" + ("g" if not text.isdigit() else "")
    if kind == "code":
        return "C" + re.sub(r"[A-Z]+", "A", re.sub(r"\d+", "9", text))[:8]
    if kind == "other":
        return "NL" if text[0] == "\n" else text
    for name, words in (("FORM", FORMS), ("PART", PARTICLES), ("STREET", STREET_WORDS), ("UNIT", UNIT_WORDS), ("PHONEW", PHONE_WORDS), ("IDW", ID_WORDS), ("CODEW", CODE_WORDS), ("FIRM", FIRMS), ("INTRO", INTRODUCERS)):
        if low in words:
            return name + ("c" if text[0].isupper() else "")
    if text[-1] == ".":
        return "INIT."
    if len(text) == 1:
        return "INIT" if text.isupper() else "w1"
    if text.isupper():
        return "UP"
    if text[0].isupper():
        return "Cap"
    return "low"


@dataclass(frozen=True)
class Gazetteer:
    """Given and family names met after forms of address and introducing words."""

    given: frozenset[str]
    family: frozenset[str]
    endings: frozenset[str]

    def is_family(self, text: str) -> bool:
        return text.casefold() in self.family or (len(text) > 5 and text[0].isupper() and self.ends_as_one(text))

    def ends_as_one(self, text: str) -> bool:
        return text.casefold()[-4:] in self.endings


@dataclass
class Vocabulary:
    """Distinct token spellings with their features; numbers count by their notation."""

    names: Gazetteer = Gazetteer(frozenset(), frozenset(), frozenset())
    ids: dict[tuple[str, str], int] = field(default_factory=dict)
    own: list[list[int]] = field(default_factory=list)
    near: list[list[int]] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    classes: dict[str, int] = field(default_factory=dict)

    def add(self, kind: str, text: str) -> int:
        # all that features depend on must be in the key
        zeros = "00" if text.startswith("00") else "0" if text[0] == "0" else ""
        key = (kind, number_shape(text) + zeros if kind == "number" else "@" if kind == "email" else text)
        at = self.ids.get(key)
        if at is None:
            at = self.ids[key] = len(self.own)
            low = text.casefold()
            name = _class(kind, text, low)
            if name in ("Cap", "UP", "low"):
                name += "G" if low in self.names.given else "F" if low in self.names.family or self.names.ends_as_one(text) else ""
            if kind in ("number", "email"):
                word, affixes = key[1], [f"d{len(digits_of(text)) if kind == 'number' else 0}"]
            elif kind == "code":
                word, affixes = re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", text)), []
            else:
                plain = "".join(c for c in unicodedata.normalize("NFD", low) if not unicodedata.combining(c))
                word = low
                affixes = [f"p3{plain[:3]}", f"p4{plain[:4]}", f"s2{plain[-2:]}", f"s3{plain[-3:]}", f"s4{plain[-4:]}", f"s3c{plain[-3:]}{name}", f"n{min(len(low), 8)}{name}"] if len(low) > 2 else []
            self.own.append([_cell(x) for x in ("w" + word, "c" + name, "wc" + word + name, *affixes)])
            self.near.append([_cell(x) for x in ("w" + word, "c" + name)])
            self.kinds.append(self.classes.setdefault(name, zlib.crc32(name.encode()) % 4093))
        return at


def _cell(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) % _CELLS


_OPENED_AT = tuple(f"{bracket}{blank}at" for bracket in "[({<" for blank in ("", " ", "\u00a0", "\u202f", "\t", "\n"))


def _may_mail(low: str) -> bool:
    """Whether a lower-case text can show the sign of an e-mail address; a quick no for most."""
    return "@" in low or "dot" in low or "＠" in low or "﹫" in low or any(mark in low for mark in _OPENED_AT)


def tokenize(text: str) -> tuple[list[str], list[str], list[int]]:
    """Kinds, texts and starts of a text's tokens."""
    found = list((TOKEN if _EMAIL_SIGN.search(text) else _PLAIN_TOKEN).finditer(text))
    return [m.lastgroup for m in found], [m[0] for m in found], [m.start() for m in found]


# --- labels for fitting ------------------------------------------------------------------

_STREET_TYPE = r"(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Way|Terrace|Crescent|Close|Court|Place|Square|Boulevard|Blvd|Row|Walk|Hill|Gardens|Grove|Mews|Parade|Quay)\b\.?"
_CITY = r"(?:,?[ ]?(?:Apt|Flat|Unit|Suite)\.?\s?\w{1,4})?(?:(?:,\s*|\n)(?:\d{5}\s)?[A-ZÀ-Þ]\w+(?:\s[A-ZÀ-Þ]\w+)?(?:(?:,?\s)(?:ZX\s?)?\d{5,6}\b)?)?"
_ADDRESSES = [
    re.compile(rf"\bPlot\s\d+\s?[a-zA-Z]?(?:,\s*(?:Sector|Phase|Block)\s\w+)?,\s*[A-ZÀ-Þ][\w'’-]+(?:\s[A-ZÀ-Þ][\w'’-]+){{0,3}}{_CITY}"),
    re.compile(rf"(?<![\w.,/@-])(?:(?:Flat|Apt|Apartment|Unit|Suite|Shop|House|Room)\.?\s?\w{{1,5}},\s*)?\d{{1,4}}\s?[a-zA-Z]?,?\s(?:(?:North|South|East|West|N|S|E|W)\.?\s)?[A-ZÀ-Þ][\w'’-]+(?:\s[A-ZÀ-Þ][\w'’-]+){{0,2}}\s{_STREET_TYPE}{_CITY}"),
    re.compile(rf"(?<![\w.,/-])\d{{1,4}}(?:\s?(?:bis|ter|[a-zA-Z])\b)?,?\s(?:rue|avenue|boulevard|place|chemin|allée|impasse|quai|cours)\s(?:de\sla\s|de\sl['’]|du\s|des\s|de\s|d['’])?[A-ZÀ-Þ][\w'’-]+(?:[\s-][A-ZÀ-Þ][\w'’-]+){{0,2}}{_CITY}"),
    re.compile(rf"\b(?:C/|(?:Avda|Av|Pza|R)\.|Via|Viale|Piazza|Corso|Vicolo|Calle|Avenida|Paseo|Plaza|Rua|Largo|Travessa)\s(?:[a-zà-ÿ]+['’]?\s?){{0,2}}[A-ZÀ-Þ][\w'’]+(?:\s(?:de\s|del\s|da\s|do\s|dos\s)?[A-ZÀ-Þ][\w'’]+){{0,2}},?\s(?:n\.?º?\s)?\d{{1,4}}\s?[a-zA-Z]?\b{_CITY}"),
    re.compile(rf"\b[A-ZÄÖÜ][\wäöüß-]*(?:straße|strasse|str\.|weg|gasse|allee|platz|ring|damm|ufer)\s\d{{1,4}}\s?[a-zA-Z]?\b{_CITY}"),
    re.compile(rf"\b(?:Am|An\sder|Auf\sder|Im|Zum|Zur|Unter\sden)\s[A-ZÄÖÜ][\wäöüß-]+(?:\s[A-ZÄÖÜ][\wäöüß-]+)?\s\d{{1,4}}\s?[a-zA-Z]?,\s\d{{5}}{_CITY}"),
]
_PHONE_SHAPES = re.compile(r"\+|00\s?[1-9]|\(\d{2,5}\)")


_DATE = re.compile(r"\d{1,2}[./-]\d{1,2}[./-]\d{4}|\d{4}-\d{2}-\d{2}.*")


def looks_like_phone(text: str, told: bool) -> bool:
    """A telephone notation; ``told``: a word for it stands just before."""
    n, shape = len(digits_of(text)), number_shape(text)
    if not 7 <= n <= 15 or shape.endswith(("-A", "-a")) or re.fullmatch(r"4[ -]4[ -]4|3-2-4", shape):
        return False
    if _DATE.fullmatch(text):
        return False
    if told or _PHONE_SHAPES.match(text) and n >= 9:
        return True
    return n >= 9 and text[0] == "0" and len(shape) > 1 or bool(re.fullmatch(r"3([-. ])3\1(?:4|2\1?2)|3[-. ]\d?3[-. ]4", shape))


def looks_like_id(kind: str, text: str, told: bool) -> bool:
    """An identity, tax, insurance or passport number's notation, or any number but a date after a word for one."""
    if _DATE.fullmatch(text):
        return False
    solid = re.sub(r"\W", "", text)
    if re.fullmatch(r"[A-Z]{2}\d{6}[A-D]|[A-Z]{5}\d{4}[A-Z]|\d{8}[A-Z]|[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z]", solid) or number_shape(text) == "3-2-4":
        return True
    return told and 6 <= len(solid) <= 18 and sum(c.isdigit() for c in solid) >= 5


def _told(words: list[str], at: int, named: frozenset[str], reach: int) -> bool:
    for j in range(at - 1, max(-1, at - 1 - reach), -1):
        if words[j] in named:
            return True
        if words[j][:1] in "\n;|" or words[j] in (",",):
            return False
    return False


_PAIR = re.compile(
    r"(?:(\S{1,24})\s|(\b\w{1,20}[=:]))(?!(?:Mr|Ms|Mrs|Dr|Prof|Herr|Frau|Sra?|Mme|Madame|Monsieur)\b)"
    r"([A-ZÀ-Þ][a-zà-ÿ]+)\s(?:[A-ZÀ-Þ]\.\s)?([A-ZÀ-Þ][a-zà-ÿ]{3,})\b"
)


def name_pairs(text: str) -> list[tuple[str, str, str]]:
    """What stands before each pair of capitalised words, and the two."""
    return [((m[1] or m[2]).strip("(.*").casefold(), m[3].casefold(), m[4].casefold()) for m in _PAIR.finditer(text)]


def lower_words(text: str) -> list[str]:
    return re.findall(r"(?<![.\w@_+-])[a-z][a-zà-ÿ]{3,}(?![\w@_.+-]\w)", text)


def settle_names(counted: Callable[..., dict[str, int]], common: set[str], per: float) -> Gazetteer:
    """Names behind forms of address, and behind what else stands mostly before given names met there.

    ``counted(column, least, contexts, givens)`` counts the pairs by one of context, given and family; ``per`` is how many times
    ``COUNTED_IN`` documents there are.
    """
    known = {w for w in counted("given", 2 * per, FORMS) if w not in common}
    names = counted("context", 5 * per, None, known) if known else {}
    met = counted("context", 5 * per, set(names)) if names else {}
    introducing = FORMS | {context for context, n in names.items() if n >= 0.6 * met[context]}
    common = common | FORMS | PARTICLES | INTRODUCERS
    given = {w for w in counted("given", 2 * per, introducing) if w not in common}
    # a family name behind a given one may be rare
    family = set(counted("family", per, introducing)) | set(counted("family", 1, introducing, given) if given else ())
    family = {w for w in family if w not in common and w not in given}
    ends = Counter(w[-4:] for w in family)
    return Gazetteer(frozenset(given), frozenset(family), frozenset(e for e, n in ends.items() if n >= 4 and len(e) == 4))


def gather_names(texts: list[str]) -> Gazetteer:
    """The names of a list of texts, see ``settle_names``."""
    per = max(1.0, len(texts) / COUNTED_IN)
    lower = Counter(word for text in texts for word in lower_words(text))
    pairs = Counter(pair for text in texts for pair in name_pairs(text))

    def counted(column: str, least: float, contexts: Iterable[str] | None = None, givens: Iterable[str] | None = None) -> dict[str, int]:
        found: Counter[str] = Counter()
        for pair, n in pairs.items():
            if (contexts is None or pair[0] in contexts) and (givens is None or pair[1] in givens):
                found[pair[("context", "given", "family").index(column)]] += n
        return {w: n for w, n in found.items() if n >= least}

    return settle_names(counted, {w for w, n in lower.items() if n >= 12 * per}, per)


def _name_end(kinds: list[str], texts: list[str], at: int, names: Gazetteer, formal: bool) -> int:
    """The token behind a name that starts at ``at``; ``at`` itself where there is none."""
    i, n, words, given_first = at, len(texts), 0, False
    while i < n and i - at < 14:
        t = texts[i]
        low = t.casefold()
        if kinds[i] == "word":
            known = low in names.given or low in names.family or names.is_family(t) or (given_first and words == 1 and names.ends_as_one(t))
            if low in FIRMS and words:
                break
            if known or (formal and words == 0 and t[0].isupper() and low not in PARTICLES) or (words and t[0].isupper() and len(t) > 1 and names.is_family(t)):
                given_first |= words == 0 and low in names.given
                words, i = words + 1, i + 1
                continue
            if t[-1] == "." and i + 1 < n and kinds[i + 1] == "word":
                i += 1
                continue
            if low in PARTICLES and i + 2 < n and texts[i + 1] in "-‐‑'’" and names.is_family(texts[i + 2]):
                i += 2
                continue
            if low in PARTICLES and i + 1 < n and kinds[i + 1] == "word" and (words or formal or i + 2 < n) and (names.is_family(texts[i + 1]) or texts[i + 1].casefold() in PARTICLES):
                i += 1
                continue
        elif t in "-‐‑'’" and words and i + 1 < n and kinds[i + 1] == "word" and names.is_family(texts[i + 1]) and texts[i + 1].casefold() != "s":
            i += 1
            continue
        elif t == "," and words and not given_first and i + 1 < n and (texts[i + 1].casefold() in names.given) and not (i + 2 < n and names.is_family(texts[i + 2])):
            i += 1
            continue
        break
    return i if words else at


def weak_labels(text: str, names: Gazetteer) -> tuple[list[str], list[str], list[int], list[int]]:
    """Tokens and the labels that notations, label words and names give; the model is fitted on these."""
    kinds, texts, starts = tokenize(text)
    low = [t.casefold() for t in texts]
    # a document is one of identity only by the word before it
    low = ["passport" if w == "document" and i and low[i - 1] in ("travel", "identity", "id") else w for i, w in enumerate(low)]
    labels = [O] * len(texts)
    for pattern in _ADDRESSES:
        for m in pattern.finditer(text):
            a, b = int(np.searchsorted(starts, m.start())), int(np.searchsorted(starts, m.end()))
            if a < b and not any(labels[a:b]):
                labels[a:b] = [B_ADR] + [I_ADR] * (b - a - 1)
    for i, kind in enumerate(kinds):
        if labels[i]:
            continue
        if kind == "email":
            labels[i] = EMAIL
        elif kind in ("number", "code"):
            if any(w in CODE_WORDS for w in low[max(0, i - 2) : i]) and not _told(low, i, _ID_STRONG, 4):
                if not (low[i - 1] in ("no", "number", ".", ":") and _told(low, i, ID_WORDS, 5)):
                    continue
            if looks_like_id(kind, texts[i], _told(low, i, ID_WORDS, 5)):
                labels[i] = ID
            elif kind == "number" and looks_like_phone(texts[i], _told(low, i, PHONE_WORDS, 4)):
                labels[i] = PHONE
    i = 0
    while i < len(texts):
        if labels[i] or kinds[i] != "word":
            i += 1
            continue
        start, formal = i, False
        while start < len(texts) and low[start] in FORMS and (texts[start][0].isupper() or formal):
            formal = True
            start += 1
            while start < len(texts) and texts[start] == ".":
                start += 1
        if start >= len(texts):
            break
        t = texts[start]
        opens = formal or low[start] in names.given or (names.is_family(t) and start + 2 < len(texts) and texts[start + 1] == "," and low[start + 2] in names.given) or (
            t[-1] == "." and start + 1 < len(texts) and (names.is_family(texts[start + 1]) or low[start + 1] in PARTICLES or texts[start + 1][-1] == ".")
        )
        # a hyphenated family name before a comma and a given name
        if not opens and names.is_family(t):
            j = start + 1
            while j + 1 < len(texts) and texts[j] in "-‐‑" and kinds[j + 1] == "word":
                j += 2
            opens = j + 1 < len(texts) and texts[j] == "," and low[j + 1] in names.given
        end = _name_end(kinds, texts, start, names, formal) if opens else start
        alone = not formal and end - start == 1 and low[start] in names.given
        if end > start and not any(labels[start:end]) and not alone:
            labels[start:end] = [B_PER] + [I_PER] * (end - start - 1)
            i = end
        else:
            i += 1
    return kinds, texts, starts, labels


# --- the model ---------------------------------------------------------------------------


@dataclass
class SkipChain:
    """Weights of the field: own and neighbouring token features, class triples, label steps and, per kind of skip edge, label pairs; the names that classes tell apart.

    ``ordinary`` are the words that, by the fitting documents, no item consists of alone.
    """

    own: np.ndarray
    near: np.ndarray
    triples: np.ndarray
    steps: np.ndarray
    skips: np.ndarray
    ordinary: frozenset[str] = frozenset()
    names: Gazetteer = Gazetteer(frozenset(), frozenset(), frozenset())


#: Ends of the pieces that are looked at by themselves for what an item cannot be without, and blanks at which context is cut.
_PIECE = re.compile(r"[.!?]\s+|\n+")
_WORDS = re.compile(r"[^\W\d_]{2,}")
_DIGIT, _DIGITS = re.compile(r"\d"), re.compile(r"\d(?:[^\d\n]{0,3}\d){4}")
_STREETS = STREET_WORDS | UNIT_WORDS
#: Characters of context on either side of a live piece.
_CONTEXT = 48


@functools.lru_cache(maxsize=4)
def _as_written(ordinary: frozenset[str]) -> frozenset[str]:
    """Ordinary words alone and before a mark, those of streets left out."""
    return frozenset(word + mark for word in ordinary - _STREETS if len(word) > 1 for mark in ("", ",", ".", ";", ":", "!", "?"))


def _whole(low: str, word: str) -> list[int]:
    """Where a word stands by itself."""
    found, at = [], low.find(word)
    while at >= 0:
        end = at + len(word)
        if not ((at and low[at - 1].isalpha()) or (end < len(low) and low[end].isalpha())):
            found.append(at)
        at = low.find(word, end)
    return found


def live_stretches(text: str, ordinary: frozenset[str]) -> list[tuple[int, int]]:
    """(start, end) of what can hold an item, with its context.

    An item has a word outside ``ordinary``, five digits, a number and a word for streets or units, or the sign of an e-mail address;
    the label of every other token is O by the field's definition.
    """
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c if len(f := c.lower()) != 1 else f for c in text)
    # words as they stand between blanks first; only what is left is taken apart
    words = {word for part in set(low.split()) - _as_written(ordinary) for word in _WORDS.findall(part)}
    marks = [at for word in words - ordinary for at in _whole(low, word)]
    streets: list[int] = []
    if _DIGIT.search(text):
        marks += [m.start() for m in _DIGITS.finditer(text)]
        streets = [at for word in words & _STREETS for at in _whole(low, word)]
    if _may_mail(low):
        marks += [m.start() for m in _EMAIL_SIGN.finditer(text)]
    if not marks and not streets:
        return []
    ends = [m.end() for m in _PIECE.finditer(text)] + [len(text)]
    live = {bisect_right(ends, at) for at in marks}
    live |= {n for n in {bisect_right(ends, at) for at in streets} - live if _DIGIT.search(text, ends[n - 1] if n else 0, ends[n])}
    spans: list[list[int]] = []
    for n in sorted(live):
        if n >= len(ends):
            continue
        a, b = max(0, (ends[n - 1] if n else 0) - _CONTEXT), min(len(text), ends[n] + _CONTEXT)
        if spans and a <= spans[-1][1]:
            spans[-1][1] = b
        else:
            spans.append([a, b])
    for span in spans:
        # not inside a word
        while 0 < span[0] and not text[span[0] - 1].isspace() and span[0] > 0:
            span[0] -= 1
        while span[1] < len(text) and not text[span[1]].isspace():
            span[1] += 1
    merged: list[list[int]] = []
    for span in spans:
        if merged and span[0] <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], span[1])
        else:
            merged.append(span)
    return [(a, b) for a, b in merged]


class Scorer:
    """Emission scores of token sequences, the sums per spelling kept while they are few."""

    def __init__(self, model: SkipChain, most: int = 400_000):
        self.model, self.most = model, most
        self._clear()

    def _clear(self) -> None:
        self.words = Vocabulary(self.model.names)
        self.met: dict[tuple[str, str], int] = {}
        self.own = np.zeros((0, len(LABELS)), np.float32)
        self.near = np.zeros((0, len(_OFFSETS), len(LABELS)), np.float32)

    def tokens(self, kinds: list[str], texts: list[str]) -> np.ndarray:
        if len(self.met) > self.most:
            self._clear()
        get, add, met = self.met.get, self.words.add, self.met
        places = list(zip(kinds, texts, strict=True))
        found = [get(place) for place in places]
        for i, known in enumerate(found):
            if known is None:
                found[i] = met[places[i]] = add(*places[i])
        return np.array(found, dtype=np.int64)

    def scores(self, ids: np.ndarray, sequence: np.ndarray | None = None) -> np.ndarray:
        """Scores of the tokens of one or, told apart by ``sequence``, several sequences that follow each other."""
        have, all_ = len(self.own), len(self.words.own)
        if all_ > have:
            own = np.stack([self.model.own[f].sum(0) for f in self.words.own[have:]])
            near = np.stack([self.model.near[:, f].sum(1) for f in self.words.near[have:]])
            self.own, self.near = np.concatenate([self.own, own]), np.concatenate([self.near, near])
        if sequence is None:
            sequence = np.zeros(len(ids), np.int64)
        out = self.own[ids].copy()
        for k, offset in enumerate(_OFFSETS):
            to, by = (slice(-offset, None), slice(None, offset)) if offset < 0 else (slice(None, -offset), slice(offset, None))
            if len(ids) > abs(offset):
                out[to] += self.near[ids[by], k] * (sequence[to] == sequence[by])[:, None]
        out += self.model.triples[triples_of(np.asarray(self.words.kinds, dtype=np.int64)[ids], sequence)].sum(1)
        return out


def triples_of(kinds: np.ndarray, sequence: np.ndarray | None = None) -> np.ndarray:
    """Cells of each token's class with both neighbours, the one before and the one behind."""
    before = np.r_[4093, kinds[:-1]] if len(kinds) else kinds
    after = np.r_[kinds[1:], 4094] if len(kinds) else kinds
    if sequence is not None and len(kinds):
        new = np.flatnonzero(sequence[1:] != sequence[:-1])
        before[new + 1], after[new] = 4093, 4094
    whole = (before * 4099 + kinds) * 4111 + after
    left, right = (before * 4099 + kinds) * 4111 + 4100, (4101 * 4099 + kinds) * 4111 + after
    return np.stack([(x * 2654435761 % (1 << 32)) % _CELLS for x in (whole, left, right)], axis=1)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def marginals(emission: np.ndarray, length: np.ndarray, steps: np.ndarray, with_pairs: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Node marginals (chain, place, label) and, if wanted, expected label steps, by forward-backward sums over padded chains.

    The sums run over weights scaled to one at every place, so that each step is a small matrix product.
    """
    n, places, labels = emission.shape
    weight = np.exp(np.maximum(emission - emission.max(2, keepdims=True), -60.0))
    move = np.exp(steps)
    forward, backward = np.empty_like(weight), np.ones_like(weight)
    here = weight[:, 0]
    forward[:, 0] = here / here.sum(1, keepdims=True)
    for t in range(1, places):
        here = (forward[:, t - 1] @ move) * weight[:, t]
        forward[:, t] = here / here.sum(1, keepdims=True)
    for t in range(places - 2, -1, -1):
        here = (weight[:, t + 1] * backward[:, t + 1]) @ move.T
        backward[:, t] = np.where((t + 1 < length)[:, None], here / here.max(1, keepdims=True), 1.0)
    nodes = forward * backward
    nodes /= nodes.sum(2, keepdims=True)
    nodes[np.arange(places)[None, :] >= length[:, None]] = 0
    pairs = np.zeros((labels, labels))
    for t in range(1, places if with_pairs else 0):
        live = t < length
        if live.any():
            after = weight[live, t] * backward[live, t]
            scale = ((forward[live, t - 1] @ move) * after).sum(1, keepdims=True)
            pairs += move * (forward[live, t - 1].T @ (after / scale))
    return nodes, pairs


def _step_limits() -> np.ndarray:
    """Steps that cannot be: an inner label behind anything but its own kind."""
    steps = np.zeros((len(LABELS), len(LABELS)), np.float32)
    for inner, first in ((I_ADR, B_ADR), (I_PER, B_PER)):
        steps[[x for x in range(len(LABELS)) if x not in (inner, first)], inner] = -30
    return steps


#: A document for fitting: its live stretches and the kinds, texts, starts and labels of the tokens in them.
Document = tuple[list[tuple[int, int]], list[str], list[str], list[int], list[int]]


@dataclass
class SkipCounts:
    """Labels at the ends of skip edges, by kind, and of the words that could have one."""

    agree: np.ndarray = field(default_factory=lambda: np.zeros((3, 4, 4)))
    eligible: np.ndarray = field(default_factory=lambda: np.zeros(4))
    mailed: np.ndarray = field(default_factory=lambda: np.zeros(4))


def fit_model(texts: list[str], seed: int = 11, passes: int = 4) -> SkipChain:
    """The model of a list of texts, fitted at a time."""
    names = gather_names(texts)
    labelled = [weak_labels(text, names) for text in texts]
    ordinary = _ordinary_words(labelled)
    documents = [(live_stretches(text, ordinary), *own) for text, own in zip(texts, labelled, strict=True)]
    model, counts = fit_part(documents, names, ordinary, seed, passes)
    return with_skips(model, counts)


def fit_part(documents: Iterable[Document], names: Gazetteer, ordinary: frozenset[str], seed: int = 11, passes: int = 4) -> tuple[SkipChain, SkipCounts]:
    """Fit the chain by its likelihood over weakly labelled lines, and count the labels that skip edges join.

    Lines without any label are thinned to a third in fitting; nothing is thinned in use.
    """
    rng = np.random.default_rng(seed)
    words = Vocabulary(names)
    halves = sorted({w for w in ordinary if len(w) > 5}) or ["unknown"]

    def strange() -> int:
        a, b = (halves[int(i)] for i in rng.integers(0, len(halves), 2))
        return words.add("word", (a[: len(a) // 2] + b[len(b) // 2 :]).capitalize())

    chains: list[tuple[np.ndarray, np.ndarray]] = []
    counts = SkipCounts()
    for spans, kinds, tokens, starts, labels in documents:
        y = np.array(labels, dtype=np.int64)
        for kind, a, b in skip_links(kinds, tokens, ordinary, names):
            if kind == MAIL:
                counts.mailed[_GROUP[y[a]]] += 1
            else:
                counts.agree[kind][_GROUP[y[a]], _GROUP[y[b]]] += 1
        for start, stop in spans:
            at, last = bisect_left(starts, start), bisect_left(starts, stop)
            counts.eligible += np.bincount(_GROUP[[y[i] for i in range(at, last) if kinds[i] == "word" and len(tokens[i]) > 2]], minlength=4)
            while at < last:
                end = min(last, at + 60)
                while end < last and y[end] and end - at < 90:
                    end += 1
                if y[at:end].any() or rng.random() < 0.34:
                    ids = np.fromiter((words.add(k, t) for k, t in zip(kinds[at:end], tokens[at:end], strict=True)), np.int64, end - at)
                    proper = np.array([k == "word" and t[1:].islower() and t[0].isupper() and t.lower() not in ordinary for k, t in zip(kinds[at:end], tokens[at:end], strict=True)])
                    unseen = proper & (rng.random(end - at) < UNSEEN)
                    ids[unseen] = [strange() for _ in range(int(unseen.sum()))]
                    chains.append((ids, y[at:end]))
                at = end
    model = SkipChain(
        np.zeros((_CELLS, len(LABELS)), np.float32),
        np.zeros((len(_OFFSETS), _CELLS, len(LABELS)), np.float32),
        np.zeros((_CELLS, len(LABELS)), np.float32),
        _step_limits(),
        np.zeros((3, len(LABELS), len(LABELS)), np.float32),
        ordinary,
        names,
    )
    if not chains:
        return model, counts
    kinds = np.asarray(words.kinds, dtype=np.int64)
    own_width = max(map(len, words.own))
    own = np.full((len(words.own), own_width), -1, dtype=np.int64)
    for i, cells in enumerate(words.own):
        own[i, : len(cells)] = cells
    near = np.array(words.near, dtype=np.int64)
    squares = [np.full(w.shape, 1e-2, np.float32) for w in (model.own, model.near, model.triples)]
    step_squares = np.full(model.steps.shape, 1e-2)
    limits = _step_limits()
    order = sorted(range(len(chains)), key=lambda i: len(chains[i][0]))
    batches = [order[i : i + 256] for i in range(0, len(order), 256)]

    def update(weights: np.ndarray, square: np.ndarray, cells: np.ndarray, grad: np.ndarray) -> None:
        """One AdaGrad step on the touched rows; cells repeat."""
        unique, place = np.unique(cells, return_inverse=True)
        total = np.stack([np.bincount(place, grad[:, k], len(unique)) for k in range(grad.shape[1])], axis=1).astype(np.float32)
        total -= 2e-3 * weights[unique]
        square[unique] += total * total
        weights[unique] += 0.3 * total / np.sqrt(square[unique])

    for _ in range(passes):
        for b in rng.permutation(len(batches)):
            batch = [chains[i] for i in batches[b]]
            length = np.array([len(c) for c, _ in batch])
            flat = np.concatenate([c for c, _ in batch])
            gold = np.concatenate([y for _, y in batch])
            place = np.concatenate([np.arange(n) for n in length])
            chain = np.repeat(np.arange(len(batch)), length)
            feats = own[flat]
            score = np.where((feats >= 0)[..., None], model.own[feats], 0).sum(1)
            shifted = []
            for k, offset in enumerate(_OFFSETS):
                ok = (place + offset >= 0) & (place + offset < length[chain])
                rows = np.flatnonzero(ok)
                cells = near[flat[rows + offset]]
                score[rows] += model.near[k][cells].sum(1)
                shifted.append((rows, cells))
            triple = np.concatenate([triples_of(kinds[c]) for c, _ in batch])
            score += model.triples[triple].sum(1)
            padded = np.full((len(batch), int(length.max()), len(LABELS)), 0.0)
            padded[chain, place] = score
            nodes, pairs = marginals(padded, length, model.steps.astype(np.float64))
            error = -nodes[chain, place]
            error[np.arange(len(gold)), gold] += 1
            live = np.abs(error).max(1) > 1e-3
            rows = np.flatnonzero(live)
            if len(rows):
                cells = feats[rows]
                mask = cells >= 0
                update(model.own, squares[0], cells[mask], np.repeat(error[rows], mask.sum(1), axis=0))
                update(model.triples, squares[2], triple[rows].ravel(), np.repeat(error[rows], triple.shape[1], axis=0))
                for k, (rows_k, cells_k) in enumerate(shifted):
                    keep = live[rows_k]
                    if keep.any():
                        update(model.near[k], squares[1][k], cells_k[keep].ravel(), np.repeat(error[rows_k[keep]], cells_k.shape[1], axis=0))
            true = np.zeros_like(pairs)
            inner = place[1:] > 0
            np.add.at(true, (gold[:-1][inner], gold[1:][inner]), 1)
            grad = true - pairs
            step_squares += grad * grad
            model.steps = np.where(limits < 0, limits, model.steps + 0.3 * grad / np.sqrt(step_squares)).astype(np.float32)
    return model, counts


def with_skips(model: SkipChain, counts: SkipCounts) -> SkipChain:
    """The model with its skip potentials, piecewise from label agreement."""
    eligible, mailed = counts.eligible + 0.1, counts.mailed + 0.1
    base = eligible / eligible.sum()
    for kind in (EQUAL, SHOWN):
        agree = counts.agree[kind] + 0.1
        joint = (agree + agree.T) / (2 * agree.sum())
        # next to nothing may be rare of its own, or one chance pair would weigh much
        alone = np.maximum(base if kind == SHOWN else joint.sum(1), 0.1)
        lift = np.clip(np.log(joint / (alone[:, None] * alone[None, :])), -8, 8)
        lift[1], lift[:, 1] = 0, 0  # no word is a number
        if kind == SHOWN:
            lift[3, 3] = max(lift[3, 3], SAME_NAME)
        model.skips[kind] = lift[_GROUP[:, None], _GROUP[None, :]]
    # the address itself is sure
    model.skips[MAIL, :, EMAIL] = np.clip(np.log(mailed / mailed.sum() / base), -8, 8)[_GROUP]
    return model


class Tally:
    """Per word the documents that have it, its tokens inside items and all of them; and the words of each name and address."""

    def __init__(self) -> None:
        self.words: dict[str, list[int]] = {}
        self.items: set[tuple[str, ...]] = set()

    def add(self, kinds: list[str], tokens: list[str], labels: list[int]) -> None:
        low = [t.lower() for t in tokens]
        seen = set()
        for kind, word, label in zip(kinds, low, labels, strict=True):
            if kind == "word":
                own = self.words.setdefault(word, [0, 0, 0])
                if word not in seen:
                    seen.add(word)
                    own[0] += 1
                own[1] += label != O
                own[2] += 1
        at = 0
        while at < len(low):
            end = at + 1
            if labels[at] >= B_ADR:
                while end < len(low) and labels[end] in (I_ADR, I_PER):
                    end += 1
                self.items.add(tuple(sorted({w for w in low[at:end] if len(w) > 1 and w.isalpha()})))
            at = end


def seldom_in_items(words: dict[str, list[int]], per: float) -> set[str]:
    """Words of at least three documents, or that share of many, that are seldom part of an item."""
    return {w for w, (documents, inside, every) in words.items() if documents >= 3 * per and inside * 10 <= 3 * every} - FORMS


def keep_items(ordinary: set[str], words: dict[str, list[int]], items: Iterable[tuple[str, ...]]) -> frozenset[str]:
    """``ordinary`` less what it takes for every labelled name and address to keep one other word at least."""
    for item in sorted(items):
        if item and ordinary.issuperset(item):
            ordinary.discard(max(item, key=lambda w: (words[w][1] / words[w][2], w)))
    return frozenset(ordinary)


def _ordinary_words(labelled: list[tuple[list[str], list[str], list[int], list[int]]]) -> frozenset[str]:
    """The ordinary words of a list of labelled texts."""
    tally = Tally()
    for kinds, tokens, _, labels in labelled:
        tally.add(kinds, tokens, labels)
    return keep_items(seldom_in_items(tally.words, max(1.0, len(labelled) / COUNTED_IN)), tally.words, tally.items)


def _plain(word: str) -> str:
    """The word without case and accents."""
    low = word.casefold()
    return low if low.isascii() else "".join(c for c in unicodedata.normalize("NFD", low) if not unicodedata.combining(c))


#: Kinds of skip edges: equal words, equal words of which one is shown to be a name, a word and the e-mail address with it.
EQUAL, MAIL, SHOWN = range(3)
#: Least potential of two equal words as names where one is shown to be one; repetitions without a form of address are
#: rare in labels made by notations, so their fitted potential is not trusted to be as high.
SAME_NAME = 12.0
_NO_NAMES = FORMS | PARTICLES | STREET_WORDS | UNIT_WORDS | PHONE_WORDS | ID_WORDS


def _shown(texts: list[str], i: int, names: Gazetteer) -> bool:
    """Whether a form of address, an initial or a given name stands before the word, or a given name behind it and a comma."""
    before = texts[i - 1] if i else ""
    if before == "." and i > 1:
        before = texts[i - 2]
    if before.casefold() in FORMS or before.casefold() in names.given or (before[-1:] == "." and len(before) == 2):
        return True
    return texts[i + 1 : i + 2] == [","] and i + 2 < len(texts) and texts[i + 2].casefold() in names.given


def skip_links(kinds: list[str], texts: list[str], ordinary: frozenset[str], names: Gazetteer) -> list[tuple[int, int, int]]:
    """(kind, place, place) of the skip edges among a document's tokens; ordinary words have none.

    ``EQUAL`` and ``SHOWN`` join consecutive occurrences of one word, case, accents and a genitive
    s aside; ``MAIL`` joins a word to the next, else the last, e-mail address whose local part contains it.
    """
    links: list[tuple[int, int, int]] = []
    last: dict[str, tuple[int, bool]] = {}
    places = [i for i, (k, t) in enumerate(zip(kinds, texts, strict=True)) if k == "word" and len(t) > 2 and (low := t.lower()) not in ordinary and low not in _NO_NAMES]
    keys = [_plain(texts[i]) for i in places]
    for i, key in zip(places, keys, strict=True):
        before = last.get(key) or (last.get(key[:-1]) if key[-1] == "s" and len(key) > 5 else last.get(key + "s"))
        shown = _shown(texts, i, names)
        if before is not None:
            shown |= before[1]
            links.append((SHOWN if shown else EQUAL, before[0], i))
        last[key] = (i, shown)
    mails = [(j, "".join(filter(str.isalpha, _plain(re.split("[@＠﹫]|[ \\[({<](?:at|AT)", texts[j])[0])))) for j, k in enumerate(kinds) if k == "email"]
    if mails:
        for i, key in zip(places, keys, strict=True):
            if len(key) >= 4 and (own := [j for j, local in mails if key in local]):
                links.append((MAIL, i, next((j for j in own if j > i), own[-1])))
    return links


# --- use ---------------------------------------------------------------------------------

#: A token whose score for O leads by more than this is O unless a skip edge reaches it; chains are cut there.
CERTAIN = 9.0
TURNS = 3
#: Characters that are labelled at a time; documents are never split.
_BATCH = 400_000


def label_documents(texts: list[str], scorer: Scorer, turns: int = TURNS) -> list[list[tuple[str, int, int]]]:
    """(type, start, end) of the items of every text: loopy message passing over chains and skip edges."""
    model = scorer.model
    found: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    kinds: list[str] = []
    words: list[str] = []
    starts: list[int] = []
    sequence: list[int] = []
    owner: list[int] = []  # document of each stretch
    links: list[tuple[int, int, int]] = []
    for d, text in enumerate(texts):
        first = len(kinds)
        for a, b in live_stretches(text, model.ordinary) if text else ():
            k, w, s = tokenize(text[a:b])
            kinds += k
            words += w
            starts += [a + x for x in s]
            sequence += [len(owner)] * len(k)
            owner.append(d)
        if len(kinds) > first:
            links += [(kind, first + i, first + j) for kind, i, j in skip_links(kinds[first:], words[first:], model.ordinary, model.names)]
    if not kinds:
        return found
    in_sequence = np.array(sequence)
    score = scorer.scores(scorer.tokens(kinds, words), in_sequence)
    edges = np.array(links, dtype=np.int64).reshape(-1, 3)
    open_ = score[:, 1:].max(1) - score[:, O] > -CERTAIN
    # what a message can reach is never fixed before it, nor are its neighbours
    ends = edges[:, 1:].ravel()
    open_[ends] = True
    for step in (-1, 1):
        near = np.clip(ends + step, 0, len(kinds) - 1)
        open_[near[in_sequence[near] == in_sequence[ends]]] = True
    places = np.flatnonzero(open_)
    if not len(places):
        return found
    cuts = np.flatnonzero((np.diff(places) > 1) | (np.diff(in_sequence[places]) != 0)) + 1
    start = np.r_[0, cuts, len(places)]
    length = np.diff(start)
    unary = score[places].astype(np.float64)
    at = np.cumsum(open_) - 1
    left, right = at[edges[:, 1]], at[edges[:, 2]]
    incoming = np.zeros_like(unary)
    steps = model.steps.astype(np.float64)
    belief = np.empty_like(unary)
    _chain_beliefs(belief, unary, length, start, steps, np.arange(len(length)))
    if turns and len(edges):
        messages = np.zeros((2, len(edges), len(LABELS)))
        potential = model.skips.astype(np.float64)[edges[:, 0]]
        linked = np.unique(np.searchsorted(start, np.r_[left, right], "right") - 1)
        for _ in range(turns):
            # what one end says to the other leaves out what it was told by it
            for way, (end, pair) in enumerate(((left, potential), (right, potential.transpose(0, 2, 1)))):
                said = np.log(np.maximum(belief[end], 1e-30)) - messages[1 - way]
                new = _log_sum(said[:, :, None] + pair, 1)
                messages[way] = new - new.max(1, keepdims=True)
            # an address is known by its notation and is told nothing
            messages[0][edges[:, 0] == MAIL] = 0
            incoming[:] = 0
            np.add.at(incoming, right, messages[0])
            np.add.at(incoming, left, messages[1])
            _chain_beliefs(belief, unary + incoming, length, start, steps, linked)
    best = belief.argmax(1)
    for k in np.unique(np.searchsorted(start, np.flatnonzero(best != O), "right") - 1):
        a, b = int(places[start[k]]), int(places[start[k + 1] - 1]) + 1
        found[owner[in_sequence[a]]] += _items((kinds, words, starts), a, best[start[k] : start[k + 1]])
    return found


def _chain_beliefs(out: np.ndarray, unary: np.ndarray, length: np.ndarray, start: np.ndarray, steps: np.ndarray, which: np.ndarray) -> None:
    """Write the node marginals of the stretches ``which``, those of like length together. What surrounds a stretch is O."""
    order = which[np.argsort(length[which], kind="stable")]
    for chunk in np.array_split(order, max(1, len(order) // 256)):
        own = length[chunk]
        places = int(own.max())
        index = start[chunk][:, None] + np.minimum(np.arange(places)[None, :], own[:, None] - 1)
        emission = unary[index].copy()
        emission[:, 0] += steps[O]
        emission[np.arange(len(chunk)), own - 1] += steps[:, O]
        nodes, _ = marginals(emission, own, steps, with_pairs=False)
        inside = np.arange(places)[None, :] < own[:, None]
        out[index[inside]] = nodes[inside]


def _items(tokens: tuple[list[str], list[str], list[int]], at: int, labels: np.ndarray) -> list[tuple[str, int, int]]:
    """Runs of labels as items, checked for what each type cannot be without."""
    kinds, texts, starts = tokens
    items, i = [], 0
    while i < len(labels):
        label = int(labels[i])
        if label == O:
            i += 1
            continue
        j = i + 1
        if label in (B_ADR, I_ADR, B_PER, I_PER):
            inner = I_ADR if label in (B_ADR, I_ADR) else I_PER
            while j < len(labels) and labels[j] == inner:
                j += 1
        first, last = at + i, at + j
        if label in (B_PER, I_PER):
            while first < last and (texts[first].casefold() in FORMS or not texts[first][0].isalpha()):
                first += 1
            while last > first and not (texts[last - 1][-1].isalnum() or texts[last - 1] == "."):
                last -= 1
        if first < last and _plausible(label, kinds[first:last], texts[first:last]):
            items.append((TYPES[label], starts[first], starts[last - 1] + len(texts[last - 1])))
        i = j
    return items


def _plausible(label: int, kinds: list[str], texts: list[str]) -> bool:
    if label == EMAIL:
        return kinds[0] == "email"
    if label == PHONE:
        return kinds[0] == "number" and 6 <= len(digits_of(texts[0])) <= 16
    if label == ID:
        return kinds[0] in ("number", "code") and len(re.sub(r"\W", "", texts[0])) >= 5
    if label in (B_ADR, I_ADR):
        return any(k in ("number", "code") for k in kinds) and any(k == "word" and len(t) > 1 for k, t in zip(kinds, texts, strict=True))
    return any(k == "word" and len(t) > 1 and t.isalpha() and t.casefold() not in FIRMS for k, t in zip(kinds, texts, strict=True))


PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID]", "street_address": "[ADDRESS]", "person_name": "[NAME]"}


def masked(text: str, items: list[tuple[str, int, int]]) -> str:
    """The text with each item replaced by its type's placeholder."""
    out, at = [], 0
    for kind, start, end in sorted(items, key=lambda x: x[1]):
        if start >= at:
            out += [text[at:start], PLACEHOLDERS[kind]]
            at = end
    return "".join([*out, text[at:]])


def _finder(shared, as_rows: bool):
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for batch in batches:
            sizes = np.cumsum([len(t) if isinstance(t, str) else 0 for t in batch["text"]])
            for part in [p for _, p in batch.groupby(sizes // _BATCH, sort=False)]:
                texts = [t if isinstance(t, str) else "" for t in part["text"]]
                items = label_documents(texts, scorer)
                if as_rows:
                    rows = [(doc, *item) for doc, own in zip(part["doc_id"], items, strict=True) for item in own]
                    yield pd.DataFrame(rows, columns=["doc_id", "pii_type", "start_pos", "end_pos"])
                else:
                    clean = [masked(t, own) if isinstance(t, str) else None for t, own in zip(part["text"], items, strict=True)]
                    yield pd.DataFrame({"doc_id": part["doc_id"], "n_items": [len(x) for x in items], "text": clean})

    return find


_PAIRS = "context string, given string, family string, n bigint"


def _count_names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of name pairs, and with the word alone as ``family`` of lower-case words."""
    counts: Counter[tuple[str | None, str | None, str]] = Counter()

    def given_on() -> pd.DataFrame:
        out = pd.DataFrame([(*key, n) for key, n in counts.items()], columns=["context", "given", "family", "n"])
        counts.clear()
        return out

    for batch in batches:
        for text in batch["text"]:
            counts.update(name_pairs(text))
            counts.update((None, None, word) for word in lower_words(text))
            if len(counts) >= _COUNTS:
                yield given_on()
    if counts:
        yield given_on()


_LABELLED = "word string, documents bigint, inside bigint, every bigint, item array<string>, text string, place array<int>, label array<int>"


def _label_weakly(shared):
    """Every text with the places and labels of the tokens that have one, and the tallies of all."""

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tally, columns = Tally(), [c.split(" ")[0] for c in _LABELLED.split(", ")]

        def given_on() -> pd.DataFrame:
            rows = [(w, *n, None, None, None, None) for w, n in tally.words.items()]
            rows += [(None, 0, 0, 0, list(item), None, None, None) for item in tally.items]
            tally.__init__()
            return pd.DataFrame(rows, columns=columns)

        for batch in batches:
            rows = []
            for text in batch["text"]:
                kinds, tokens, starts, labels = weak_labels(text, shared.value)
                tally.add(kinds, tokens, labels)
                some = [(start, y) for start, y in zip(starts, labels, strict=True) if y]
                rows.append((None, 0, 0, 0, None, text, [start for start, _ in some], [y for _, y in some]))
            yield pd.DataFrame(rows, columns=columns)
            if len(tally.words) + len(tally.items) >= _COUNTS:
                yield given_on()
        yield given_on()

    return label


def _within(shared):
    """The items that have no word but ordinary ones."""

    def within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[[shared.value.issuperset(item) for item in batch["item"]]]

    return within


#: Weights are summed as whole multiples of this, so that their order does not matter.
_GRAIN = 2.0**-24
_FITTED = "matrix int, cell int, parts bigint, " + ", ".join(f"w{k} bigint" for k in range(len(LABELS)))


def _matrices(model: SkipChain, counts: SkipCounts) -> list[np.ndarray]:
    """All that is fitted, as views of rows of eight."""
    skips = np.zeros((14, len(LABELS)))
    skips[:, :4] = np.concatenate([counts.agree.reshape(-1, 4), counts.eligible[None], counts.mailed[None]])
    return [model.own, *model.near, model.triples, model.steps, skips]


def _fitter(shared, seed: int):
    """The sums of the fits of a task's parts, which come one after another, equal texts side by side."""

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, ordinary = shared.value
        sums: list[np.ndarray] = []
        parts: list[np.ndarray] = []

        def fit(part: int, own: list[Document]) -> None:
            for n, matrix in enumerate(_matrices(*fit_part(own, names, ordinary, seed + part))):
                if len(sums) == n:
                    sums.append(np.zeros(matrix.shape, np.int64))
                    parts.append(np.zeros(len(matrix), np.int64))
                sums[n] += np.rint(matrix / _GRAIN).astype(np.int64)
                parts[n] += matrix.any(1)

        now, last, own = -1, None, []
        for batch in batches:
            for part, text, place, label in zip(batch["part"], batch["text"], batch["place"], batch["label"], strict=True):
                if part != now:
                    if own:
                        fit(now, own)
                    now, last, own = part, None, []
                if text != last:
                    own.append(_document(text, dict(zip(place, label, strict=True)), ordinary))
                last = text
        if own:
            fit(now, own)
        for n, (matrix, count) in enumerate(zip(sums, parts, strict=True)):
            cells = np.flatnonzero(count)
            yield pd.DataFrame({"matrix": n, "cell": cells, "parts": count[cells], **{f"w{k}": matrix[cells, k] for k in range(len(LABELS))}})

    return fitted


def _document(text: str, labels: dict[int, int], ordinary: frozenset[str]) -> Document:
    spans = live_stretches(text, ordinary)
    kinds, tokens, starts = [], [], []
    for a, b in spans:
        k, w, s = tokenize(text[a:b])
        kinds += k
        tokens += w
        starts += [a + x for x in s]
    return spans, kinds, tokens, starts, [labels.get(x, O) for x in starts]


def _model(documents: DataFrame, fit_documents: int, seed: int):
    """The model of all documents: names and ordinary words by counts over all, weights and potentials as means over fits of parts.

    Which part a text is in is settled by the text, and equal texts are fitted once, so neither order nor partitions matter.
    A weight is the mean over the parts that have its feature.
    """
    spark = documents.sparkSession
    rows = documents.where("text is not null and length(trim(text)) > 0").select("text")
    total = rows.count()
    per = max(1.0, total / COUNTED_IN)
    rows = spread(rows)
    pairs = durable(rows.mapInPandas(_count_names, _PAIRS).groupBy("context", "given", "family").agg(F.sum("n").alias("n")))

    def counted(column: str, least: float, contexts: Iterable[str] | None = None, givens: Iterable[str] | None = None) -> dict[str, int]:
        some = pairs.where("context is not null")
        for of, values in (("context", contexts), ("given", givens)):
            some = some if values is None else some.where(F.col(of).isin(sorted(values)))
        return {r[0]: r["n"] for r in some.groupBy(column).agg(F.sum("n").alias("n")).where(F.col("n") >= least).collect()}

    common = {r["family"] for r in pairs.where("context is null").where(F.col("n") >= 12 * per).collect()}
    names = settle_names(counted, common, per)
    labelled = durable(rows.mapInPandas(_label_weakly(spark.sparkContext.broadcast(names)), _LABELLED))
    sums = [F.sum(c).alias(c) for c in ("documents", "inside", "every")]
    frequent = labelled.where("word is not null").groupBy("word").agg(*sums).where(F.col("documents") >= 3 * per).where("inside * 10 <= 3 * every").collect()
    words = {r["word"]: [r["documents"], r["inside"], r["every"]] for r in frequent}
    seldom = seldom_in_items(words, per)
    inner = labelled.where("item is not null").select("item").distinct().mapInPandas(_within(spark.sparkContext.broadcast(seldom)), "item array<string>").collect()
    ordinary = keep_items(seldom, words, [tuple(r["item"]) for r in inner])
    parts = max(1, -(-total // fit_documents))
    # no more tasks than parts, and several parts to a task where there are many
    tasks = min(parts, max(8 * spark.sparkContext.defaultParallelism, parts // 16))
    dealt = labelled.where("text is not null").select(F.pmod(F.xxhash64(F.lit(seed), "text"), F.lit(parts)).cast("int").alias("part"), "text", "place", "label")
    fitted = dealt.repartition(tasks, "part").sortWithinPartitions("part", "text").mapInPandas(_fitter(spark.sparkContext.broadcast((names, ordinary)), seed), _FITTED)
    sums = [F.sum(c).alias(c) for c in fitted.columns[2:]]
    return spark.sparkContext.broadcast(_mean(fitted.groupBy("matrix", "cell").agg(*sums).toArrow().to_pandas(), parts, names, ordinary))


def _mean(fitted: pd.DataFrame, parts: int, names: Gazetteer, ordinary: frozenset[str]) -> SkipChain:
    """The model whose weights are the means of those fitted."""
    zeros = [np.zeros((_CELLS, len(LABELS)), np.float32) for _ in range(2 + len(_OFFSETS))]
    matrices = [*zeros, _step_limits(), np.zeros((14, len(LABELS)))]
    for n, own in fitted.groupby("matrix"):
        # label agreement is counted in every part
        shares = own["parts"].to_numpy() if n < len(matrices) - 1 else np.full(len(own), parts)
        matrices[n][own["cell"]] = own[[f"w{k}" for k in range(len(LABELS))]].to_numpy() * _GRAIN / shares[:, None]
    own, *near, triples, steps, skips = matrices
    limits = _step_limits()
    steps = np.where(limits < 0, limits, steps)
    model = SkipChain(own, np.stack(near), triples, steps, np.zeros((3, len(LABELS), len(LABELS)), np.float32), ordinary, names)
    return with_skips(model, SkipCounts(skips[:12, :4].reshape(3, 4, 4), skips[12, :4], skips[13, :4])) if len(fitted) else model


def find_personal_information(documents: DataFrame, fit_documents: int = FIT_DOCUMENTS, seed: int = 11) -> DataFrame:
    """(doc_id, pii_type, start_pos, end_pos): one row per item, positions in code points from 0.

    Types are email, phone, id_number, street_address and person_name. Null and empty texts
    have none; repeated rows are read each by themselves; an empty table gives no rows.

    A skip-chain conditional random field labels tokens; e-mail addresses, number groups and
    codes are one token each. Chains join neighbouring tokens, skip edges join repetitions of
    a capitalised word in a document, and loopy message passing settles both. The model is
    fitted on all documents, labelled by notations, label words and the names that forms of
    address introduce: names and words are counted over all, weights are means over parts of
    about ``fit_documents``. All documents are then labelled whole, in one pass without a shuffle.
    """
    shared = _model(documents, fit_documents, seed)
    rows = documents.select(sealed("doc_id").alias("doc_id"), "text").where("text is not null")
    return spread(rows).mapInPandas(_finder(shared, True), "doc_id bigint, pii_type string, start_pos bigint, end_pos bigint").withColumn("doc_id", opened("doc_id"))


def mask_personal_information(documents: DataFrame, fit_documents: int = FIT_DOCUMENTS, seed: int = 11) -> DataFrame:
    """(doc_id, n_items, text): every text with typed placeholders for its items; null texts stay null."""
    shared = _model(documents, fit_documents, seed)
    rows = documents.select(sealed("doc_id").alias("doc_id"), "text")
    return spread(rows).mapInPandas(_finder(shared, False), "doc_id bigint, n_items int, text string").withColumn("doc_id", opened("doc_id"))
