"""Deterministic text normalisation.

Everything but Unicode composition and the joiner rule is a native expression, so ASCII text,
the bulk of any corpus, never leaves the JVM: the Arrow function behind ``composed`` receives
null for it.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NORMALIZER_VERSION = 3

# Code points that are removed, and those that count as a blank.
REMOVED = "".join(
    map(chr, [*range(0x00, 0x09), 0x0B, 0x0C, *range(0x0E, 0x20), *range(0x7F, 0xA0), 0xAD, 0x200B, 0x200C, 0x200E, 0x200F, *range(0x202A, 0x202F), 0x2060, *range(0x2066, 0x206A), 0xFEFF])
)
BLANKS = "".join(map(chr, [0x09, 0xA0, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]))
SINGLE_QUOTES, DOUBLE_QUOTES = "‘’‚‛", "“”„‟"
#: White space that is left once blanks are folded, besides the blank and the line feed.
_REST = "   "
_JOINER = "‍"
# The code points of Extended_Pictographic in Unicode 15.1.
EXTENDED_PICTOGRAPHIC = """
00A9 00AE 203C 2049 2122 2139 2194-21AA 231A-231B 2328 2388 23CF 23E9-23F3 23F8-23FA 24C2 25AA-25AB 25B6 25C0
25FB-25FE 2600-2605 2607-2612 2614-2685 2690-2705 2708-2712 2714 2716 271D 2721 2728 2733-2734 2744 2747 274C 274E
2753-2755 2757 2763-2767 2795-2797 27A1 27B0 27BF 2934-2935 2B05-2B07 2B1B-2B1C 2B50 2B55 3030 303D 3297 3299
1F000-1F0FF 1F10D-1F10F 1F12F 1F16C-1F171 1F17E-1F17F 1F18E 1F191-1F19A 1F1AD-1F1E5 1F201-1F20F 1F21A 1F22F
1F232-1F23A 1F23C-1F23F 1F249-1F3FA 1F400-1F53D 1F546-1F64F 1F680-1F6FF 1F774-1F77F 1F7D5-1F7FF 1F80C-1F80F
1F848-1F84F 1F85A-1F85F 1F888-1F88F 1F8AE-1F8FF 1F90C-1F93A 1F93C-1F945 1F947-1FAFF 1FC00-1FFFD
"""
_PICTOGRAPHS = [tuple(int(end, 16) for end in (r.split("-") * 2)[:2]) for r in EXTENDED_PICTOGRAPHIC.split()]
_PICTOGRAPH_STARTS = [first for first, _ in _PICTOGRAPHS]
#: Variation selectors and skin tones, which stand between a pictograph and its joiner.
_TRANSPARENT = frozenset(map(chr, [0xFE0E, 0xFE0F, *range(0x1F3FB, 0x1F400)]))


def _pictographic(char: str) -> bool:
    at = bisect_right(_PICTOGRAPH_STARTS, ord(char)) - 1
    return at >= 0 and ord(char) <= _PICTOGRAPHS[at][1]


def _drop_joiners(text: str) -> str:
    """Keep a zero-width joiner only beside a pictograph, on either side, variation selectors and skin tones aside."""
    if _JOINER not in text:
        return text
    solid = [(at, char) for at, char in enumerate(text) if char not in _TRANSPARENT]
    beside = [" ", *(char for _, char in solid), " "]
    stray = {at for n, (at, char) in enumerate(solid) if char == _JOINER and not (_pictographic(beside[n]) or _pictographic(beside[n + 2]))}
    return "".join(char for at, char in enumerate(text) if at not in stray)


def compose(text: str) -> str:
    """NFC with stray joiners dropped."""
    return _drop_joiners(unicodedata.normalize("NFC", text))


def _compose(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(compose, na_action="ignore")

    return run(text)


def composed(text: Column) -> Column:
    """``compose``, for text that is not plain ASCII; ASCII passes by."""
    plain = text.rlike(r"^[\x00-\x7F]*$")
    return F.when(plain, text).otherwise(_compose(F.when(plain, F.lit(None)).otherwise(text)))


def fold_characters(text: Column) -> Column:
    """Drop invisible characters, fold blanks, quotes and line ends; dashes and ellipses stay."""
    source = "‘’‚‛" + "“”„‟" + BLANKS + REMOVED
    target = "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES) + " " * len(BLANKS)
    return F.translate(F.regexp_replace(F.translate(text, source, target), "\r\n?", "\n"), "\r", "\n")


def content_text(text: Column, compose_unicode: bool = True) -> Column:
    """Blank runs as one blank, break runs as one line feed, trimmed. Null stays null."""
    folded = fold_characters(composed(text) if compose_unicode else text)
    blanks = F.regexp_replace(folded, f"[ {_REST[0]}]+", " ")
    breaks = F.regexp_replace(blanks, f" ?[\n{_REST[1:]}][ \n{_REST}]*", "\n")
    return F.regexp_replace(breaks, f"^[ \n{_REST}]+|[ \n{_REST}]+$", "")


def hash_text(text: Column, compose_unicode: bool = True) -> Column:
    """Every white-space run as one blank, trimmed. Null stays null."""
    folded = fold_characters(composed(text) if compose_unicode else text)
    return F.regexp_replace(F.regexp_replace(folded, f"[ \n{_REST}]+", " "), "^ | $", "")


def digest(text: Column) -> Column:
    """SHA-256 in hexadecimal of the UTF-8 bytes."""
    return F.sha2(text, 256)


def _casefold(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: " ".join(t.split()).casefold(), na_action="ignore")

    return run(text)


def folded_label(text: Column, native: bool = False) -> Column:
    """Case-folded with white-space runs as one blank, trimmed; for ASCII lower case is case folding and stays native.

    ``native`` takes lower case for all text, where no Python may stand, as inside the lambdas of an array.
    """
    plain = text.rlike(r"^[\x00-\x7F]*$")
    lower = F.regexp_replace(F.lower(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " ")), "^ | $", "")
    if native:
        return lower
    return F.when(plain, lower).otherwise(_casefold(F.when(plain, F.lit(None)).otherwise(text)))


def paragraphs(text: Column) -> Column:
    """The non-empty parts between blank lines, trimmed."""
    return F.filter(F.transform(F.split(text, "\n[ \t]*\n\\s*"), lambda p: F.trim(F.translate(p, "\r", ""))), lambda p: p != "")


def headed(framework: Column, title: Column) -> Column:
    """``framework - title``, or the framework alone where it already contains the title."""
    return F.when(F.instr(F.lower(framework), F.lower(title)) > 0, framework).otherwise(F.concat_ws(" - ", framework, title))


def name_forms(path: Column) -> Column:
    """Spellings under which a file name is matched: name, stem, folded stem, folded stem without a storage suffix."""
    decoded = F.url_decode(F.replace(F.substring_index(path, "/", -1), F.lit("+"), F.lit("%2B")))
    name = F.lower(decoded)
    stem = F.regexp_replace(name, r"\.[a-z0-9]{1,5}$", "")
    folded = F.trim(F.regexp_replace(stem, r"[\s_\-.]+", " "))
    bare = F.trim(F.regexp_replace(folded, r" [a-z0-9]{7}$", ""))
    return F.array_distinct(F.filter(F.array(name, stem, folded, bare), lambda x: x != ""))


def file_name(path: Column) -> Column:
    """The percent-decoded last part of a path; a percent sign that begins no escape and a plus stay as they are."""
    last = F.regexp_replace(F.substring_index(path, "/", -1), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.url_decode(F.replace(last, F.lit("+"), F.lit("%2B")))


def file_stem(name: Column) -> Column:
    """A file name without its extension."""
    return F.regexp_replace(name, r"\.[A-Za-z0-9]+$", "")


def folded_name_forms(name: Column) -> Column:
    """A file name's stem with and without one storage suffix of seven characters, separators folded, in lower case; none is empty."""
    stem = file_stem(name)
    forms = F.array(stem, F.regexp_replace(stem, "_[A-Za-z0-9]{7}$", ""))
    folded = F.transform(forms, lambda x: F.lower(F.regexp_replace(F.regexp_replace(x, r"(?U)[-_\s]+", "_"), "^_|_$", "")))
    return F.array_distinct(F.filter(folded, lambda x: x != ""))
