"""Visible text of HTML and where its blocks end."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

_DROPPED = re.compile(r"<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>|<[a-zA-Z/!?][^>]*>", re.S | re.I)
_BLOCK = re.compile(
    r"</?(?:p|div|section|article|aside|main|header|footer|nav|ul|ol|dl|table|tr|blockquote|pre|figure|form|hr|h[1-6])\b[^>]*>", re.I
)
_ITEM = re.compile(r"<(?:/?(?:li|dt|dd|td|th|caption|figcaption)\b[^>]*|br\b[^>]*)>", re.I)
#: Strengths of the ends of a block and of an item or line, above the ends of sentences and words.
BLOCK_END, ITEM_END = 5, 4


#: Longer markup is scanned by ``_scan``, whose time is linear whatever is left unclosed.
_LONG = 100_000
_RAW_START = re.compile(r"<(script|style)\b", re.I)
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style")}


def _scan(markup: str) -> Iterator[tuple[int, int]]:
    """What ``_DROPPED`` finds; an end that was searched in vain is not searched again."""
    at, absent = 0, set()
    while (at := markup.find("<", at)) >= 0:
        end = -1
        if markup.startswith("<!--", at) and "comment" not in absent:
            end = markup.find("-->", at + 4)
            end = end + 3 if end >= 0 else absent.add("comment") or -1
        elif (raw := _RAW_START.match(markup, at)) and (name := raw[1].lower()) not in absent:
            opened = markup.find(">", raw.end())
            closing = _RAW_END[name].search(markup, opened + 1) if opened >= 0 else None
            end = closing.end() if closing else absent.add(name) or -1
        if end < 0 and "tag" not in absent and markup[at + 1 : at + 2].isascii() and (markup[at + 1 : at + 2].isalpha() or markup[at + 1 : at + 2] in ("/", "!", "?")):
            end = markup.find(">", at + 2)
            end = end + 1 if end >= 0 else absent.add("tag") or -1
        if end >= 0:
            yield at, end
            at = end
        else:
            at += 1


def _spans(markup: str) -> Iterator[tuple[int, int]]:
    return _scan(markup) if len(markup) > _LONG else (m.span() for m in _DROPPED.finditer(markup))


def visible_text(markup: str) -> str:
    """Comments, tags, script and style elements become blanks; references are decoded; white space runs are one blank; trimmed."""
    if "<" in markup:
        if len(markup) > _LONG:
            at, parts = 0, []
            for start, end in _scan(markup):
                parts.append(markup[at:start])
                at = end
            markup = " ".join([*parts, markup[at:]])
        else:
            markup = _DROPPED.sub(" ", markup)
    if "&" in markup:
        markup = html.unescape(markup)
    return " ".join(markup.split())


def visible_blocks(markup: str) -> tuple[str, dict[int, int]]:
    """The visible text and, per offset just behind a block's or item's last character, the strength of that end."""
    pieces: list[tuple[str, int]] = []
    at = 0
    for start, end in _spans(markup):
        tag = markup[start:end]
        strength = BLOCK_END if _BLOCK.fullmatch(tag) else ITEM_END if _ITEM.fullmatch(tag) else 0
        pieces.append((markup[at:start], strength))
        at = end
    pieces.append((markup[at:], 0))
    text, ends, run = [], {}, []
    length = 0

    def flush() -> int:
        nonlocal length
        part = " ".join(html.unescape(" ".join(run)).split())
        run.clear()
        if part:
            length += len(part) + bool(text)
            text.append(part)
        return length

    for part, strength in pieces:
        run.append(part)
        if strength and (end := flush()):
            ends[end] = max(ends.get(end, 0), strength)
    flush()
    return " ".join(text), ends
