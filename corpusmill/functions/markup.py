"""HTML fragments to blocks: a small tree builder, cleaning rules with counters, and block emission.

The tree builder stands on the standard library's tokenizer. It knows void elements, implied
ends of paragraphs, items, rows and cells, implied row groups, raw-text elements and unclosed
tags; it does not rebuild misnested formatting the way browsers do.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.blocks import BLOCKS
from corpusmill.functions.text import BLANKS, REMOVED, compose
from corpusmill.functions.urls import canonical

# Element names by what the rules and the builder do with them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
FOREIGN = frozenset(("svg", "math"))
SCRIPTING = frozenset("script style noscript template".split())
EMBEDDED = frozenset("iframe object embed applet canvas svg".split())
CONTROLS = frozenset("form input button select option textarea label".split())
PRESENTATIONAL = frozenset(("hr", "wbr"))
KEPT_EMPTY = frozenset("table thead tbody tfoot tr td th caption col colgroup br img".split())
PROTECTING = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li table figure img".split())
TRANSPARENT = frozenset("div section article main aside header footer blockquote details summary nav figcaption center".split())
CELL_BLOCKS = frozenset("p div ul ol li h1 h2 h3 h4 h5 h6 table section blockquote".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
TABLE_PARTS = frozenset("table tr tbody thead tfoot".split())
ROW_GROUPS = ("thead", "tbody", "tfoot")
URL_ATTRIBUTES = ("href", "src", "action", "formaction", "xlink:href")


class Node:
    """An element: children are strings and nodes in order; a comment is a node named ``#comment``.

    ``says``, ``shields`` and ``pictured``, which cleaning sets, tell whether there is text, an element
    that keeps its surroundings, or an image below.
    """

    __slots__ = ("attrs", "children", "name", "pictured", "says", "shields")

    def __init__(self, name: str, attrs: dict[str, str] | None = None):
        self.name, self.attrs, self.children = name, attrs or {}, []
        self.says = self.shields = False
        self.pictured: bool | None = None

    def elements(self):
        return (c for c in self.children if isinstance(c, Node) and c.name != "#comment")

    def walk(self):
        """All elements below, in document order, however deep."""
        trail = [self.elements()]
        while trail:
            node = next(trail[-1], None)
            if node is None:
                trail.pop()
            else:
                yield node
                trail.append(node.elements())


class _Builder(HTMLParser):
    #: For a start tag: the open elements it ends, up to the element that shields them.
    _ENDS = {
        "li": (("li",), ("ul", "ol", "menu")),
        "dt": (("dt", "dd"), ("dl",)),
        "dd": (("dt", "dd"), ("dl",)),
        "option": (("option",), ("select",)),
        "tr": (("tr", "td", "th", "caption"), ("table",)),
        "td": (("td", "th"), ("tr", "table")),
        "th": (("td", "th"), ("tr", "table")),
        "thead": ((*ROW_GROUPS, "tr", "td", "th", "caption"), ("table",)),
        "tbody": ((*ROW_GROUPS, "tr", "td", "th", "caption"), ("table",)),
        "tfoot": ((*ROW_GROUPS, "tr", "td", "th", "caption"), ("table",)),
    }

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#fragment")
        self.open = [self.root]
        #: Where elements of each name stand among the open ones, so that no search walks the stack.
        self.places: dict[str, list[int]] = defaultdict(list)

    def _last(self, names) -> int:
        """The innermost open element of one of the names, or 0."""
        return max((self.places[n][-1] for n in names if self.places[n]), default=0)

    def _cut(self, at: int) -> None:
        while len(self.open) > at:
            self.places[self.open.pop().name].pop()

    def _close_up_to(self, names: tuple[str, ...], shields: tuple[str, ...]) -> None:
        shield = self._last(shields)
        while (at := self._last(names)) > shield:
            self._cut(at)

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P:
            self._close_up_to(("p",), ("table", "td", "th", "button", "object"))
        if tag in self._ENDS:
            self._close_up_to(*self._ENDS[tag])
        if tag in HEADINGS and self.open[-1].name in HEADINGS:
            self._cut(len(self.open) - 1)
        if tag == "tr" and self.open[-1].name == "table":
            self._push(Node("tbody"))
        if tag in ("td", "th") and self.open[-1].name in ("table", *ROW_GROUPS):
            if self.open[-1].name == "table":
                self._push(Node("tbody"))
            self._push(Node("tr"))
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)})
        if tag in VOID:
            self.open[-1].children.append(node)
        else:
            self._push(node)

    def _push(self, node: Node) -> None:
        self.open[-1].children.append(node)
        self.places[node.name].append(len(self.open))
        self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self._last(FOREIGN):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag == "br":
            self.open[-1].children.append(Node("br"))
        elif tag == "p" and not self.places["p"]:
            self.open[-1].children.append(Node("p"))
        else:
            at = self._last(HEADINGS if tag in HEADINGS else (tag,))
            # a cell or table is only left by what belongs to tables
            if at and (tag in TABLE_PARTS or at >= self._last(("table", "td", "th"))):
                self._cut(at)

    def handle_data(self, data):
        children = self.open[-1].children
        if children and isinstance(children[-1], str):
            children[-1] += data
        else:
            children.append(data)

    def handle_comment(self, data):
        self.open[-1].children.append(Node("#comment"))

    handle_decl = handle_pi = unknown_decl = handle_comment


def parse(markup: str) -> Node:
    """The fragment's tree; nothing is removed, references are decoded once."""
    builder = _Builder()
    builder.feed(markup)
    builder.close()
    return builder.root


# --- cleaning ----------------------------------------------------------------------------

Rule = tuple[str, Callable[[Node], bool]]


_HIDING = re.compile("display:none|visibility:hidden", re.I)
_HANDLER = re.compile("on", re.I)
_SCRIPT_URL = re.compile("(?:java|vb)script:", re.I)


def _squeezed(value: str) -> str:
    return "".join(value.split())


#: Rules by which an element goes; the first that holds is counted.
REMOVALS: tuple[Rule, ...] = (
    ("r1_comments", lambda n: n.name == "#comment"),
    ("r2_scripting", lambda n: n.name in SCRIPTING),
    ("r3_embedded", lambda n: n.name in EMBEDDED),
    ("r4_form", lambda n: n.name in CONTROLS),
    ("r5_hidden_attr", lambda n: "hidden" in n.attrs),
    ("r6_hidden_style", lambda n: "style" in n.attrs and _HIDING.search(_squeezed(n.attrs["style"])) is not None),
    ("r7_aria_hidden", lambda n: n.attrs.get("aria-hidden") == "true" and not n.says),
    ("r9_tracking_pixel", lambda n: n.name == "img" and "1" in (n.attrs.get("width"), n.attrs.get("height"))),
    ("r10_presentational", lambda n: n.name in PRESENTATIONAL),
)


def clean(root: Node) -> Counter[str]:
    """Apply the rules bottom-up, in place; returns how often each removed something.

    What follows a removed element joins what precedes it, with nothing put between. Nodes are
    taken in the reverse of their order from the top, so that all below one are done before it
    and what they hold is carried up; no depth of nesting matters.
    """
    counts: Counter[str] = Counter()
    for keep in (_by_rules, _not_empty):
        nodes = [root]
        for node in nodes:
            nodes += (c for c in node.children if isinstance(c, Node))
        for node in reversed(nodes):
            _settle(node, keep, counts)
    return counts


def _settle(node: Node, keep: Callable[[Node, Counter[str]], bool], counts: Counter[str]) -> None:
    """Keep some of a node's children, each of them settled before, and note what they hold."""
    kept: list[str | Node] = []
    node.says = node.shields = node.pictured = False
    for child in node.children:
        if isinstance(child, str):
            node.says = node.says or not child.isspace()
            if kept and isinstance(kept[-1], str):
                child = kept.pop() + child
        elif not keep(child, counts):
            continue
        else:
            node.says = node.says or child.says
            node.shields = node.shields or child.shields or child.name in PROTECTING
            node.pictured = node.pictured or child.pictured or child.name == "img"
        kept.append(child)
    node.children = kept


def _by_rules(node: Node, counts: Counter[str]) -> bool:
    if rule := next((name for name, holds in REMOVALS if holds(node)), None):
        counts[rule] += 1
        return False
    armed = [k for k, v in node.attrs.items() if _HANDLER.match(k) or (k in URL_ATTRIBUTES and _SCRIPT_URL.match(_squeezed(v)))]
    for name in armed:
        del node.attrs[name]
        counts["r8_handlers"] += 1
    return True


def _not_empty(node: Node, counts: Counter[str]) -> bool:
    if node.says or node.shields or node.name in KEPT_EMPTY:
        return True
    counts["r11_empty"] += 1
    return False


# --- blocks ------------------------------------------------------------------------------

_TABLE = str.maketrans(
    {**{c: None for c in REMOVED}, **{c: " " for c in BLANKS}, **{c: "'" for c in "‘’‚‛"}, **{c: '"' for c in "“”„‟"}}
)


def tidy(text: str) -> str:
    """``text.content_text`` for one string."""
    folded = compose(text).translate(_TABLE).replace("\r\n", "\n").replace("\r", "\n")
    lines = (" ".join(line.split()) for line in folded.splitlines())
    return "\n".join(line for line in lines if line)


def _block(kind: str, **fields) -> dict:
    return {"type": kind} | fields


class _Inline:
    """Running text of a subtree with its links; line breaks are line feeds, images say nothing."""

    def __init__(self, base: str | None, skip: tuple[Node, ...] = ()):
        self.base, self.skip, self.parts, self.links = base, skip, [], []

    def read(self, node: Node) -> _Inline:
        trail: list[tuple[Node, Iterator, int]] = [(node, iter(node.children), 0)]
        while trail:
            own, children, start = trail[-1]
            child = next(children, None)
            if child is None:
                trail.pop()
                if own.name == "a" and own is not node and (target := canonical(own.attrs.get("href"), self.base)):
                    self.links.append({"text": tidy("".join(self.parts[start:])), "href": target})
            elif isinstance(child, str):
                self.parts.append(child)
            elif child.name == "br":
                self.parts.append("\n")
            elif child.name not in ("img", "#comment") and not any(child is s for s in self.skip):
                trail.append((child, iter(child.children), len(self.parts)))
        return self

    @property
    def text(self) -> str:
        return tidy("".join(self.parts))


def _image(node: Node, caption: str | None = None) -> dict:
    alt, source = tidy(node.attrs.get("alt", "")), node.attrs.get("src", "")
    shown = node.attrs.get("role") != "presentation" and node.attrs.get("aria-hidden") != "true" and alt != source.rpartition("/")[2]
    return _block("image", src=source, alt=alt, caption=caption or None, role="informational" if alt and shown else "decorative")


def _list(node: Node, base: str | None) -> list[dict]:
    """The list and, behind it, the lists inside its items, each with its depth."""
    found, todo = [], [(node, 0)]
    while todo:
        own, depth = todo.pop()
        items, below = [], []
        for item in (n for n in own.elements() if n.name == "li"):
            inner = tuple(n for n in item.elements() if n.name in ("ul", "ol"))
            words = _Inline(base, inner).read(item).text
            items += [words] if words else []
            below += [(n, depth + 1) for n in inner]
        start = own.attrs.get("start", "") if own.name == "ol" else ""
        number = int(start) if start.removeprefix("-").isdecimal() and start.isascii() else None
        if items:
            found.append(_block("list", ordered=own.name == "ol", items=items, depth=depth, start=number))
        todo += reversed(below)
    return found


def _rows(table: Node) -> list[Node]:
    return [r for n in table.elements() for r in ([n] if n.name == "tr" else n.elements() if n.name in ROW_GROUPS else []) if r.name == "tr"]


def _cell(node: Node, base: str | None) -> str:
    """Block children stand apart by a blank, inline ones run together."""
    parts: list[str] = []
    running = _Inline(base)
    for child in node.children:
        if isinstance(child, Node) and child.name in CELL_BLOCKS:
            parts += [running.text, _Inline(base).read(child).text]
            running = _Inline(base)
        else:
            holder = Node("#cell")
            holder.children = [child]
            running.read(holder)
    parts.append(running.text)
    return " ".join(p.replace("\n", " ") for p in parts if p)


def _cells(row: Node, base: str | None) -> list[str]:
    out: list[str] = []
    for cell in row.elements():
        if cell.name in ("td", "th"):
            span = cell.attrs.get("colspan", "")
            out += [_cell(cell, base)] * (int(span) if span.isascii() and span.isdigit() and 0 < int(span) <= 1000 else 1)
    return out


def _has_head(table: Node) -> bool:
    return any(n.name == "thead" and any(r.name == "tr" for r in n.elements()) for n in table.elements())


def _table(node: Node, base: str | None) -> list[dict]:
    rows = _rows(node)
    if not rows:
        return []
    first = [c.name for c in rows[0].elements() if c.name in ("td", "th")]
    marked = _has_head(node) or (bool(first) and set(first) == {"th"})
    header = _cells(rows[0], base) if marked else []
    body = [cells for row in rows[marked:] if (cells := _cells(row, base))]
    if not body and not header:
        return []
    width = max(len(header), *(len(r) for r in body), 0) if body else len(header)
    caption = next((c for c in node.elements() if c.name == "caption"), None)
    title = _Inline(base).read(caption).text if caption else None
    return [_block("table", header=header, rows=[r + [""] * (width - len(r)) for r in body], caption=title or None)]


def _blocks_of(node: Node, base: str | None) -> list[dict]:
    """The blocks of an element that is no container."""
    name = node.name
    if name in HEADINGS:
        words = _Inline(base).read(node).text
        return [_block("heading", level=int(name[1]), text=words)] if words else []
    if name in ("ul", "ol"):
        return _list(node, base)
    if name == "table":
        return _table(node, base)
    if name == "img":
        return [_image(node)]
    if name == "figure":
        caption = next((n for n in node.walk() if n.name == "figcaption"), None)
        title = _Inline(base).read(caption).text if caption else None
        return [_image(i, title) for i in node.walk() if i.name == "img"]
    inline = _Inline(base).read(node)
    own = [_block("paragraph", text=inline.text, links=inline.links)] if inline.text else []
    return own + ([_image(n) for n in node.walk() if n.name == "img"] if name == "p" else [])


def _pictured(node: Node) -> bool:
    return node.pictured if node.pictured is not None else any(n.name == "img" for n in node.walk())


def container_blocks(node: Node, base: str | None = None) -> list[dict]:
    """Blocks of a container's children in order, those of containers in it in their place; bare text is a paragraph of its own."""
    out: list[dict] = []
    trail = [iter(node.children)]
    while trail:
        child = next(trail[-1], None)
        if child is None:
            trail.pop()
        elif isinstance(child, str):
            words = tidy(child)
            out += [_block("paragraph", text=words, links=[])] if words else []
        elif child.name in TRANSPARENT or (child.name == "figure" and not _pictured(child)):
            trail.append(iter(child.children))
        elif child.name != "#comment":
            out += _blocks_of(child, base)
    return out


def _bold_only(cell: Node) -> tuple[bool, bool]:
    """Whether a cell says anything, and whether all of it is bold."""
    says, plain, todo = False, False, [(cell, False)]
    while todo:
        node, bold = todo.pop()
        for child in node.children:
            if isinstance(child, str):
                if tidy(child):
                    says, plain = True, plain or not bold
            elif child.name != "#comment":
                todo.append((child, bold or child.name in ("b", "strong")))
    return says, not plain


def unmarked_headers(root: Node) -> int:
    """Tables of two or more rows whose first row is all bold ``td`` cells without any header mark."""
    found = 0
    for table in (n for n in root.walk() if n.name == "table"):
        rows = _rows(table)
        cells = [c for c in rows[0].elements() if c.name in ("td", "th")] if len(rows) > 1 and not _has_head(table) else []
        found += bool(cells) and all(c.name == "td" and _bold_only(c) == (True, True) for c in cells)
    return found


def convert(markup: str, base: str | None = None) -> tuple[list[dict], dict[str, int]]:
    """Blocks of a fragment and its cleaning counters, zeros left out."""
    root = parse(markup)
    counts = dict(clean(root))
    if tables := unmarked_headers(root):
        counts["table_unmarked_header"] = tables
    return container_blocks(root, base), counts


_FIELDS = ("type", "level", "text", "links", "ordered", "items", "depth", "start", "header", "rows", "caption", "src", "alt", "role", "question", "answer")


def html_blocks(markup: Column, base: str | None = None) -> Column:
    """``struct<blocks, counters>`` of a column of fragments, counters as (rule, n); null markup has nulls."""

    @F.pandas_udf(f"struct<blocks:{BLOCKS},counters:array<struct<rule:string,n:int>>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        blocks, counters = [], []
        for text in texts:
            found, counts = convert(text, base) if isinstance(text, str) else (None, None)
            blocks.append([{f: b.get(f) for f in _FIELDS} for b in found] if found is not None else None)
            counters.append([{"rule": k, "n": v} for k, v in counts.items()] if counts is not None else None)
        return pd.DataFrame({"blocks": blocks, "counters": counters})

    return run(markup)
