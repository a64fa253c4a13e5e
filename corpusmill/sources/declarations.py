"""Constructors for page declarations: what a section shows, step by step, and where its lists come from."""

from __future__ import annotations

from pyspark.sql import types as T

from corpusmill.operators.composition import Page, Section, Step
from corpusmill.operators.hierarchy import ListSpec


def h2(column: str) -> Step:
    return Step("heading", column, level=2)


def h3(column: str) -> Step:
    return Step("heading", column, level=3)


def p(column: str) -> Step:
    return Step("paragraph", column)


def img(column: str) -> Step:
    return Step("image", column)


def text(name: str) -> Step:
    """A text that stands in no table; the caller gives it under ``name``."""
    return Step("fixed", text=name)


def title(name: str) -> Step:
    """The same as a heading."""
    return Step("fixed_heading", text=name)


def bullets(items: str, column: str) -> Step:
    return Step("items", items, (column,))


def cards(items: str, heading: str, *paragraphs: str, nested: tuple[str, str] | None = None, level: int = 3) -> Step:
    return Step("cards", items, (heading, *paragraphs), nested, level)


def pairs(items: str, question: str, answer: str) -> Step:
    return Step("pairs", items, (question, answer))


def grid(items: str, *columns: str) -> Step:
    return Step("table", items, columns)


def badges(items: str, column: str) -> Step:
    """An image per item."""
    return Step("item_images", items, (column,))


def linked(link: str, parent_key: str, child_key: str, child: str, *fields: str, name: str = "items", nested: ListSpec | None = None) -> ListSpec:
    """Rows reached through a link table, in its order."""
    return ListSpec(link, parent_key, child_key, child, fields, name=name, nested=nested)


def owned(child: str, parent_key: str, *fields: str, name: str = "items") -> ListSpec:
    """Rows with the section's id in a column of their own."""
    return ListSpec(child, parent_key, "id", child, fields, name=name)


def whole(child: str, *fields: str, name: str = "items") -> ListSpec:
    """All rows of a table."""
    return ListSpec(child, "id", "id", child, fields, name=name)


def section(name: str, table: str, link: str | None, *steps: Step, lists: tuple[ListSpec, ...] = (), whole_lists: tuple[ListSpec, ...] = ()) -> Section:
    """``link``: the page's column with the section's id; None shows the table's first row."""
    fields = tuple(dict.fromkeys(s.field for s in steps if s.kind in ("heading", "paragraph", "image")))
    return Section(name, table, fields, steps, lists, link, whole_lists)


def allow_list(pages: tuple[Page, ...]) -> dict[str, T.StructType]:
    """The tables that pages may read and, of each, the columns; ids are 64-bit, all else is text."""
    columns: dict[str, dict[str, None]] = {}

    def add(table: str, *names: str) -> None:
        columns.setdefault(table, {}).update(dict.fromkeys(names))

    def add_list(spec: ListSpec) -> None:
        add(spec.link, *dict.fromkeys([spec.parent_key, spec.child_key, *spec.order]))
        add(spec.child, spec.child_id, *spec.fields)
        if spec.nested:
            add_list(spec.nested)

    for page in pages:
        add(page.table, page.page_id, page.slug, page.title, *[s.link for s in page.sections if s.link])
        for part in page.sections:
            add(part.table, part.table_id, *part.fields)
            for spec in (*part.lists, *part.whole_lists):
                add_list(spec)
    kind = lambda c: T.LongType() if c == "id" or c.endswith("_id") else T.StringType()
    return {table: T.StructType([T.StructField(c, kind(c)) for c in names]) for table, names in columns.items()}
