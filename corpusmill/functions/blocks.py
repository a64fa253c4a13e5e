"""Structured content: blocks as arrays of structs, their canonical records, rendering and JSON."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.text import compose, digest, hash_text

HASH_VERSION = 1
LINK = "struct<text:string,href:string>"
LEAF = (
    f"struct<type:string,level:int,text:string,links:array<{LINK}>,ordered:boolean,items:array<string>,depth:int,start:int,"
    "header:array<string>,rows:array<array<string>>,caption:string,src:string,alt:string,role:string>"
)
BLOCK = LEAF[:-1] + f",question:string,answer:array<{LEAF}>>"
BLOCKS = f"array<{BLOCK}>"
#: Marks between the fields and behind each record; normalised text cannot hold them.
FIELD, RECORD = "\x1f", "\x1e"


def _record(*fields: Column | str) -> Column:
    parts = [F.lit(f) if isinstance(f, str) else F.coalesce(f, F.lit("")) for f in fields]
    return F.concat(*[x for part in parts for x in (part, F.lit(FIELD))][:-1], F.lit(RECORD))


def _listed(head: Column, values: Column, clean: Callable[[Column], Column]) -> Column:
    """A record of ``head`` and any number of values."""
    cells = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.coalesce(clean(v), F.lit("")))
    return F.concat(F.array_join(F.concat(F.array(head), cells), FIELD), F.lit(RECORD))


def _leaf_records(block: Column, clean: Callable[[Column], Column]) -> Column:
    kind = block["type"]
    links = F.array_join(F.transform(F.coalesce(block["links"], F.array().cast(f"array<{LINK}>")), lambda x: _record("LINK", clean(x["text"]), x["href"])), "")
    columns = F.when(F.size(block["header"]) > 0, F.size(block["header"])).when(F.size(block["rows"]) > 0, F.size(block["rows"][0])).otherwise(0)
    header = F.when(F.size(block["header"]) > 0, _listed(F.lit("TH"), block["header"], clean)).otherwise("")
    rows = F.array_join(F.transform(F.coalesce(block["rows"], F.array().cast("array<array<string>>")), lambda r: _listed(F.lit("TR"), r, clean)), "")
    listed = F.concat_ws(FIELD, F.lit("LIST"), F.when(block["ordered"], "1").otherwise("0"), F.coalesce(block["depth"].cast("string"), F.lit("")), F.coalesce(block["start"].cast("string"), F.lit("")))
    return (
        F.when(kind == "heading", _record("H", block["level"].cast("string"), clean(block["text"])))
        .when(kind == "paragraph", F.concat(_record("P", clean(block["text"])), links))
        .when(kind == "list", _listed(listed, block["items"], clean))
        .when(kind == "table", F.concat(_record("TABLE", clean(block["caption"]), columns.cast("string")), header, rows, _record("ENDTABLE")))
        .when((kind == "image") & (block["role"] != "decorative"), _record("IMG", clean(block["alt"]), clean(block["caption"])))
        .otherwise("")
    )


def title_record(title: Column, compose_unicode: bool = False) -> Column:
    """The canonical string of a document without blocks."""
    return _record("DOC", hash_text(title, compose_unicode))


def block_records(blocks: Column) -> Column:
    """A record per block in order, as they stand in the canonical string."""

    def clean(text: Column) -> Column:
        return hash_text(text, compose_unicode=False)

    def records(block: Column) -> Column:
        pair = F.concat(_record("FAQ", clean(block["question"])), F.array_join(F.transform(block["answer"], lambda a: _leaf_records(a, clean)), ""), _record("ENDFAQ"))
        return F.when(block["type"] == "faq_pair", pair).otherwise(_leaf_records(block, clean))

    return F.array_join(F.transform(F.coalesce(blocks, F.array().cast(BLOCKS)), records), "")


def serialize(title: Column, blocks: Column, compose_unicode: bool = False) -> Column:
    """The canonical string of a document: its title, then a record per block in order.

    Decorative images add nothing; a null field is empty. Composition runs in Python and cannot
    stand inside the lambdas of an array, so texts are composed where blocks are made (``parse_blocks``
    with ``compose_unicode``, HTML conversion); ``compose_unicode`` here is for the title.
    """
    return F.concat(title_record(title, compose_unicode), block_records(blocks))


def document_hash(title: Column, blocks: Column) -> Column:
    return digest(serialize(title, blocks, compose_unicode=True))


def render(block: Column) -> Column:
    """The plain text of one leaf block."""
    rows = F.when(F.size(block["header"]) > 0, F.concat(F.array(block["header"]), F.coalesce(block["rows"], F.array().cast("array<array<string>>")))).otherwise(block["rows"])
    table = F.array_join(F.transform(rows, lambda r: F.array_join(r, " | ", "")), "\n")
    kind = block["type"]
    return F.coalesce(
        F.when(kind.isin("heading", "paragraph"), block["text"]).when(kind == "list", F.array_join(block["items"], "\n")).when(kind == "table", table).when(kind == "image", block["alt"]),
        F.lit(""),
    )


def render_pair(block: Column) -> Column:
    """A question, a line feed and the answer's non-empty texts; the question alone without an answer."""
    texts = F.filter(F.transform(F.coalesce(block["answer"], F.array().cast(f"array<{LEAF}>")), render), lambda t: t != "")
    return F.when(F.size(texts) > 0, F.concat(F.coalesce(block["question"], F.lit("")), F.lit("\n"), F.array_join(texts, "\n"))).otherwise(F.coalesce(block["question"], F.lit("")))


def has_text(block: Column) -> Column:
    """Whether a block says anything; a table counts with any header or row, a pair always."""
    kind = block["type"]
    return (
        F.when(kind.isin("heading", "paragraph"), F.coalesce(F.trim(block["text"]) != "", F.lit(False)))
        .when(kind == "list", F.coalesce(F.exists(block["items"], lambda i: F.trim(i) != ""), F.lit(False)))
        .when(kind == "table", (F.size(block["header"]) > 0) | (F.size(block["rows"]) > 0))
        .when(kind == "image", F.coalesce(F.trim(block["alt"]) != "", F.lit(False)))
        .otherwise(kind == "faq_pair")
    )


# The JSON fields of each kind of block.
JSON_FIELDS = {
    "heading": {"level": int, "text": str},
    "paragraph": {"text": str, "links": list},
    "list": {"ordered": bool, "items": list, "depth": int, "start": (int, type(None))},
    "table": {"header": list, "rows": list, "caption": (str, type(None))},
    "image": {"src": str, "alt": str, "caption": (str, type(None)), "role": str},
    "faq_pair": {"question": str, "answer": list},
}
_NAMES = [f.split(":")[0] for f in ("type", "level", "text", "links", "ordered", "items", "depth", "start", "header", "rows", "caption", "src", "alt", "role")]


def _typed(value: object, kind: object) -> bool:
    return isinstance(value, kind) and not (isinstance(value, bool) and kind in (int, (int, type(None))))


def parse_block(value: object, nested: bool = False) -> dict:
    """One JSON block with every field of the schema; ValueError where it is not exactly one."""
    if not isinstance(value, dict) or value.get("type") not in JSON_FIELDS or (nested and value["type"] == "faq_pair"):
        raise ValueError("unknown block")
    fields = JSON_FIELDS[value["type"]]
    if not set(fields) <= set(value) or not all(_typed(value[k], t) for k, t in fields.items()):
        raise ValueError("wrong field")
    block = dict.fromkeys(_NAMES if nested else [*_NAMES, "question", "answer"])
    block |= {"type": value["type"]} | {k: value[k] for k in fields}
    strings = [*(value.get("items") or []), *(value.get("header") or []), *(c for r in value.get("rows") or [] for c in r)]
    if not all(isinstance(s, str) for s in strings):
        raise ValueError("wrong item")
    if value["type"] == "paragraph" and not all(isinstance(x, dict) and isinstance(x.get("text"), str) and isinstance(x.get("href"), str) for x in value["links"]):
        raise ValueError("wrong link")
    if value["type"] == "faq_pair":
        block["answer"] = [parse_block(a, nested=True) for a in value["answer"]]
    return block


def _composed(value: object) -> object:
    if isinstance(value, str):
        return compose(value)
    if isinstance(value, list):
        return [_composed(x) for x in value]
    return {k: _composed(x) for k, x in value.items()} if isinstance(value, dict) else value


def _strict(text: object, compose_unicode: bool) -> tuple[list[dict] | None, str | None]:
    try:
        value = json.loads(text) if isinstance(text, str) else None
        if not isinstance(value, list):
            raise ValueError("no array of blocks")
        if compose_unicode and not (text.isascii() and "\\u" not in text):
            value = _composed(value)
        return [parse_block(b) for b in value], None
    except (ValueError, TypeError, RecursionError) as error:
        return None, str(error)[:200] or type(error).__name__


def parse_blocks(text: Column | str, compose_unicode: bool = False) -> Column:
    """``struct<blocks, problem>``: strict JSON to blocks, with the problem in place of blocks for a row that is none; strings in NFC if wanted."""

    @F.pandas_udf(f"struct<blocks:{BLOCKS},problem:string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = [_strict(t, compose_unicode) for t in texts]
        return pd.DataFrame({"blocks": [r[0] for r in rows], "problem": [r[1] for r in rows]})

    return run(text)


def blocks_json(blocks: Column) -> Column:
    """Blocks as JSON; fields that a kind lacks are null and left out."""
    return F.to_json(blocks)
