"""Pages composed from relational sections, and records built from posts and datasets.

A page is declared as sections of steps; the declaration compiles to one DataFrame plan: a chain of
left joins for the sections, ordered arrays for their lists, and a concatenation of block arrays.
Nothing loops over rows, and a section without its row is missing, never an error.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.blocks import BLOCK, BLOCKS, LEAF, block_records, document_hash, has_text, title_record
from corpusmill.functions.markup import html_blocks
from corpusmill.functions.text import composed, content_text, digest, hash_text, headed, paragraphs
from corpusmill.functions.urls import canonical_url
from corpusmill.operators.hierarchy import ListSpec, ordered_children
from corpusmill.operators.synchronize import acceptance_gate, raw_gate

# --- blocks from columns -------------------------------------------------------------------


def make_block(kind: str, leaf: bool = False, **fields: Column) -> Column:
    """A block with every field of the schema, absent ones null."""
    schema = T.StructType.fromDDL((LEAF if leaf else BLOCK).removeprefix("struct<").removesuffix(">"))
    given = {"type": F.lit(kind)} | fields
    return F.struct(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def no_blocks() -> Column:
    return F.array().cast(BLOCKS)


def only_if(condition: Column, block: Column) -> Column:
    """The block as an array, or none."""
    return F.when(F.coalesce(condition, F.lit(False)), F.array(block)).otherwise(no_blocks())


def heading(text: Column, level: int = 2) -> Column:
    return only_if(text != "", make_block("heading", level=F.lit(level), text=text))


def paragraph(text: Column) -> Column:
    return only_if(text != "", make_block("paragraph", text=text, links=F.array()))


def bullets(values: Column) -> Column:
    """One unordered list; empty items go, equal ones are kept once."""
    kept = F.array_distinct(F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: v != ""))
    return only_if(F.size(kept) > 0, make_block("list", ordered=F.lit(False), items=kept, depth=F.lit(0)))


def pair(question: Column, answer: Column) -> Column:
    """A question with its answer as one paragraph; a half pair is none."""
    body = F.array(make_block("paragraph", leaf=True, text=answer, links=F.array()))
    return only_if((question != "") & (answer != ""), make_block("faq_pair", question=question, answer=body))


def grid(rows: Column, header: tuple[str, ...] = ()) -> Column:
    """A table of rows of cells; rows without text go, a table without rows is none."""
    kept = F.filter(F.coalesce(rows, F.array().cast("array<array<string>>")), lambda r: F.exists(r, lambda c: c != ""))
    head = F.array(*map(F.lit, header)).cast("array<string>")
    return only_if(F.size(kept) > 0, make_block("table", header=head, rows=kept))


# --- declarations --------------------------------------------------------------------------


@dataclass(frozen=True)
class Step:
    """What a section shows next.

    ``kind``: heading, paragraph, fixed and fixed_heading (approved text), items, cards, pairs, table, image or
    item_images (an image per item of a list).
    ``field``: the section's column, or the name of one of its lists. ``parts``: for cards the
    columns of heading and paragraph; for pairs question and answer; for a table its columns; for
    items the one column. ``nested``: for cards the item's own list and its column.
    """

    kind: str
    field: str = ""
    parts: tuple[str, ...] = ()
    nested: tuple[str, str] | None = None
    level: int = 2
    text: str = ""
    header: tuple[str, ...] = ()


@dataclass(frozen=True)
class Section:
    """``link``: the page's column with the section's id; None takes the first row of the table by id."""

    name: str
    table: str
    fields: tuple[str, ...]
    steps: tuple[Step, ...]
    lists: tuple[ListSpec, ...] = ()
    link: str | None = None
    whole_lists: tuple[ListSpec, ...] = ()
    table_id: str = "id"


@dataclass(frozen=True)
class Page:
    scope: str
    content_type: str
    base: str
    table: str
    slug: str
    title: str
    sections: tuple[Section, ...]
    page_id: str = "id"
    published: str | None = None
    extractor_version: int = 1
    #: (table, column, value): texts that stand for nothing in that one column
    placeholders: tuple[tuple[str, str, str], ...] = ()


def tidied(df: DataFrame) -> DataFrame:
    """Text columns in content normal form, null as empty; one Arrow pass at most, none for ASCII."""
    return df.withColumns({f.name: F.coalesce(content_text(F.col(f.name)), F.lit("")) for f in df.schema.fields if isinstance(f.dataType, T.StringType)})


def _lists(tables: Mapping[str, DataFrame], spec: ListSpec) -> DataFrame:
    child = tables[spec.child].select(F.col(spec.child_id).alias(spec.child_key), *spec.fields)
    parts = [F.col(f) for f in spec.fields]
    if spec.nested:
        child = child.join(_lists(tables, spec.nested).withColumnRenamed(spec.nested.parent_key, spec.child_key), spec.child_key, "left")
        parts.append(F.col(spec.nested.name))
    link = tables[spec.link].select(*dict.fromkeys([spec.parent_key, spec.child_key, *spec.order]))
    return ordered_children(link.join(child, spec.child_key), spec.parent_key, spec.order, F.struct(*parts), spec.name)


def _step_blocks(step: Step, row: Column) -> Column:
    cell = row[step.field] if step.field else F.lit("")
    if step.kind == "heading":
        return heading(cell, step.level)
    if step.kind == "paragraph":
        return paragraph(cell)
    if step.kind == "fixed":
        return paragraph(F.lit(step.text))
    if step.kind == "fixed_heading":
        return heading(F.lit(step.text), step.level)
    if step.kind == "items":
        return bullets(F.transform(cell, lambda i: i[step.parts[0]]))
    if step.kind == "table":
        return grid(F.transform(cell, lambda i: F.array(*[i[p].cast("string") for p in step.parts])), step.header)
    if step.kind == "pairs":
        return F.flatten(F.transform(F.coalesce(cell, F.array()), lambda i: pair(i[step.parts[0]], i[step.parts[1]])))
    if step.kind == "cards":

        def card(item: Column) -> Column:
            own = [heading(item[step.parts[0]], step.level), *[paragraph(item[p]) for p in step.parts[1:]]]
            if step.nested:
                own.append(bullets(F.transform(item[step.nested[0]], lambda n: n[step.nested[1]])))
            return F.concat(*own)

        return F.coalesce(F.flatten(F.transform(cell, card)), no_blocks())
    return no_blocks()


def _image_of(section: str, column: str):
    return lambda item: F.struct(F.lit(section).alias("section"), item[column].alias("src"))


def _images(section: Section, row: Column) -> Column:
    none = F.array().cast("array<struct<section:string,src:string>>")
    parts = [F.array(F.struct(F.lit(section.name).alias("section"), row[s.field].alias("src"))) for s in section.steps if s.kind == "image"]
    parts += [F.coalesce(F.transform(row[s.field], _image_of(section.name, s.parts[0])), none) for s in section.steps if s.kind == "item_images"]
    return F.filter(F.concat(none, *parts), lambda i: i["src"] != "") if parts else none


def compose_pages(tables: Mapping[str, DataFrame], page: Page) -> DataFrame:
    """(canonical_uri, title, blocks, content_hash, missing_sections, images, source_scope, content_type, source_ref, extractor_version, reason).

    ``reason`` is why a page is refused, or null: a slug that makes no URL, or the first failure of
    the acceptance gate. Pages that are not published are left out. Sections appear in declared
    order; a null or dangling link leaves a section out and names it in ``missing_sections``.

    A section's blocks and their part of the canonical string are made once for each of its rows, before
    pages join it, and no Python runs over whole pages: rows that wait for Python are kept on disk.
    """
    clean = {name: tidied(df) for name, df in tables.items()}
    for table, column, value in page.placeholders:
        clean[table] = clean[table].withColumn(column, F.when(F.col(column) == value, "").otherwise(F.col(column)))
    links = [s.link for s in page.sections if s.link]
    pages = clean[page.table].where(page.published) if page.published else clean[page.table]
    pages = pages.select(F.col(page.page_id).alias("__page"), canonical_url(F.col(page.slug), page.base).alias("__uri"), F.col(page.title).alias("title"), hash_text(F.col(page.title)).alias("__title"), *dict.fromkeys(links))
    for section in page.sections:
        own = clean[section.table].select(F.col(section.table_id).alias("__sid"), *section.fields)
        for spec in section.lists:
            own = own.join(_lists(clean, spec).withColumnRenamed(spec.parent_key, "__sid"), "__sid", "left")
        for spec in section.whole_lists:
            # the page shows the whole table as one list, so this is a single row
            every = ordered_children(clean[spec.child].withColumn("__one", F.lit(1)), "__one", spec.order, F.struct(*spec.fields), spec.name)
            own = own.withColumn("__one", F.lit(1)).join(F.broadcast(every), "__one", "left").drop("__one")
        names = [*section.fields, *[s.name for s in (*section.lists, *section.whole_lists)]]
        body = F.struct(*names) if names else F.struct("__sid")
        made = _made(own.select("__sid", body.alias("__row")) if section.link else own.agg(F.min_by(body, "__sid").alias("__row")), section)
        if section.link:
            pages = pages.join(made.withColumnRenamed("__sid", section.link), section.link, "left")
        else:
            pages = pages.withColumn("__one", F.lit(1)).join(F.broadcast(made.withColumn("__one", F.lit(1))), "__one", "left").drop("__one")
    each = lambda part, default: [F.coalesce(f"__{s.name}_{part}", default) for s in page.sections]
    out = pages.withColumn("blocks", F.concat(no_blocks(), *each("blocks", no_blocks())))
    out = out.withColumn("missing_sections", F.array_compact(F.array(*[F.when(F.col(f"__{s.name}_there").isNull(), F.lit(s.name)) for s in page.sections])))
    out = out.withColumn("images", F.concat(*each("images", F.array().cast("array<struct<section:string,src:string>>"))))
    out = out.withColumn("canonical_uri", F.col("__uri")).withColumn("extractor_version", F.lit(page.extractor_version))
    text = digest(F.concat(title_record(F.col("__title")), *each("text", F.lit(""))))
    filled = F.filter(F.array(*each("count", F.lit(0))), lambda n: n > 0)
    says = reduce(lambda x, y: x | y, each("says", F.lit(False)))
    return _finished(out, page.scope, page.content_type, F.concat(F.lit(page.table + "#"), F.col("__page").cast("string")), ["missing_sections", "images"], known=(text, filled, says))


def _made(rows: DataFrame, section: Section) -> DataFrame:
    """What every row of a section, in ``__row``, gives its pages; a section that is not there is null in all of it."""
    row = F.col("__row")
    there = F.when(row.isNotNull(), F.lit(True))
    rows = rows.withColumn("__blocks", F.when(there, F.concat(no_blocks(), *[_step_blocks(step, row) for step in section.steps])))
    parts = {
        "there": there,
        "blocks": F.col("__blocks"),
        "text": F.when(there, block_records(F.col("__blocks"))),
        "count": F.when(there, F.size("__blocks")),
        "says": F.exists("__blocks", has_text),
        "images": _images(section, row),
    }
    return rows.select(*[c for c in rows.columns if c == "__sid"], *[value.alias(f"__{section.name}_{part}") for part, value in parts.items()])


def _finished(rows: DataFrame, scope: str, content_type: str, source_ref: Column, extra: list[str], refused: Column | None = None, known: tuple[Column, Column, Column] | None = None) -> DataFrame:
    """Records with their hash and the reason they are refused for.

    ``known``: the hash, an array that is empty if there are no blocks, and whether any says something, where these were made without the blocks.
    """
    content_hash, filled, says = known or (document_hash(F.col("title"), F.col("blocks")), F.col("blocks"), F.exists("blocks", has_text))
    gate = acceptance_gate(F.col("canonical_uri"), F.col("canonical_uri"), F.col("title"), filled, says, F.col("extractor_version"))
    reason = F.when(F.col("canonical_uri").isNull(), "unusable_identity")
    if refused is not None:
        reason = reason.when(refused.isNotNull(), refused)
    return rows.select(
        "canonical_uri",
        "title",
        "blocks",
        content_hash.alias("content_hash"),
        *extra,
        F.lit(scope).alias("source_scope"),
        F.lit(content_type).alias("content_type"),
        source_ref.alias("source_ref"),
        "extractor_version",
        F.coalesce(reason, gate).alias("reason"),
    )


def question_label(blocks: Column) -> Column:
    """The words of headings, paragraphs and list items of a question field, joined by blanks."""
    words = F.transform(blocks, lambda b: F.when(b["type"].isin("heading", "paragraph"), b["text"]).when(b["type"] == "list", F.array_join(b["items"], " ")))
    return F.trim(F.regexp_replace(F.array_join(F.filter(words, lambda w: w != ""), " "), r"\s+", " "))


def post_records(posts: DataFrame, base: str, scope: str = "blog", extractor_version: int = 2, slots: int = 0, least: int | None = None) -> DataFrame:
    """Records of posts (id, url, title, html, and question and answer columns of ``slots`` pairs).

    The raw gate comes first: placeholder, empty body, too short. Bodies become blocks, then each
    slot whose two sides say something becomes a pair; ``half_pairs`` counts the others with one.
    """
    rows = posts.withColumn("__r", html_blocks(F.col("html"), base))
    pairs, half = no_blocks(), F.lit(0)
    for n in range(1, slots + 1):
        rows = rows.withColumn(f"__q{n}", html_blocks(F.col(f"question{n}"), base)["blocks"]).withColumn(f"__a{n}", html_blocks(F.col(f"answer{n}"), base)["blocks"])
        label = F.coalesce(question_label(F.col(f"__q{n}")), F.lit(""))
        leaf = T.StructType.fromDDL(LEAF.removeprefix("struct<").removesuffix(">"))
        answer = F.transform(F.coalesce(f"__a{n}", no_blocks()), lambda b: F.struct(*[b[f.name].alias(f.name) for f in leaf.fields]))
        says = F.exists(F.coalesce(f"__a{n}", no_blocks()), has_text)
        pairs = F.concat(pairs, only_if((label != "") & says, make_block("faq_pair", question=label, answer=answer)))
        half = half + F.when((label != "") != says, 1).otherwise(0)
    rows = rows.withColumn("blocks", F.concat(F.coalesce(F.col("__r.blocks"), no_blocks()), pairs)).withColumn("half_pairs", half).withColumn("counters", F.col("__r.counters"))
    refused = raw_gate(F.col("url"), F.col("title"), F.col("html"), F.lit("mysql"), least)
    rows = rows.withColumn("__refused", refused).withColumn("canonical_uri", canonical_url(F.col("url"), base)).withColumn("title", F.coalesce(content_text(F.col("title")), F.lit("")))
    rows = rows.withColumn("extractor_version", F.lit(extractor_version))
    return _finished(rows, scope, "blog", F.concat(F.lit("post#"), F.col("id").cast("string")), ["half_pairs", "counters"], F.col("__refused"))


def pair_list_records(faq: DataFrame, scope: str = "service_faq", suffix: str = " — FAQ", extractor_version: int = 1) -> DataFrame:
    """Records of exported pair lists (dictionary_name, faq_key, parent_canonical_uri, parent_title, pairs).

    A record's page is its parent's with the fragment ``faq``; half pairs are counted and left out.
    """
    # composed in one pass as JSON; folding waits for the single texts, as quotes would not survive it here
    tidy = faq.withColumn("__pairs", F.from_json(composed(F.to_json("pairs")), "array<struct<question:string,answer:string>>"))
    clean = lambda text: F.coalesce(content_text(text, compose_unicode=False), F.lit(""))
    own = F.coalesce("__pairs", F.array().cast("array<struct<question:string,answer:string>>"))
    blocks = F.flatten(F.transform(own, lambda p: pair(clean(p["question"]), clean(p["answer"]))))
    rows = tidy.withColumn("blocks", F.coalesce(blocks, no_blocks()))
    rows = rows.withColumn("half_pairs", F.size(own) - F.size("blocks"))
    rows = rows.withColumn("canonical_uri", canonical_url(F.concat("parent_canonical_uri", F.lit("#faq"))))
    rows = rows.withColumn("title", content_text(F.concat("parent_title", F.lit(suffix)))).withColumn("extractor_version", F.lit(extractor_version))
    return _finished(rows, scope, "faq", F.concat_ws(":", "dictionary_name", "faq_key"), ["half_pairs"])


def described_image_records(images: DataFrame, prefix: str, scope: str = "image_descriptions", extractor_version: int = 1) -> DataFrame:
    """Records of described images (image_key, framework, title_in_image, summary_clean, description_clean).

    A heading of framework and printed title, the summary, and the description's paragraphs.
    """
    rows = tidied(images.select("image_key", "framework", "title_in_image", "summary_clean", F.col("description_clean").alias("__body").cast("binary")))
    rows = rows.withColumn("__body", F.col("__body").cast("string"))
    head = F.when(F.col("title_in_image") == "", F.col("framework")).when(F.col("framework") == "", F.col("title_in_image")).otherwise(headed(F.col("framework"), F.col("title_in_image")))
    parts = F.transform(paragraphs(F.coalesce("__body", F.lit(""))), lambda p: content_text(p, compose_unicode=False))
    body = F.transform(F.filter(parts, lambda p: p != ""), lambda p: make_block("paragraph", text=p, links=F.array()))
    rows = rows.withColumn("blocks", F.concat(heading(head), paragraph(F.col("summary_clean")), F.coalesce(body, no_blocks())))
    rows = rows.withColumn("canonical_uri", canonical_url(F.concat(F.lit(prefix), F.col("image_key")))).withColumn("extractor_version", F.lit(extractor_version))
    rows = rows.withColumn("title", F.when(F.col("title_in_image") != "", F.col("title_in_image")).otherwise(F.col("framework")))
    return _finished(rows, scope, "image", F.col("image_key"), [])


def union_records(parts: list[DataFrame]) -> DataFrame:
    """Records of several adapters as one delivery; fields that only some have are null in the others."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
