"""Hierarchical joins: ordered children through links, nested levels and absent sections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered_children(rows: DataFrame, parent: str, order: Sequence[str], value: Column, name: str = "items") -> DataFrame:
    """(parent, name): each parent's values as an array in the given order, nulls dropped, copies kept.

    The order columns travel inside the array, so the grouping needs no sort across the cluster.
    """
    entry = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], value.alias("v"))
    gathered = F.array_sort(F.collect_list(F.when(value.isNotNull(), entry)))
    return rows.groupBy(parent).agg(F.transform(gathered, lambda e: e["v"]).alias(name))


def linked_items(link: DataFrame, child: DataFrame, parent_key: str, child_key: str, order: Sequence[str], value: Column, child_id: str, name: str = "items") -> DataFrame:
    """Children reached through a link table, in link order; links without a child are dropped."""
    joined = link.join(child.withColumnRenamed(child_id, child_key), child_key)
    return ordered_children(joined, parent_key, order, value, name)


def distinct_in_order(items: Column) -> tuple[Column, Column]:
    """First occurrences, and how many copies went."""
    kept = F.array_distinct(items)
    return kept, F.size(items) - F.size(kept)


@dataclass(frozen=True)
class ListSpec:
    """A list of a section: link table, its keys, the child table and the fields of an item."""

    link: str
    parent_key: str
    child_key: str
    child: str
    fields: tuple[str, ...]
    child_id: str = "id"
    order: tuple[str, ...] = ("id",)
    name: str = "items"
    nested: ListSpec | None = None


@dataclass(frozen=True)
class SectionSpec:
    """A section of a page: its table, the page's key to it, its own fields and its lists."""

    name: str
    table: str
    key: str
    fields: tuple[str, ...] = ()
    lists: tuple[ListSpec, ...] = ()
    drop: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    table_id: str = "id"


@dataclass(frozen=True)
class PageSpec:
    table: str
    fields: tuple[str, ...]
    sections: tuple[SectionSpec, ...]
    page_id: str = "id"


def _list_frame(tables: Mapping[str, DataFrame], spec: ListSpec) -> DataFrame:
    """(parent key, name): items as structs of their fields, nested lists inside their item."""
    child = tables[spec.child].select(F.col(spec.child_id).alias(spec.child_key), *spec.fields)
    parts = [F.col(f) for f in spec.fields]
    if spec.nested:
        inner = _list_frame(tables, spec.nested).withColumnRenamed(spec.nested.parent_key, spec.child_key)
        child = child.join(inner, spec.child_key, "left")
        parts.append(F.coalesce(F.col(spec.nested.name), F.array()).alias(spec.nested.name))
    wanted = list(dict.fromkeys([spec.parent_key, spec.child_key, *spec.order]))
    link = tables[spec.link].select(*wanted)
    value = F.struct(*parts)
    return ordered_children(link.join(child, spec.child_key), spec.parent_key, spec.order, value, spec.name)


def assemble(tables: Mapping[str, DataFrame], spec: PageSpec) -> DataFrame:
    """Pages with a struct per section and ``missing_sections``; a null or dangling key is an absent section.

    The spec only declares; each section is one chain of left joins, and Spark chooses their kinds
    from the measured sizes.
    """
    page = tables[spec.table].select(spec.page_id, *spec.fields, *dict.fromkeys(s.key for s in spec.sections))
    for section in spec.sections:
        own = tables[section.table].select(F.col(section.table_id).alias("__sid"), *section.fields)
        for text, placeholders in section.drop.items():
            own = own.withColumn(text, F.when(~F.trim(F.col(text)).isin(*placeholders), F.col(text)))
        for spec_list in section.lists:
            own = own.join(_list_frame(tables, spec_list).withColumnRenamed(spec_list.parent_key, "__sid"), "__sid", "left")
        body = F.struct(*section.fields, *[F.col(x.name) for x in section.lists]) if section.fields or section.lists else F.struct(F.col("__sid").alias("id"))
        own = own.select(F.col("__sid").alias(section.key), body.alias(f"section_{section.name}"))
        page = page.join(own, section.key, "left")
    absent = F.array_compact(F.array(*[F.when(F.col(f"section_{s.name}").isNull(), F.lit(s.name)) for s in spec.sections]))
    return page.withColumn("missing_sections", absent)
