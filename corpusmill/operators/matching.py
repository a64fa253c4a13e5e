"""Matching entities by name, walking ancestors, comparing states and scanning schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import file_name, file_stem, folded_name_forms
from corpusmill.scratch import durable

# The tiers of a match by name, strongest first.
TIERS = ("exact", "stem", "folded", "truncated")


def name_matches(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_name: str, right_name: str, least_prefix: int = 12) -> DataFrame:
    """(left_id, right_id, tier): the strongest tier by which two names match.

    exact: equal names; stem: equal without extension; folded: equal with separators folded;
    truncated: one folded name of at least ``least_prefix`` characters begins the other. Names are
    compared in lower case; null and empty names match nothing.

    Every tier is an equi-join: the first three on the form itself, the last on a prefix of fixed
    length followed by a check, so nothing is compared with everything. Names that many rows share
    should be given once, as classes with their numbers of members; ``name_links`` counts without pairs.
    """

    def forms(df: DataFrame, key: str, name: str, side: str) -> DataFrame:
        low = F.lower(F.trim(F.substring_index(F.col(name), "/", -1)))
        stem = F.regexp_replace(low, r"\.[a-z0-9]{1,5}$", "")
        folded = F.trim(F.regexp_replace(stem, r"[\s_\-.]+", " "))
        return df.where(low != "").select(F.col(key).alias(side), low.alias("exact"), stem.alias("stem"), folded.alias("folded"))

    a, b = forms(left, left_id, left_name, "__a"), forms(right, right_id, right_name, "__b")
    found = None
    for tier, name in enumerate(TIERS[:3]):
        part = a.select("__a", F.col(name).alias("form")).join(b.select("__b", F.col(name).alias("form")), "form").where("form <> ''").select("__a", "__b", F.lit(tier).alias("tier"))
        found = part if found is None else found.unionByName(part)
    head = F.substring("folded", 1, least_prefix)
    long_a = a.where(F.length("folded") >= least_prefix).select("__a", F.col("folded").alias("fa"), head.alias("head"))
    long_b = b.where(F.length("folded") >= least_prefix).select("__b", F.col("folded").alias("fb"), head.alias("head"))
    begun = long_a.join(long_b, "head").where(F.col("fa").startswith(F.col("fb")) | F.col("fb").startswith(F.col("fa"))).select("__a", "__b", F.lit(3).alias("tier"))
    best = found.unionByName(begun).groupBy("__a", "__b").agg(F.min("tier").alias("tier"))
    return best.select(F.col("__a").alias(left_id), F.col("__b").alias(right_id), F.element_at(F.array(*map(F.lit, TIERS)), F.col("tier") + 1).alias("tier"))


def file_matches(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_path: str, right_path: str, least_prefix: int = 20) -> DataFrame:
    """(left_id, right_id, tier): the strongest tier by which the file names of two paths match.

    exact: equal names, percent-decoded; stem: equal without extension; folded: the names have a
    folded form in common, with or without a storage suffix (a suffix of seven characters cannot be
    told from a word of seven letters, so both count); truncated: a folded form of at least
    ``least_prefix`` characters begins one of the other name. The case counts in the first two tiers
    only. Null and empty names match nothing. Each tier is an equi-join of exploded forms; the last
    joins whole forms with the beginnings of the other side's. All pairs are made: this is for one
    stated set of files; ``file_links`` counts links of whole tables.
    """

    def names(df: DataFrame, key: str, path: str, side: str) -> DataFrame:
        named = df.select(F.col(key).alias(side), file_name(F.col(path)).alias("exact")).where("exact <> ''")
        return named.select(side, "exact", file_stem(F.col("exact")).alias("stem"), folded_name_forms(F.col("exact")).alias("folded"))

    def begun(df: DataFrame, side: str) -> DataFrame:
        ends = F.sequence(F.lit(least_prefix), F.length("form") - 1)
        return df.where(F.length("form") > least_prefix).select(side, F.explode(F.transform(ends, lambda n: F.substring(F.col("form"), F.lit(1), n))).alias("form"))

    a, b = names(left, left_id, left_path, "__a"), names(right, right_id, right_path, "__b")
    forms_a, forms_b = (df.select(side, F.explode("folded").alias("form")) for df, side in ((a, "__a"), (b, "__b")))
    pairs = [(a.select("__a", F.col(t).alias("form")), b.select("__b", F.col(t).alias("form")), n) for n, t in enumerate(TIERS[:2])]
    pairs += [(forms_a, forms_b, 2), (begun(forms_a, "__a"), forms_b, 3), (forms_a, begun(forms_b, "__b"), 3)]
    found = None
    for one, other, tier in pairs:
        part = one.where("form <> ''").join(other, "form").select("__a", "__b", F.lit(tier).alias("tier"))
        found = part if found is None else found.unionByName(part)
    best = found.groupBy("__a", "__b").agg(F.min("tier").alias("tier"))
    return best.select(F.col("__a").alias(left_id), F.col("__b").alias(right_id), F.element_at(F.array(*map(F.lit, TIERS)), F.col("tier") + 1).alias("tier"))


def name_links(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_name: str, right_name: str) -> DataFrame:
    """(left_id, pages): how many names of the right side each name matches exactly, by stem or folded, see ``name_matches``.

    Equal names have equal stems and equal stems one folded form, so the widest form that a name has
    decides; its copies on the right are counted once and never paired, however common the name.
    """

    def widest(df: DataFrame, key: str, name: str, side: str) -> DataFrame:
        low = F.lower(F.trim(F.substring_index(F.col(name), "/", -1)))
        stem = F.regexp_replace(low, r"\.[a-z0-9]{1,5}$", "")
        folded = F.trim(F.regexp_replace(stem, r"[\s_\-.]+", " "))
        form = F.when(folded != "", F.concat(F.lit("f"), folded)).when(stem != "", F.concat(F.lit("s"), stem)).when(low != "", F.concat(F.lit("e"), low))
        return df.select(F.col(key).alias(side), form.alias("form"))

    counts = widest(right, right_id, right_name, "__b").where("form is not null").groupBy("form").agg(F.count_distinct("__b").alias("pages"))
    return widest(left, left_id, left_name, "__a").join(counts, "form", "left").select(F.col("__a").alias(left_id), F.coalesce("pages", F.lit(0)).alias("pages"))


def file_links(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_path: str, right_path: str, least_prefix: int = 20) -> DataFrame:
    """(left_id, name, forms, exact, stem, folded, truncated): per left file its classes and its numbers of links, by the tiers of ``file_matches``.

    ``name`` and ``forms`` are the classes it belongs to: files of equal name, and of a folded form
    in common. The numbers count files of the right side by each tier's own condition, so a closer
    tier is part of the wider ones; ``truncated`` counts folded forms of right files of which one
    begins the other. Rows repeated on a side count once. Counts are taken per class before they
    meet the other side, so no pair is ever made, however common a name is; beginnings are counted
    per form, not per file.
    """

    def named(df: DataFrame, key: str, path: str) -> DataFrame:
        files = df.select(F.col(key).alias("id"), file_name(F.col(path)).alias("name")).distinct().where("id is not null")
        known = files.where("name <> ''")
        return known.select("id", "name", file_stem(F.col("name")).alias("stem"), F.array_sort(folded_name_forms(F.col("name"))).alias("forms"))

    a, b = named(left, left_id, left_path), named(right, right_id, right_path)
    exact = b.groupBy("name").agg(F.count_distinct("id").alias("exact"))
    stem = b.where("stem <> ''").groupBy("stem").agg(F.count_distinct("id").alias("by_stem"))
    form = b.select("id", F.explode("forms").alias("form")).groupBy("form").agg(F.count_distinct("id").alias("n"))
    both = b.where(F.size("forms") == 2).groupBy(F.col("forms").alias("pair")).agg(F.count_distinct("id").alias("twice"))
    every = a.select(F.explode("forms").alias("form")).distinct()

    def begun(forms: DataFrame) -> DataFrame:
        """Forms with their proper beginnings."""
        ends = F.sequence(F.lit(least_prefix), F.length("form") - 1)
        return forms.where(F.length("form") > least_prefix).select("*", F.explode(F.transform(ends, lambda n: F.substring(F.col("form"), F.lit(1), n))).alias("head"))

    longer = begun(form).groupBy("head").agg(F.sum("n").alias("longer")).withColumnRenamed("head", "form")
    shorter = begun(every).join(form.select(F.col("form").alias("head"), "n"), "head").groupBy("form").agg(F.sum("n").alias("shorter"))
    reach = every.join(form, "form", "left").join(longer, "form", "left").join(shorter, "form", "left")
    count = lambda c: F.coalesce(c, F.lit(0))
    reach = reach.select("form", count("n").alias("n"), (count("longer") + count("shorter")).alias("cut"))
    per = a.select("id", "name", F.explode_outer("forms").alias("form")).join(reach, "form", "left").groupBy("id", "name").agg(F.sum(count("n")).alias("n"), F.sum(count("cut")).alias("cut"))
    joined = a.join(per, ["id", "name"]).join(exact, "name", "left").join(stem, "stem", "left").join(both, F.col("forms") == F.col("pair"), "left")
    return joined.select(
        F.col("id").alias(left_id), "name", "forms", count("exact").alias("exact"), count("by_stem").alias("stem"),
        (F.col("n") - F.when(F.size("forms") == 2, count("twice")).otherwise(0)).alias("folded"), F.col("cut").alias("truncated"),
    )


def status_of(pages: Column) -> Column:
    """matched with exactly one page, ambiguous with more, else unmatched."""
    return F.when(pages == 1, "matched").when(pages > 1, "ambiguous").otherwise("unmatched")


def ancestors(edges: DataFrame, start: DataFrame, levels: int | None = None) -> DataFrame:
    """(id, ancestor, depth, path): every node reached from ``start`` by (child, parent) edges, or those within ``levels`` steps.

    The walk goes up level by level, each an equi-join, until a level is empty; a path never visits
    a node twice, so cycles end. Every level is kept in the shared folder.
    """
    here = start.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("depth"), F.array("id").alias("path"))
    every, depth = here, 0
    while levels is None or depth < levels:
        depth += 1
        here = durable(
            here.join(edges.select(F.col("child").alias("ancestor"), "parent"), "ancestor")
            .where(~F.array_contains("path", F.col("parent")))
            .select("id", F.col("parent").alias("ancestor"), F.lit(depth).alias("depth"), F.concat("path", F.array("parent")).alias("path"))
        )
        if here.isEmpty():
            break
        every = every.unionByName(here)
    return every


def compare_sides(left: DataFrame, right: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, status): matches, differs, missing (left only) or extra (right only), by null-safe equality."""
    a = left.select(key, F.struct(*fields).alias("__a"))
    b = right.select(key, F.struct(*fields).alias("__b"))
    status = F.when(F.col("__b").isNull(), "missing").when(F.col("__a").isNull(), "extra").when(F.col("__a").eqNullSafe(F.col("__b")), "matches").otherwise("differs")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def state_transitions(before: DataFrame, after: DataFrame, key: str, state: str) -> DataFrame:
    """(key, before, after) where an item's state differs, items of one side only included."""
    both = before.select(key, F.col(state).alias("before")).join(after.select(key, F.col(state).alias("after")), key, "full_outer")
    return both.where(~F.col("before").eqNullSafe(F.col("after")))


def consensus(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) where all rows of a key agree on one value."""
    return rows.where(F.col(value).isNotNull()).groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("__top")).where(F.col(value) == F.col("__top")).drop("__top")


def best_status(rows: DataFrame, item: str, page: str, status: str, precedence: Sequence[str], fallback: str) -> DataFrame:
    """(item, status): an item's strongest status, if its rows of that status agree on one page; else ``fallback``."""
    place = F.array_position(F.array(*map(F.lit, precedence)), F.col(status))
    ranked = rows.where(place > 0).withColumn("__place", place)
    best = F.min("__place").over(Window.partitionBy(item))
    agreed = ranked.withColumn("__best", best).where("__place = __best").groupBy(item).agg(F.first(status).alias("status"), F.count_distinct(page).alias("__pages"))
    return agreed.select(item, F.when(F.col("__pages") <= 1, F.col("status")).otherwise(fallback).alias("status"))


def text_references(tables: dict[str, DataFrame], pattern: str, group: int = 0) -> DataFrame:
    """(table_name, column_name, reference, rows): every match of ``pattern`` in every string column of every table.

    Columns are unpivoted in the scan and filtered before anything is exploded.
    """
    found = None
    for name, df in sorted(tables.items()):
        texts = [c for c, kind in df.dtypes if kind == "string"]
        if not texts:
            continue
        cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("cell")) for c in texts])
        flat = df.select(F.explode(F.filter(cells, lambda s: s["cell"].rlike(pattern))).alias("s")).select(
            F.lit(name).alias("table_name"), "s.column_name", F.explode(F.regexp_extract_all("s.cell", F.lit(pattern), F.lit(group))).alias("reference")
        )
        found = flat if found is None else found.unionByName(flat)
    if found is None:
        raise ValueError("no table with text")
    return found.groupBy("table_name", "column_name", "reference").agg(F.count("*").alias("rows"))


def inventory_problems(have: DataFrame, want: DataFrame, key: str) -> DataFrame:
    """(problem, key): keys had more than once, wanted and not had, had and not wanted."""
    repeated = have.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(F.lit("repeated").alias("problem"), key)
    missing = want.select(key).distinct().join(have, key, "left_anti").select(F.lit("missing").alias("problem"), key)
    extra = have.select(key).distinct().join(want, key, "left_anti").select(F.lit("extra").alias("problem"), key)
    return repeated.unionByName(missing).unionByName(extra)


def reachable(datasets: DataFrame, pages: DataFrame, key: str, slug: str, order: str) -> DataFrame:
    """Dataset entries whose key is the lower-case slug of a page, in page order."""
    own = pages.select(F.lower(F.col(slug)).alias(key), F.col(order).alias("page_order"))
    return datasets.join(own, key)


def has_column(df: DataFrame, name: str) -> Column:
    """The column, or null where a table lacks it."""
    return F.col(name) if name in df.columns else F.lit(None)
