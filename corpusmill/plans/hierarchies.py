"""Queries over hierarchical joins, matching and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.text import name_forms
from corpusmill.operators import hierarchy, matching
from corpusmill.sources.tables import read_table


def left_join_metadata(spark: SparkSession, base: str) -> DataFrame:
    customer = read_table(spark, base, "customer", ["c_custkey", "c_nationkey", "c_mktsegment"])
    nation = read_table(spark, base, "nation", ["n_nationkey", "n_name", "n_regionkey"]).where("n_regionkey < 3")
    segment = F.when(~F.col("c_mktsegment").isin("MACHINERY"), F.col("c_mktsegment"))
    return customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"], "left").select("c_custkey", "n_name", segment.alias("segment"))


def m2m_ordered_items(spark: SparkSession, base: str) -> DataFrame:
    link = read_table(spark, base, "lineitem", ["l_orderkey", "l_partkey", "l_linenumber"])
    part = read_table(spark, base, "part", ["p_partkey", "p_name"])
    items = hierarchy.linked_items(link, part, "l_orderkey", "l_partkey", ["l_linenumber", "l_partkey"], F.col("p_name"), "p_partkey")
    return items.select("l_orderkey", F.array_join("items", "|").alias("items"))


def distinct_items_dropped(spark: SparkSession, base: str) -> DataFrame:
    lines = read_table(spark, base, "lineitem", ["l_orderkey", "l_partkey", "l_linenumber"])
    items = hierarchy.ordered_children(lines, "l_orderkey", ["l_linenumber", "l_partkey"], F.col("l_linenumber").cast("string"))
    kept, gone = hierarchy.distinct_in_order(F.col("items"))
    return items.select("l_orderkey", F.array_join(kept, "|").alias("kept"), gone.alias("dropped"))


def category_two_level(spark: SparkSession, base: str) -> DataFrame:
    nation = read_table(spark, base, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    supplier = read_table(spark, base, "supplier", ["s_suppkey", "s_name", "s_nationkey"])
    inner = hierarchy.ordered_children(supplier, "s_nationkey", ["s_suppkey"], F.col("s_name"), "names").withColumnRenamed("s_nationkey", "n_nationkey")
    joined = nation.join(inner, "n_nationkey")
    line = F.concat(F.col("n_name"), F.lit("="), F.array_join("names", ","))
    return hierarchy.ordered_children(joined, "n_regionkey", ["n_nationkey"], line).select("n_regionkey", F.array_join("items", ";").alias("categories"))


def pages_assembled(spark: SparkSession, base: str) -> DataFrame:
    """Customers as pages whose one section, their nation, lists its suppliers; other nations' pages lack it."""
    tables = {
        "customer": read_table(spark, base, "customer", ["c_custkey", "c_name", "c_nationkey"]),
        "nation": read_table(spark, base, "nation", ["n_nationkey", "n_name", "n_regionkey"]).where("n_regionkey < 3"),
        "link": read_table(spark, base, "supplier", ["s_nationkey", "s_suppkey"]),
        "supplier": read_table(spark, base, "supplier", ["s_suppkey", "s_name"]).withColumnRenamed("s_suppkey", "id"),
    }
    items = hierarchy.ListSpec("link", "s_nationkey", "s_suppkey", "supplier", ("s_name",), order=("s_suppkey",))
    section = hierarchy.SectionSpec("nation", "nation", "c_nationkey", ("n_name",), (items,), {"n_name": ("NATION_5",)}, "n_nationkey")
    pages = hierarchy.assemble(tables, hierarchy.PageSpec("customer", ("c_name",), (section,), "c_custkey"))
    return pages.select(
        "c_custkey", "c_name", F.col("section_nation.n_name").alias("n_name"), F.array_join(F.transform("section_nation.items", lambda i: i["s_name"]), "|").alias("items"), F.array_join("missing_sections", "|").alias("missing_sections")
    )


def full_outer_compare(spark: SparkSession, base: str) -> DataFrame:
    customers = read_table(spark, base, "customer", ["c_nationkey"]).groupBy(F.col("c_nationkey").alias("k")).agg((F.count("*") % 4).alias("n"))
    suppliers = read_table(spark, base, "supplier", ["s_nationkey"]).where("s_nationkey <> 7").groupBy(F.col("s_nationkey").alias("k")).agg((F.count("*") % 4).alias("n"))
    return matching.compare_sides(customers, suppliers, "k", ["n"])


def _page_lists(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    """The page spellings delivered by the first and by the last run of each scope."""
    runs = read_table(spark, base, "runs", ["run_id", "source_scope"])
    ends = runs.groupBy("source_scope").agg(F.min("run_id").alias("first_run"), F.max("run_id").alias("last_run"))
    records = read_table(spark, base, "contract", ["run_id", "source_scope", "canonical_uri"]).join(ends, "source_scope")
    first = records.where("run_id = first_run").select(F.col("canonical_uri").alias("first_uri")).distinct()
    return first, records.where("run_id = last_run").select(F.col("canonical_uri").alias("last_uri")).distinct()


def tiered_name_match(spark: SparkSession, base: str) -> DataFrame:
    """Pairs of page names, each name once with the number of its pages on either side."""
    name = lambda c: F.lower(F.trim(F.substring_index(F.col(c), "/", -1)))
    first, last = (df.groupBy(name(c).alias(c)).agg(F.count("*").alias(n)) for df, c, n in zip(_page_lists(spark, base), ("first_uri", "last_uri"), ("first_pages", "last_pages"), strict=True))
    pairs = matching.name_matches(first, last, "first_uri", "last_uri", "first_uri", "last_uri", 24)
    return pairs.join(first, "first_uri").join(last, "last_uri").select(F.col("first_uri").alias("first_name"), F.col("last_uri").alias("last_name"), "tier", "first_pages", "last_pages")


def match_status(spark: SparkSession, base: str) -> DataFrame:
    first, last = _page_lists(spark, base)
    links = matching.name_links(first, last, "first_uri", "last_uri", "first_uri", "last_uri")
    return links.select("first_uri", matching.status_of(F.col("pages")).alias("status"), "pages")


def _page_files(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    """The page spellings delivered by the first run of each scope, and by every run after it."""
    runs = read_table(spark, base, "runs", ["run_id", "source_scope"])
    firsts = runs.groupBy("source_scope").agg(F.min("run_id").alias("first_run"))
    records = read_table(spark, base, "contract", ["run_id", "source_scope", "canonical_uri"]).join(firsts, "source_scope")
    first = records.where("run_id = first_run").select(F.col("canonical_uri").alias("first_uri")).distinct()
    return first, records.where("run_id > first_run").select(F.col("canonical_uri").alias("later_uri")).distinct()


def tiered_file_match(spark: SparkSession, base: str) -> DataFrame:
    """Per page of the first runs its classes and how many later pages each tier links it to."""
    first, later = _page_files(spark, base)
    links = matching.file_links(first, later, "first_uri", "later_uri", "first_uri", "later_uri")
    return links.select("first_uri", "name", F.array_join("forms", "|").alias("forms"), "exact", "stem", "folded", "truncated")


def file_match_status(spark: SparkSession, base: str) -> DataFrame:
    first, later = _page_files(spark, base)
    links = matching.file_links(first, later, "first_uri", "later_uri", "first_uri", "later_uri")
    pages = F.coalesce(F.greatest("exact", "stem", "folded"), F.lit(0))
    return first.join(links, "first_uri", "left").select("first_uri", matching.status_of(pages).alias("status"), pages.alias("pages"))


def file_name_forms(spark: SparkSession, base: str) -> DataFrame:
    pages = read_table(spark, base, "documents", ["doc_id", "canonical_uri"])
    return pages.select("doc_id", F.explode(name_forms(F.col("canonical_uri"))).alias("form"))


def ancestor_walk(spark: SparkSession, base: str) -> DataFrame:
    nation, region, supplier = (read_table(spark, base, t) for t in ("nation", "region", "supplier"))
    key = lambda head, c: F.concat(F.lit(head), F.col(c).cast("string"))
    edges = supplier.select(key("s", "s_suppkey").alias("child"), key("n", "s_nationkey").alias("parent")).unionByName(
        nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(key("n", "n_nationkey").alias("child"), key("r", "r_regionkey").alias("parent"))
    )
    start = supplier.select(key("s", "s_suppkey").alias("id"))
    return matching.ancestors(edges, start).select("id", "ancestor", "depth", F.array_join("path", ">").alias("path"))


def text_references(spark: SparkSession, base: str) -> DataFrame:
    tables = {"documents": read_table(spark, base, "documents", ["text", "canonical_uri"]), "blog": read_table(spark, base, "blog", ["title", "html"])}
    return matching.text_references(tables, r"ISO(?:/IEC)? [0-9]{4,5}")


def inventory_problems(spark: SparkSession, base: str) -> DataFrame:
    have = read_table(spark, base, "evaluate_embeddings", ["document_uri"]).withColumnRenamed("document_uri", "canonical_uri")
    return matching.inventory_problems(have, read_table(spark, base, "documents", ["canonical_uri"]), "canonical_uri")


def reachability_join(spark: SparkSession, base: str) -> DataFrame:
    faq = read_table(spark, base, "service_faq_data", ["faq_id", "dictionary_name", "faq_key"])
    pages = read_table(spark, base, "documents", ["doc_id", "canonical_uri"]).withColumn("slug", F.substring_index("canonical_uri", "/", -1))
    return matching.reachable(faq, pages, "faq_key", "slug", "doc_id").select("faq_id", "faq_key", "page_order")


def title_consensus(spark: SparkSession, base: str) -> DataFrame:
    """Scopes' pages of the contract whose records all carry one language."""
    return matching.consensus(read_table(spark, base, "contract", ["canonical_uri", "lang"]), "canonical_uri", "lang")


def best_status(spark: SparkSession, base: str) -> DataFrame:
    """Per scope the best status among its runs, if one mode alone reached it."""
    runs = read_table(spark, base, "runs", ["source_scope", "run_mode", "run_status"])
    return matching.best_status(runs, "source_scope", "run_mode", "run_status", ["succeeded", "failed", "aborted"], "mixed")


QUERIES = {
    f.__name__: f
    for f in (
        left_join_metadata, m2m_ordered_items, distinct_items_dropped, category_two_level, pages_assembled, full_outer_compare, tiered_name_match, match_status,
        tiered_file_match, file_match_status, file_name_forms, ancestor_walk, text_references, inventory_problems, reachability_join, title_consensus, best_status,
    )
}

_MATCH = r"""
  ends as (select source_scope, min(run_id) as first_run, max(run_id) as last_run from runs group by 1),
  fst as (select distinct canonical_uri as first_uri from contract join ends using (source_scope) where run_id = first_run),
  lst as (select distinct canonical_uri as last_uri from contract join ends using (source_scope) where run_id = last_run),
  a as (select first_uri, lower(trim(split_part(first_uri, '/', -1))) as exact from fst),
  b as (select last_uri, lower(trim(split_part(last_uri, '/', -1))) as exact from lst),
  fa as (select first_uri, exact, regexp_replace(exact, '\.[a-z0-9]{1,5}$', '') as stem, trim(regexp_replace(regexp_replace(exact, '\.[a-z0-9]{1,5}$', ''), '[\s_\-.]+', ' ', 'g')) as folded from a where exact <> ''),
  fb as (select last_uri, exact, regexp_replace(exact, '\.[a-z0-9]{1,5}$', '') as stem, trim(regexp_replace(regexp_replace(exact, '\.[a-z0-9]{1,5}$', ''), '[\s_\-.]+', ' ', 'g')) as folded from b where exact <> ''),
  m as (select first_uri, last_uri, 0 as t from fa join fb using (exact) union all select first_uri, last_uri, 1 from fa join fb using (stem) where stem <> ''
        union all select first_uri, last_uri, 2 from fa join fb using (folded) where folded <> ''
        union all select first_uri, last_uri, 3 from fa join fb on substring(fa.folded, 1, 24) = substring(fb.folded, 1, 24)
          where length(fa.folded) >= 24 and length(fb.folded) >= 24 and (starts_with(fa.folded, fb.folded) or starts_with(fb.folded, fa.folded))),
  matches as (select first_uri, last_uri, ['exact', 'stem', 'folded', 'truncated'][min(t) + 1] as tier from m group by 1, 2)"""

_FOLD = r"lower(regexp_replace(regexp_replace({}, '[-_\s]+', '_', 'g'), '^_|_$', '', 'g'))"
_FILES = rf"""
  ends as (select source_scope, min(run_id) as first_run from runs group by 1),
  fst as (select distinct canonical_uri as uri from contract join ends using (source_scope) where run_id = first_run),
  ltr as (select distinct canonical_uri as uri from contract join ends using (source_scope) where run_id > first_run),
  n as (select uri, url_decode(replace(split_part(uri, '/', -1), '+', '%2B')) as name from (select uri from fst union select uri from ltr)),
  t as (select uri, name, regexp_replace(name, '\.[A-Za-z0-9]+$', '') as stem from n where name <> ''),
  k as (select uri, name, stem, list_sort(list_distinct(list_filter([{_FOLD.format('stem')}, {_FOLD.format("regexp_replace(stem, '_[A-Za-z0-9]{7}$', '')")}], lambda f: f <> ''))) as forms from t),
  p as (select a.uri as first_uri, a.name, a.forms, coalesce(a.name = b.name, false) as exact, coalesce(a.stem = b.stem and a.stem <> '', false) as same_stem, coalesce(len(list_intersect(a.forms, b.forms)) > 0, false) as folded,
               coalesce(list_sum(list_transform(a.forms, lambda x: len(list_filter(b.forms, lambda y: x <> y and least(length(x), length(y)) >= 20 and (starts_with(x, y) or starts_with(y, x)))))), 0) as cut
        from k a semi join fst using (uri) left join (select * from k semi join ltr using (uri)) b on true),
  links as (select first_uri, name, array_to_string(forms, '|') as forms, count(*) filter (where exact) as exact, count(*) filter (where same_stem) as stem, count(*) filter (where folded) as folded, sum(cut)::bigint as truncated
            from p group by 1, 2, 3)"""

SQL = {
    "tiered_file_match": f"with {_FILES} select first_uri, name, coalesce(forms, '') as forms, exact, stem, folded, truncated from links",
    "file_match_status": f"""with {_FILES}, s as (select uri as first_uri, coalesce(greatest(exact, stem, folded), 0) as pages from fst left join links on uri = first_uri)
      select first_uri, case when pages = 1 then 'matched' when pages > 1 then 'ambiguous' else 'unmatched' end as status, pages from s""",
    "left_join_metadata": "select c_custkey, n_name, nullif(c_mktsegment, 'MACHINERY') as segment from customer left join (select * from nation where n_regionkey < 3) on c_nationkey = n_nationkey",
    "m2m_ordered_items": "select l_orderkey, string_agg(p_name, '|' order by l_linenumber, l_partkey) as items from lineitem join part on l_partkey = p_partkey group by 1",
    "distinct_items_dropped": """select l_orderkey, string_agg(distinct l_linenumber::varchar, '|' order by l_linenumber::varchar) as kept, (count(*) - count(distinct l_linenumber))::int as dropped from lineitem group by 1""",
    "category_two_level": """with i as (select s_nationkey, string_agg(s_name, ',' order by s_suppkey) as names from supplier group by 1)
      select n_regionkey, string_agg(n_name || '=' || names, ';' order by n_nationkey) as categories from nation join i on s_nationkey = n_nationkey group by 1""",
    "pages_assembled": """with i as (select s_nationkey, string_agg(s_name, '|' order by s_suppkey) as items from supplier group by 1),
      s as (select n_nationkey, nullif(n_name, 'NATION_5') as n_name, items from nation left join i on s_nationkey = n_nationkey where n_regionkey < 3)
      select c_custkey, c_name, n_name, items, case when n_nationkey is null then 'nation' else '' end as missing_sections from customer left join s on c_nationkey = n_nationkey""",
    "full_outer_compare": """with a as (select c_nationkey as k, count(*) % 4 as n from customer group by 1), b as (select s_nationkey as k, count(*) % 4 as n from supplier where s_nationkey <> 7 group by 1)
      select k, case when b.n is null then 'missing' when a.n is null then 'extra' when a.n = b.n then 'matches' else 'differs' end as status from a full join b using (k)""",
    "tiered_name_match": f"""with {_MATCH} select first_name, last_name, any_value(tier) as tier, count(distinct first_uri) as first_pages, count(distinct last_uri) as last_pages
      from (select m.*, a.exact as first_name, b.exact as last_name from matches m join a using (first_uri) join b using (last_uri)) group by 1, 2""",
    "match_status": f"""with {_MATCH}, s as (select first_uri, count(distinct last_uri) as pages from matches where tier <> 'truncated' group by 1)
      select first_uri, case when pages = 1 then 'matched' when pages > 1 then 'ambiguous' else 'unmatched' end as status, coalesce(pages, 0) as pages from fst left join s using (first_uri)""",
    "file_name_forms": r"""
      with n as (select doc_id, lower(url_decode(replace(split_part(canonical_uri, '/', -1), '+', '%2B'))) as name from documents),
      s as (select doc_id, name, regexp_replace(name, '\.[a-z0-9]{1,5}$', '') as stem from n), f as (select *, trim(regexp_replace(stem, '[\s_\-.]+', ' ', 'g')) as folded from s),
      b as (select *, trim(regexp_replace(folded, ' [a-z0-9]{7}$', '')) as bare from f)
      select distinct doc_id, form from (select doc_id, unnest([name, stem, folded, bare]) as form from b) where form <> ''""",
    "ancestor_walk": """
      with recursive edges as (select 's' || s_suppkey as child, 'n' || s_nationkey as parent from supplier union all select 'n' || n_nationkey, 'r' || r_regionkey from nation join region on n_regionkey = r_regionkey),
      walk as (select 's' || s_suppkey as id, 's' || s_suppkey as ancestor, 0 as depth, 's' || s_suppkey as path from supplier
               union all select w.id, e.parent, w.depth + 1, w.path || '>' || e.parent from walk w join edges e on e.child = w.ancestor)
      select id, ancestor, depth, path from walk""",
    "text_references": """
      with c as (select 'documents' as table_name, 'text' as column_name, text as cell from documents union all select 'documents', 'canonical_uri', canonical_uri from documents
                 union all select 'blog', 'title', title from blog union all select 'blog', 'html', html from blog),
      r as (select table_name, column_name, unnest(regexp_extract_all(cell, 'ISO(?:/IEC)? [0-9]{4,5}')) as reference from c)
      select table_name, column_name, reference, count(*) as rows from r group by 1, 2, 3""",
    "inventory_problems": """
      select 'repeated' as problem, document_uri as canonical_uri from evaluate_embeddings group by 2 having count(*) > 1
      union all select 'missing', canonical_uri from documents where canonical_uri not in (select document_uri from evaluate_embeddings)
      union all select distinct 'extra', document_uri from evaluate_embeddings where document_uri not in (select canonical_uri from documents)""",
    "reachability_join": "select faq_id, faq_key, doc_id as page_order from service_faq_data join documents on faq_key = lower(split_part(canonical_uri, '/', -1))",
    "title_consensus": "select canonical_uri, min(lang) as lang from contract where lang is not null and canonical_uri is not null group by 1 having min(lang) = max(lang)",
    "best_status": """
      with p as (select source_scope, run_mode, run_status, list_position(['succeeded', 'failed', 'aborted'], run_status) as place from runs), q as (select *, min(place) filter (where place > 0) over (partition by source_scope) as best from p)
      select source_scope, case when count(distinct run_mode) <= 1 then min(run_status) else 'mixed' end as status from q where place = best group by 1""",
}
