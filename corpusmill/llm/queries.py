"""Named queries of the training-data operators and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import broken_pairs, mixing, packing, personal_information, repeated_lines, similar_vectors, splitting, top_per_group
from corpusmill.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    return similar_vectors.similar_pairs(read_table(spark, base, "evaluate_embeddings"), "certhaven-embed-64", 64)


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    return broken_pairs.find_broken_pairs(read_table(spark, base, "service_faq_data"))


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    return repeated_lines.repeated_lines(read_table(spark, base, "blog")).select("post_id", "line_no")


def p4_templates(spark: SparkSession, base: str) -> DataFrame:
    return repeated_lines.repeated_templates(read_table(spark, base, "blog"))


def p4_cleaned(spark: SparkSession, base: str) -> DataFrame:
    return repeated_lines.without_repeated_lines(read_table(spark, base, "blog"))


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    return splitting.oversized_items(read_table(spark, base, "blog"), read_table(spark, base, "evaluate_embeddings"))


def p5_pieces(spark: SparkSession, base: str) -> DataFrame:
    return splitting.split_corpus(read_table(spark, base, "blog"), read_table(spark, base, "evaluate_embeddings"))


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    return top_per_group.top_hits(read_table(spark, base, "evaluate_retrieval")).select("hit_id")


def p6_ranked(spark: SparkSession, base: str) -> DataFrame:
    return top_per_group.top_hits(read_table(spark, base, "evaluate_retrieval"))


def p7_containers(spark: SparkSession, base: str) -> DataFrame:
    return packing.fill_containers(read_table(spark, base, "documents"))


def p7_fill(spark: SparkSession, base: str) -> DataFrame:
    return packing.container_fill(read_table(spark, base, "documents"))


def p7_gain(spark: SparkSession, base: str) -> DataFrame:
    return packing.search_gain(read_table(spark, base, "documents"))


def p8_mixture(spark: SparkSession, base: str) -> DataFrame:
    return mixing.mix_sources(read_table(spark, base, "documents"), read_table(spark, base, "mix_targets"))


def p8_shares(spark: SparkSession, base: str) -> DataFrame:
    return mixing.mix_shares(read_table(spark, base, "documents"), read_table(spark, base, "mix_targets"))


def p8_leaves(spark: SparkSession, base: str) -> DataFrame:
    return mixing.mix_leaves(read_table(spark, base, "documents"), read_table(spark, base, "mix_targets"))


def p9_found(spark: SparkSession, base: str) -> DataFrame:
    return personal_information.find_personal_information(read_table(spark, base, "documents")).select("doc_id", "pii_type", "start_pos")


def p9_masked(spark: SparkSession, base: str) -> DataFrame:
    return personal_information.mask_personal_information(read_table(spark, base, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (p2_found, p3_found, p4_found, p4_templates, p4_cleaned, p5_found, p5_pieces, p6_found, p6_ranked, p7_containers, p7_fill, p7_gain, p8_mixture, p8_shares, p8_leaves, p9_found, p9_masked)
}

_TOP_HITS = """
with latest as (
  select *, row_number() over (partition by document_uri, case_id, content_hash
                               order by recorded_at desc nulls last, hit_id desc) as delivery
  from evaluate_retrieval where document_uri is not null
), ranked as (
  select document_uri, hit_id, row_number() over (partition by document_uri
         order by top_score desc, content_hash, case_id) as rank
  from latest
  where delivery = 1 and top_score is not null and not isnan(top_score) and top_score between -1 and 1
)
"""


def _visible(markup: str) -> str:
    """Visible text; of the character references those that the tables hold."""
    bare = rf"regexp_replace({markup}, '(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<[a-zA-Z/!?][^>]*>', ' ', 'g')"
    decoded = f"replace(replace(replace({bare}, '&nbsp;', chr(160)), '&#38;', '&'), '&amp;', '&')"
    return rf"trim(regexp_replace({decoded}, '[\s\x{{A0}}\x{{85}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{3000}}]+', ' ', 'g'))"


_REPEATED = rf"""
with lines as (select post_id, site, unnest(string_split(html, chr(10))) as line, unnest(range(1, len(string_split(html, chr(10))) + 1)) as line_no from blog where html is not null),
keyed as (select post_id, site, line_no, trim(regexp_replace(regexp_replace(lower({_visible('line')}), '[0-9]+', '', 'g'), '\s+', ' ', 'g')) as key from lines),
posts as (select site, count(*) as n from blog group by 1),
frequent as (select site, key from keyed join posts using (site) where key <> '' group by site, key, n having count(distinct post_id) >= 5 and 10 * count(distinct post_id) >= n),
found as (select k.post_id, k.line_no::int as line_no from keyed k join frequent f on k.site = f.site and k.key = f.key)
"""
SQL: dict[str, str] = {
    "p2_found": """
with usable as (
  select chunk_id, content_hash, list_transform(embedding, lambda x: x::double) as v from evaluate_embeddings
  where embedding_model = 'certhaven-embed-64' and len(embedding) = 64 and not list_bool_or(list_transform(embedding, lambda x: x is null or isnan(x) or isinf(x)))
    and list_bool_or(list_transform(embedding, lambda x: x <> 0))
), reps as (select min(chunk_id) as chunk_id, arg_min(v, chunk_id) as v from usable group by content_hash),
scored as (select a.chunk_id as a, b.chunk_id as b, round(list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))), 12) as cosine from reps a, reps b where a.chunk_id <> b.chunk_id),
best as (select a, b from scored where cosine >= 0.85 qualify row_number() over (partition by a order by cosine desc, b) <= 5)
select distinct least(a, b) as chunk_id_a, greatest(a, b) as chunk_id_b from best""",
    "p4_found": _REPEATED + "select post_id, line_no from found",
    "p4_cleaned": _REPEATED + """, gone as (select post_id, list(line_no) as drops from found group by 1)
select b.post_id, b.site, coalesce(len(g.drops), 0)::int as n_removed,
       array_to_string(list_transform(list_filter(range(1, len(string_split(b.html, chr(10))) + 1), lambda i: not coalesce(list_contains(g.drops, i::int), false)), lambda i: string_split(b.html, chr(10))[i]), chr(10)) as html
from blog b left join gone g using (post_id)""",
    "p5_found": f"""
select 'blog' as item_table, post_id as item_id from blog where length({_visible('html')}) > 4000
union all select 'evaluate_embeddings', chunk_id from evaluate_embeddings where length(content) > 1000""",
    "p6_found": _TOP_HITS + "select hit_id from ranked where rank <= 3",
    "p6_ranked": _TOP_HITS + "select document_uri, hit_id, rank from ranked where rank <= 3",
}
