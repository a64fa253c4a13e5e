"""Queries over texts, markup, URLs and blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import blocks as B
from corpusmill.functions import markup, text, urls
from corpusmill.functions.spread import spread
from corpusmill.operators import chunking, synchronize
from corpusmill.plans import block_sql as S
from corpusmill.sources.tables import read_table


def content_normalise(spark: SparkSession, base: str) -> DataFrame:
    docs = read_table(spark, base, "documents", ["doc_id", "text"])
    return docs.select("doc_id", text.digest(text.content_text(F.col("text"))).alias("digest"))


def hash_normalise_digest(spark: SparkSession, base: str) -> DataFrame:
    docs = read_table(spark, base, "documents", ["doc_id", "text"])
    return docs.select("doc_id", text.digest(text.hash_text(F.col("text"))).alias("digest"))


def paragraph_split(spark: SparkSession, base: str) -> DataFrame:
    docs = read_table(spark, base, "documents", ["doc_id", "text"])
    parts = text.paragraphs(F.col("text"))
    return docs.where("text is not null").select("doc_id", F.posexplode(parts).alias("paragraph_no", "paragraph")).select("doc_id", "paragraph_no", text.digest(F.col("paragraph")).alias("digest"))


def chunk_windows(spark: SparkSession, base: str) -> DataFrame:
    docs = read_table(spark, base, "documents", ["doc_id", "text"])
    return chunking.window_chunks(docs, "doc_id", "text").select("doc_id", "chunk_index", "content_hash")


def _faq_blocks(spark: SparkSession, base: str) -> DataFrame:
    """FAQ exports as documents of one pair block per filled pair."""
    faq = read_table(spark, base, "service_faq_data", ["faq_id", "pairs"])
    full = F.filter("pairs", lambda p: F.coalesce(p["question"].rlike(r"[^ \t\n\r]") & p["answer"].rlike(r"[^ \t\n\r]"), F.lit(False)))
    packed = F.to_json(
        F.transform(full, lambda p: F.struct(F.lit("faq_pair").alias("type"), p["question"].alias("question"), F.array(F.struct(F.lit("paragraph").alias("type"), p["answer"].alias("text"))).alias("answer")))
    )
    return faq.select("faq_id", F.from_json(packed, B.BLOCKS).alias("blocks"))


def faq_pair_chunks(spark: SparkSession, base: str) -> DataFrame:
    return chunking.document_chunks(_faq_blocks(spark, base), "faq_id", "blocks").select("faq_id", "chunk_index", "content_hash")


def faq_pair_hashes(spark: SparkSession, base: str) -> DataFrame:
    return _faq_blocks(spark, base).select("faq_id", B.document_hash(F.lit("FAQ"), F.col("blocks")).alias("content_hash"))


def slot_unpivot(spark: SparkSession, base: str) -> DataFrame:
    part = read_table(spark, base, "part", ["p_partkey", "p_name", "p_brand", "p_type"])
    blank = part.withColumn("p_type", F.when(F.col("p_type") != "ECONOMY", F.col("p_type")))
    return chunking.slot_pairs(blank, "p_partkey", [("p_name", "p_brand"), ("p_brand", "p_type"), ("p_type", "p_name")])


def block_types(spark: SparkSession, base: str) -> DataFrame:
    records = read_table(spark, base, "contract", ["blocks"])
    found = records.select(F.explode(B.parse_blocks("blocks")["blocks"]).alias("b"))
    return found.groupBy(F.col("b.type").alias("block_type")).agg(F.count("*").alias("n"), F.sum(F.length(F.coalesce("b.text", F.lit("")))).alias("characters"))


def block_problems(spark: SparkSession, base: str) -> DataFrame:
    records = read_table(spark, base, "contract", ["record_id", "blocks"])
    return records.select("record_id", B.parse_blocks("blocks")["problem"].alias("problem")).where("problem is not null")


def contract_chunks(spark: SparkSession, base: str) -> DataFrame:
    records = read_table(spark, base, "contract", ["record_id", "blocks"]).select("record_id", B.parse_blocks("blocks")["blocks"].alias("blocks"))
    return chunking.document_chunks(records, "record_id", "blocks").select("record_id", "chunk_index", "content_hash")


def contract_hashes(spark: SparkSession, base: str) -> DataFrame:
    records = read_table(spark, base, "contract", ["record_id", "title", "blocks"])
    return records.select("record_id", B.document_hash(F.col("title"), B.parse_blocks("blocks", compose_unicode=True)["blocks"]).alias("content_hash"))


def _blog_blocks(spark: SparkSession, base: str) -> DataFrame:
    posts = spread(read_table(spark, base, "blog", ["post_id", "site", "url", "title", "html"]))
    return posts.withColumn("r", markup.html_blocks(F.col("html"), "https://www.certhaven.example/blog/")).select("post_id", "site", "url", "title", F.col("r.blocks").alias("blocks"), F.col("r.counters").alias("counters"))


def html_blocks(spark: SparkSession, base: str) -> DataFrame:
    flat = _blog_blocks(spark, base).select("post_id", F.posexplode("blocks").alias("block_no", "b"))
    return flat.select("post_id", "block_no", F.col("b.type").alias("block_type"), text.digest(B.render(F.col("b"))).alias("digest"))


def html_removal_counters(spark: SparkSession, base: str) -> DataFrame:
    return _blog_blocks(spark, base).select(F.explode("counters").alias("c")).select("c.rule", "c.n").groupBy("rule").agg(F.sum("n").alias("removed"), F.count("*").alias("posts"))


def blog_chunks(spark: SparkSession, base: str) -> DataFrame:
    return chunking.document_chunks(_blog_blocks(spark, base), "post_id", "blocks").select("post_id", "chunk_index", "content_hash")


def blog_contextual_chunks(spark: SparkSession, base: str) -> DataFrame:
    """Windows over each post's running text with the headings above their start."""
    posts = _blog_blocks(spark, base)
    flat = posts.select("post_id", F.posexplode(F.filter("blocks", lambda b: B.render(b) != "")).alias("ord", "b")).select(
        "post_id", "ord", B.render(F.col("b")).alias("text"), F.when(F.col("b.type") == "heading", F.col("b.level")).alias("level")
    )
    units = chunking.heading_paths(flat, "post_id", "ord", "level", "text")
    chunks = chunking.document_chunks(posts, "post_id", "blocks")
    placed = chunking.window_context(chunks, units, "post_id").join(posts.select("post_id", "title"), "post_id")
    return placed.select("post_id", "chunk_index", text.digest(chunking.contextual_text(F.col("title"), F.coalesce("heading_path", F.array()), F.col("content"))).alias("digest"))


def heading_path_rows(spark: SparkSession, base: str) -> DataFrame:
    """Order lines as headings whose level follows from their quantity, with the headings above each."""
    lines = read_table(spark, base, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"])
    ranked = lines.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").cast("string").alias("text"), (F.max("l_quantity").cast("int") % 3 + 1).alias("level"))
    path = chunking.heading_paths(ranked, "l_orderkey", "l_linenumber", "level", "text")
    return path.select("l_orderkey", "l_linenumber", F.array_join("heading_path", ">").alias("path"))


def url_canonical(spark: SparkSession, base: str) -> DataFrame:
    records = read_table(spark, base, "contract", ["record_id", "canonical_uri"])
    return records.select("record_id", urls.canonical_url(F.col("canonical_uri")).alias("url"))


def url_query_normalise(spark: SparkSession, base: str) -> DataFrame:
    records = read_table(spark, base, "contract", ["record_id", "canonical_uri"])
    query = F.regexp_extract(F.substring_index("canonical_uri", "#", 1), r"\?(.*)$", 1)
    return records.select("record_id", urls.query_without_tracking(query).alias("query"))


def tracking_report(spark: SparkSession, base: str) -> DataFrame:
    records = read_table(spark, base, "contract", ["canonical_uri"])
    items = records.select(F.explode(F.split(F.regexp_extract(F.substring_index("canonical_uri", "#", 1), r"\?(.*)$", 1), "&")).alias("item"))
    key = F.lower(F.substring_index("item", "=", 1))
    return items.where(key.isin(*urls.TRACKING_KEYS)).groupBy(key.alias("tracking_key")).agg(F.count("*").alias("n"))


def precheck_gate(spark: SparkSession, base: str) -> DataFrame:
    posts = read_table(spark, base, "blog", ["post_id", "url", "title", "html"])
    return posts.select("post_id", synchronize.raw_gate(F.col("url"), F.col("title"), F.col("html"), F.lit("mysql"), 40).alias("reason"))


def acceptance_gate(spark: SparkSession, base: str) -> DataFrame:
    records = read_table(spark, base, "contract", ["record_id", "canonical_uri", "title", "blocks", "extractor_version"])
    parsed = records.withColumn("b", B.parse_blocks("blocks")["blocks"]).withColumn("url", urls.canonical_url(F.col("canonical_uri")))
    says = F.coalesce(F.exists("b", B.has_text), F.lit(False))
    return parsed.select("record_id", synchronize.acceptance_gate(F.col("canonical_uri"), F.col("url"), F.col("title"), F.col("b"), says, F.col("extractor_version")).alias("reason"))


def citation_links(spark: SparkSession, base: str) -> DataFrame:
    pages = read_table(spark, base, "fixed_pages", ["page_id", "canonical_uri", "source_scope", "is_active"])
    status = F.when(F.col("is_active"), "confirmed").otherwise("unresolved")
    return pages.select("page_id", urls.citation(F.col("canonical_uri"), F.col("source_scope"), status, F.col("canonical_uri"), "policy").alias("citation_uri"))


QUERIES = {
    f.__name__: f
    for f in (
        content_normalise, hash_normalise_digest, paragraph_split, chunk_windows, faq_pair_chunks, faq_pair_hashes, slot_unpivot, block_types, block_problems,
        contract_chunks, contract_hashes, html_blocks, html_removal_counters, blog_chunks, blog_contextual_chunks, heading_path_rows, url_canonical,
        url_query_normalise, tracking_report, precheck_gate, acceptance_gate, citation_links,
    )
}

_CONTENT = (
    rf"regexp_replace(regexp_replace(regexp_replace({S.folded('text')}, '[ \x{{1680}}]+', ' ', 'g'), "
    r"' ?[\n\x{2028}\x{2029}][ \n\x{1680}\x{2028}\x{2029}]*', chr(10), 'g'), '^[ \n\x{1680}\x{2028}\x{2029}]+|[ \n\x{1680}\x{2028}\x{2029}]+$', '', 'g')"
)
_KEYS = ", ".join(f"'{k}'" for k in urls.TRACKING_KEYS)
_QUERY = r"regexp_extract(split_part(canonical_uri, '#', 1), '\?(.*)$', 1)"

SQL = {
    "content_normalise": f"select doc_id, sha256({_CONTENT}) as digest from documents",
    "hash_normalise_digest": f"select doc_id, sha256({S.hashed_text('text')}) as digest from documents",
    "paragraph_split": r"""
      with p as (select doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n[ \t]*\n\s*'), lambda x: trim(replace(x, chr(13), ''))), lambda x: x <> '') as ps
                 from documents where text is not null),
      e as (select doc_id, unnest(ps) as paragraph, unnest(range(len(ps))) as k from p)
      select doc_id, k::int as paragraph_no, sha256(paragraph) as digest from e""",
    "chunk_windows": """
      with w as (select doc_id, text, unnest(range(case when length(text) <= 1000 then 1 else ceil((length(text) - 1000) / 850.0)::int + 1 end)) as i
                 from documents where length(text) > 0)
      select doc_id, i::int as chunk_index, sha256(substring(text, (i * 850 + 1)::bigint, 1000)) as content_hash from w""",
    "faq_pair_chunks": r"""
      with p as (select faq_id, list_filter(pairs, lambda p: coalesce(regexp_matches(p.question, '[^ \t\n\r]') and regexp_matches(p.answer, '[^ \t\n\r]'), false)) as ps from service_faq_data),
      e as (select faq_id, unnest(range(len(ps))) as k, unnest(ps) as pair from p)
      select faq_id, k::int as chunk_index, sha256(pair.question || chr(10) || pair.answer) as content_hash from e""",
    "faq_pair_hashes": S.FAQ_PAIR_HASHES,
    "contract_chunks": S.CONTRACT_CHUNKS,
    "contract_hashes": S.CONTRACT_HASHES,
    "url_canonical": S.URL_CANONICAL,
    "acceptance_gate": S.ACCEPTANCE_GATE,
    "slot_unpivot": """
      with b as (select p_partkey, p_name, p_brand, nullif(p_type, 'ECONOMY') as p_type from part)
      select p_partkey, 1 as slot, p_name as question, p_brand as answer from b where p_name is not null and p_brand is not null
      union all select p_partkey, 2, p_brand, p_type from b where p_brand is not null and p_type is not null
      union all select p_partkey, 3, p_type, p_name from b where p_type is not null and p_name is not null""",
    "block_types": """
      with e as (select unnest(from_json(blocks, '["JSON"]')) as b from contract)
      select json_extract_string(b, '$.type') as block_type, count(*) as n, sum(length(coalesce(json_extract_string(b, '$.text'), '')))::bigint as characters from e group by 1""",
    "block_problems": "select record_id, 'no array of blocks' as problem from contract where json_type(blocks) <> 'ARRAY'",
    "heading_path_rows": """
      with r as (select l_orderkey, l_linenumber, max(l_partkey)::varchar as text, max(l_quantity)::int % 3 + 1 as level from lineitem group by 1, 2),
      h as (select a.l_orderkey, a.l_linenumber, b.level, max(b.l_linenumber) as at from r a join r b on a.l_orderkey = b.l_orderkey and b.l_linenumber <= a.l_linenumber group by 1, 2, 3),
      k as (select h.* from h where not exists (select 1 from h g where g.l_orderkey = h.l_orderkey and g.l_linenumber = h.l_linenumber and g.level < h.level and g.at > h.at))
      select k.l_orderkey, k.l_linenumber, string_agg(r.text, '>' order by k.level) as path
      from k join r on r.l_orderkey = k.l_orderkey and r.l_linenumber = k.at group by 1, 2""",
    "url_query_normalise": f"""
      select record_id, coalesce(array_to_string(list_transform(list_sort(list_transform(list_filter(string_split({_QUERY}, '&'),
        lambda x: x <> '' and not list_contains([{_KEYS}], lower(split_part(x, '=', 1)))), lambda x: split_part(x, '=', 1) || chr(1) || x)), lambda x: split_part(x, chr(1), 2)), '&'), '') as query
      from contract""",
    "tracking_report": f"""
      with e as (select unnest(string_split({_QUERY}, '&')) as item from contract)
      select lower(split_part(item, '=', 1)) as tracking_key, count(*) as n from e where lower(split_part(item, '=', 1)) in ({_KEYS}) group by 1""",
    "precheck_gate": r"""
      select post_id, case when lower(trim(url)) = 'a' or lower(trim(title)) = 'a' then 'placeholder_record'
        when html is null or trim(regexp_replace(html, '\s+', ' ', 'g')) = '' then 'empty_body' when length(html) < 40 then 'below_floor' end as reason from blog""",
    "citation_links": "select page_id, case when source_scope = 'policy' then case when is_active and starts_with(canonical_uri, 'https://') then canonical_uri end when starts_with(canonical_uri, 'https://') then canonical_uri end as citation_uri from fixed_pages",
}
