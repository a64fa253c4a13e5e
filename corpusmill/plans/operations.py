"""Queries over structured reads, the blog tables, backfill counters and evaluation setup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.operators import assets, backfill, lookups, ranking
from corpusmill.scratch import durable
from corpusmill.sources import blog, readers
from corpusmill.sources.tables import read_table

MODEL, SITE = "certhaven-embed-64", "https://www.certhaven.example/"
PUBLIC = ("about", "blog", "policy", "office_locations")


def _stored(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    """The chunks of the fixed pages and those pages as stored documents."""
    chunks = read_table(spark, base, "evaluate_embeddings", ["document_uri", "chunk_index", "content", "content_hash"]).withColumnRenamed("document_uri", "canonical_uri")
    pages = read_table(spark, base, "fixed_pages", ["canonical_uri", "title", "source_scope", "is_active"])
    return chunks, pages.withColumn("status", F.when(F.col("is_active"), "active").otherwise("missing")).drop("is_active")


def scope_documents(spark: SparkSession, base: str) -> DataFrame:
    chunks, pages = _stored(spark, base)
    return lookups.scope_documents(chunks, pages, PUBLIC, "policy").drop("content")


def page_profile(spark: SparkSession, base: str) -> DataFrame:
    chunks, pages = _stored(spark, base)
    return lookups.page_profile(chunks, pages, PUBLIC, f"{SITE}about-certhaven").drop("content")


def pages_by_uri(spark: SparkSession, base: str) -> DataFrame:
    chunks, pages = _stored(spark, base)
    return lookups.pages_by_uri(chunks, pages, PUBLIC, [f"{SITE}about-certhaven", f"{SITE}planning-gap-analysis-2", f"{SITE}nowhere"]).drop("content")


def corpus_scan(spark: SparkSession, base: str) -> DataFrame:
    return lookups.corpus_scan(*_stored(spark, base)).drop("content")


def blog_inventory(spark: SparkSession, base: str) -> DataFrame:
    posts = read_table(spark, base, "blog", ["post_id", "url"]).withColumnRenamed("post_id", "id")
    return blog.identities(posts, f"{SITE}blog/")


def blog_rows(spark: SparkSession, base: str) -> DataFrame:
    """The posts as the blog's own tables would hold them; every third one has no metadata."""
    rows = read_table(spark, base, "blog")
    known = {"id": "post_id", "url": "url", "title": "title", "long_description": "html", "short_description": "short_description", "posted_date": "posted_date", "status": "post_status"}
    own = [F.col(known[f.name]).cast(f.dataType).alias(f.name) if f.name in known else F.lit(None).cast(f.dataType).alias(f.name) for f in blog.POSTS.fields]
    posts = rows.select(*own).withColumn("blog_meta_id", F.when(F.col("id") % 3 != 0, F.col("id") + 1_000_000))
    meta = rows.select((F.col("post_id") + 1_000_000).alias("id"), F.upper("title").alias("title"), F.col("site").alias("description"), *[F.lit(None).cast("string").alias(c) for c in ("keywords", "author")], F.lit("en").alias("language"))
    found = blog.rows_with_metadata(posts, meta)
    return found.select("id", "title", "posted_date", "blog_meta_id", "meta_title", "meta_description", "meta_language", F.length("long_description").alias("n_characters"))


def backfill_counters(spark: SparkSession, base: str) -> DataFrame:
    """What a backfill of all chunks under another model does, texts embedded by word hashes."""
    chunks = read_table(spark, base, "evaluate_embeddings", ["chunk_id", "content_hash", "content", "embedding_model", "embedding"])
    identity = "word-hashes:16"
    planned = backfill.in_batches(backfill.plan(chunks, identity))
    embedded = durable(backfill.embed_batches(planned, backfill.hashing_embedder(16), 16))
    todo = backfill.pending(chunks, identity).select("content_hash")
    rows = todo.count()
    done = todo.join(embedded.where("status = 'embedded'").select("content_hash"), "content_hash", "left_semi").count()
    counts = backfill.counters(rows, embedded, done, rows - done)
    names = ("selected_chunks", "unique_texts", "embedded_texts", "rows_updated", "batches", "failed_batches", "api_requests", "pending_after")
    return spark.createDataFrame([tuple(int(counts[n]) for n in names) + (counts["stop_reason"],)], ", ".join(f"{n} bigint" for n in names) + ", stop_reason string")


def setup_report(spark: SparkSession, base: str) -> DataFrame:
    """The golden cases against the stored chunks; each case expects the text of its best hit."""
    cases = read_table(spark, base, "golden_cases", ["case_id", "answerable", "expected_document_uri"])
    hits = read_table(spark, base, "evaluate_retrieval", ["case_id", "hit_id", "content_hash", "top_score"]).where("top_score between -1 and 1 and not isnan(top_score)")
    expected = hits.groupBy("case_id").agg(F.max_by("content_hash", F.struct("top_score", -F.col("hit_id"))).alias("content_hash"))
    rows = read_table(spark, base, "evaluate_embeddings", ["document_uri", "content", "content_hash", "embedding_model"])
    chunks = rows.select(F.col("document_uri").alias("canonical_uri"), "content", "content_hash", (F.col("embedding_model") == MODEL).alias("embedded"))
    return ranking.setup_report(cases, expected, chunks, "certhaven-embed-64", 128, {MODEL: 64}, 1_000)


def object_requests(spark: SparkSession, base: str) -> DataFrame:
    return readers.object_requests(read_table(spark, base, "contract", ["canonical_uri"]), "canonical_uri")


def evaluation_texts(spark: SparkSession, base: str) -> DataFrame:
    found = backfill.evaluation_texts(read_table(spark, base, "golden_cases", ["query_text"]), read_table(spark, base, "evaluate_embeddings", ["content", "content_hash"]))
    return found.select("content_hash", "kind", F.length("content").alias("n_characters"))


def report_slices(spark: SparkSession, base: str) -> DataFrame:
    """The hits a report shows of each case: ten where it can be answered, five where not, and its first three apart."""
    hits = read_table(spark, base, "evaluate_retrieval", ["hit_id", "case_id", "document_uri", "top_score"]).where("document_uri is not null and top_score between -1 and 1 and not isnan(top_score)")
    cases = read_table(spark, base, "golden_cases", ["case_id", "answerable"])
    rank = F.row_number().over(Window.partitionBy("case_id").orderBy(F.col("top_score").desc(), "hit_id"))
    ranked = hits.withColumn("rank", rank).where("rank <= 10").join(F.broadcast(cases), "case_id")
    shown = F.array_compact(F.array(F.when(F.col("answerable"), F.lit("top")), F.when(~F.col("answerable") & (F.col("rank") <= 5), F.lit("unanswerable")), F.when(F.col("rank") <= 3, F.lit("head"))))
    return ranked.select("case_id", F.explode(shown).alias("slice"), "hit_id", "rank")


def _mapping(spark: SparkSession, base: str) -> tuple[DataFrame, ...]:
    """Documents as items to map: every fifth skipped, every third matched before, every second proven."""
    docs = read_table(spark, base, "documents", ["doc_id", "canonical_uri", "content_type"]).withColumnRenamed("doc_id", "item")
    active, skipped = docs.where("item % 5 <> 0").select("item"), docs.where("item % 5 = 0").select("item")
    matched = docs.where("item % 3 = 0").select("item", F.col("canonical_uri").alias("page"))
    proven = F.col("item") % 2 == 0
    status = F.when(proven & (F.col("content_type") != "note"), "confirmed_exact").when(proven, "needs_review").otherwise("no_candidate")
    outcomes = docs.where("item % 5 <> 0 and item % 7 <> 0").select("item", status.alias("status"), F.when(proven, F.col("canonical_uri")).alias("page"))
    return active, skipped, matched, outcomes, assets.final_mapping(active, matched, outcomes)


def final_mapping(spark: SparkSession, base: str) -> DataFrame:
    return _mapping(spark, base)[-1]


def mapping_problems(spark: SparkSession, base: str) -> DataFrame:
    return assets.mapping_problems(*_mapping(spark, base), "https://www.certhaven.example/p", ["confirmed_exact", "confirmed_pixel_identical"])


QUERIES = {f.__name__: f for f in (scope_documents, page_profile, pages_by_uri, corpus_scan, blog_inventory, blog_rows, backfill_counters, setup_report, object_requests, evaluation_texts, report_slices, final_mapping, mapping_problems)}

_READ = "select c.document_uri as canonical_uri, p.title, p.source_scope, c.chunk_index, c.content_hash from evaluate_embeddings c join fixed_pages p on p.canonical_uri = c.document_uri where p.is_active and p.source_scope in ('about', 'blog', 'policy', 'office_locations')"
_HITS = "select *, row_number() over (partition by case_id order by top_score desc, hit_id) as rank from evaluate_retrieval where document_uri is not null and top_score between -1 and 1 and not isnan(top_score)"
_MAPPED = """
  active as (select doc_id as item from documents where doc_id % 5 <> 0), skipped as (select doc_id as item from documents where doc_id % 5 = 0),
  matched as (select doc_id as item, canonical_uri as page from documents where doc_id % 3 = 0),
  outcomes as (select doc_id as item, case when doc_id % 2 = 0 and content_type <> 'note' then 'confirmed_exact' when doc_id % 2 = 0 then 'needs_review' else 'no_candidate' end as status,
                      case when doc_id % 2 = 0 then canonical_uri end as page from documents where doc_id % 5 <> 0 and doc_id % 7 <> 0),
  final as (select a.item, coalesce(m.page, o.page) as page, o.status as verification_status, case when m.page is not null then 'matched' else 'proof' end as source
            from active a left join outcomes o using (item) left join matched m using (item) where m.page is not null or o.page is not null)"""
SQL = {
    "evaluation_texts": """
      with e as (select sha256(query_text) as content_hash, query_text as content, 0 as place from golden_cases union all select content_hash, content, 1 from evaluate_embeddings)
      select content_hash, case min(place) when 0 then 'query' else 'chunk' end as kind, length(arg_min(content, place))::int as n_characters from e where content_hash is not null group by 1""",
    "report_slices": f"""
      with r as (select h.*, g.answerable from ({_HITS}) h join golden_cases g using (case_id) where rank <= 10)
      select case_id, 'top' as slice, hit_id, rank::int as rank from r where answerable union all select case_id, 'unanswerable', hit_id, rank::int from r where not answerable and rank <= 5
      union all select case_id, 'head', hit_id, rank::int from r where rank <= 3""",
    "final_mapping": f"with {_MAPPED} select item, page, verification_status, source from final",
    "mapping_problems": f"""with {_MAPPED}
      select 'no outcome' as problem, item from active where item not in (select item from outcomes) union all select 'outcome of no active item', item from outcomes where item not in (select item from active)
      union all select 'skipped item is mapped', item from final where item in (select item from skipped) union all select 'not a public page', item from final where not starts_with(page, 'https://www.certhaven.example/p')
      union all select 'mapping lost', item from matched where item not in (select item from final)
      union all select 'mapping without proof', item from final where source = 'proof' and coalesce(verification_status not in ('confirmed_exact', 'confirmed_pixel_identical'), true)""",
    "scope_documents": f"{_READ} and p.source_scope = 'policy'",
    "page_profile": f"{_READ} and c.document_uri = '{SITE}about-certhaven' and c.chunk_index < 2",
    "pages_by_uri": f"{_READ} and c.document_uri in ('{SITE}about-certhaven', '{SITE}planning-gap-analysis-2', '{SITE}nowhere')",
    "corpus_scan": "select c.document_uri as canonical_uri, c.chunk_index, c.content_hash, p.source_scope from evaluate_embeddings c join fixed_pages p on p.canonical_uri = c.document_uri where p.is_active",
    "blog_inventory": f"select post_id as id, '{SITE}blog/' || trim(url) as canonical_uri from blog where trim(coalesce(url, '')) <> ''",
    "blog_rows": """
      with p as (select post_id as id, title, posted_date, case when post_id % 3 <> 0 then post_id + 1000000 end as blog_meta_id, length(html) as n_characters from blog)
      select p.id, p.title, p.posted_date, p.blog_meta_id, upper(m.title) as meta_title, m.site as meta_description, case when m.post_id is not null then 'en' end as meta_language, p.n_characters
      from p left join blog m on m.post_id + 1000000 = p.blog_meta_id""",
    "backfill_counters": """
      select count(*) as selected_chunks, count(distinct content_hash) as unique_texts, count(distinct content_hash) as embedded_texts, count(*) as rows_updated, ceil(count(distinct content_hash) / 128.0)::bigint as batches,
             0::bigint as failed_batches, ceil(count(distinct content_hash) / 128.0)::bigint as api_requests, 0::bigint as pending_after, null::varchar as stop_reason
      from evaluate_embeddings where embedding is null or embedding_model is distinct from 'word-hashes:16'""",
    "setup_report": r"""
      with hits as (select case_id, arg_max(content_hash, struct_pack(s := top_score, h := -hit_id)) as content_hash from evaluate_retrieval where top_score between -1 and 1 and not isnan(top_score) group by 1),
      corpus as (select count(*) as n, count(*) filter (where coalesce(trim(regexp_replace(content, '\s+', ' ', 'g')) = '', true)) as empty_chunks, count(*) filter (where sha256(content) is distinct from content_hash) as hash_mismatch,
                        count(*) filter (where embedding_model = 'certhaven-embed-64') as already_embedded from evaluate_embeddings)
      select 'dimension' as rule, '128, expected 64' as subject union all select 'chunk_count', n::varchar from corpus where n <> 1000 union all select 'empty_chunks', empty_chunks::varchar from corpus where empty_chunks > 0
      union all select 'hash_mismatch', hash_mismatch::varchar from corpus where hash_mismatch > 0 union all select 'already_embedded', already_embedded::varchar from corpus where already_embedded > 0
      union all select 'document_not_active', case_id || ': ' || expected_document_uri from golden_cases where expected_document_uri is not null and expected_document_uri not in (select document_uri from evaluate_embeddings)
      union all select 'hash_not_in_corpus', case_id || ': ' || content_hash from hits where content_hash not in (select content_hash from evaluate_embeddings)
      union all select 'answerable_without_document', case_id::varchar from golden_cases where answerable and expected_document_uri is null
      union all select 'unanswerable_with_evidence', case_id::varchar from golden_cases g where not answerable and (expected_document_uri is not null or exists (select 1 from hits h where h.case_id = g.case_id))
      union all select 'hash_not_in_document', h.case_id || ': ' || h.content_hash from hits h join golden_cases g using (case_id)
        where not exists (select 1 from evaluate_embeddings e where e.document_uri = g.expected_document_uri and e.content_hash = h.content_hash)""",
    "object_requests": r"""
      with u as (select distinct trim(canonical_uri) as url from contract where trim(canonical_uri) <> ''), s as (select url, lower(regexp_extract(url, '\.([A-Za-z0-9]{1,5})(?:[?#]|$)', 1)) as suffix from u)
      select url, sha256(url) || case when suffix <> '' then '.' || suffix else '' end as cache_name, case when not starts_with(lower(url), 'https://') then 'not https' end as problem from s""",
}
