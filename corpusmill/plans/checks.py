"""Queries over assets, records, gates and fidelity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import assets, vectors
from corpusmill.plans import retrieval
from corpusmill.sources.tables import read_table

MEDIA = "https://media.certhaven.example"


def json_string_values(spark: SparkSession, base: str) -> DataFrame:
    rows = read_table(spark, base, "contract", ["blocks"])
    values = rows.select(F.explode(assets.json_strings(F.col("blocks"))).alias("v"))
    return values.groupBy(F.sha2("v", 256).alias("digest")).agg(F.count("*").alias("n"))


def asset_urls(spark: SparkSession, base: str) -> DataFrame:
    docs = read_table(spark, base, "documents", ["doc_id", "source", "lang"])
    path = F.when(F.col("lang") == "de", F.concat(F.lit("//cdn.certhaven.example/"), "source")).when(F.col("lang") == "fr", F.concat(F.lit("http://old.example/"), "source")).otherwise(F.concat(F.lit("/"), "source", F.lit("/a b/"), F.col("doc_id").cast("string"), F.lit(".png")))
    return docs.select("doc_id", assets.public_url(path, MEDIA).alias("url"))


def asset_keys(spark: SparkSession, base: str) -> DataFrame:
    docs = read_table(spark, base, "documents", ["doc_id", "source", "content_type"])
    name = F.concat(F.when(F.col("content_type") == "mail", "x/").otherwise(""), F.col("doc_id").cast("string"), F.when(F.col("content_type") == "note", ".gif").otherwise(".png"))
    return docs.select("doc_id", assets.image_key(F.concat(F.lit("/"), "source", F.lit("/")), name).alias("image_key"))


def evaluation_gates(spark: SparkSession, base: str) -> DataFrame:
    total = retrieval.recall_by_category(spark, base).where("is_total = 1")
    return assets.gates(total, [("recall at ten", "recall_10", 0.9, 0.05), ("reciprocal rank", "mrr", 0.9, 0.5), ("cases", "cases", 100, 1000)])


def replay_verification(spark: SparkSession, base: str) -> DataFrame:
    """Chunks that are not what their stored hash says, from both sides, the hash of a chunk being that of its text without surplus blanks."""
    rows = read_table(spark, base, "evaluate_embeddings", ["chunk_id", "content", "content_hash"])
    again = rows.select("chunk_id", F.sha2(F.trim("content"), 256).alias("content_hash"))
    return assets.replay_differences(rows.select("chunk_id", "content_hash"), again, ["chunk_id", "content_hash"])


def case_problems(spark: SparkSession, base: str) -> DataFrame:
    cases = read_table(spark, base, "golden_cases")
    return assets.record_problems(cases, "case_id", ["expected_document_uri", "query_text"], ["query_text"], {"category": ("image", "training")}, ["case_id"])


def half_precision_fidelity(spark: SparkSession, base: str) -> DataFrame:
    """Per query, whether half-precision vectors keep the best chunk, and how many of the ten best they share."""
    rows = read_table(spark, base, "embeddings")
    dim = rows.select(F.size("embedding")).first()[0]
    queries = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    sets = []
    for half in (False, True):
        near = vectors.nearest_chunks(rows, queries, dim, 10, ["vec_id"], half=half)
        sets.append(near.groupBy("query_id").agg(F.min_by("vec_id", "rank").alias("best"), F.collect_set("vec_id").alias("ten")))
    both = sets[0].alias("a").join(sets[1].alias("b"), "query_id")
    return both.select("query_id", (F.col("a.best") == F.col("b.best")).alias("same_best"), F.size(F.array_intersect("a.ten", "b.ten")).alias("shared"))


QUERIES = {f.__name__: f for f in (json_string_values, asset_urls, asset_keys, evaluation_gates, replay_verification, case_problems, half_precision_fidelity)}

_HALF = "list_transform(embedding, lambda x: round_even(x::double / {s}, 0) * {s})".format(s="pow(2, greatest(floor(log2(greatest(abs(x::double), 1e-30))), -14) - 10)")


def _ten(vectors: str) -> str:
    """The ten best of every query as (query_id, best, ten)."""
    return f"""select query_id, arg_min(vec_id, rank) as best, list(vec_id) as ten from (
        select q.vec_id as query_id, e.vec_id, row_number() over (partition by q.vec_id order by round(list_inner_product(e.v, q.v) / (sqrt(list_inner_product(e.v, e.v)) * sqrt(list_inner_product(q.v, q.v))), 6) desc, e.vec_id) as rank
        from {vectors} e, (select * from {vectors} where vec_id % 50 = 0) q) where rank <= 10 group by 1"""


_RECALL = retrieval.SQL["recall_by_category"]
SQL = {
    "half_precision_fidelity": f"""
      with f as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings), h as (select vec_id, {_HALF} as v from embeddings),
      a as ({_ten('f')}), b as ({_ten('h')})
      select query_id, a.best = b.best as same_best, len(list_intersect(a.ten, b.ten))::int as shared from a join b using (query_id)""",
    "json_string_values": "with s as (select json_extract_string(t.atom, '$') as v from contract c, json_tree(c.blocks) t where t.type = 'VARCHAR') select sha256(v) as digest, count(*) as n from s group by 1",
    "asset_urls": f"""select doc_id, case when lang = 'de' then 'https://cdn.certhaven.example/' || source when lang = 'fr' then 'http://old.example/' || source
      else '{MEDIA}/' || source || '/a%20b/' || doc_id || '.png' end as url from documents""",
    "asset_keys": "select doc_id, case when content_type not in ('mail', 'note') then source || '/' || doc_id || '.png' end as image_key from documents",
    "evaluation_gates": f"""with t as (select * from ({_RECALL}) where is_total = 1)
      select 'recall at ten' as gate, recall_10::double as value, case when recall_10 >= 0.9 then 'PASS' when recall_10 >= 0.05 then 'REVIEW' else 'FAIL' end as verdict from t
      union all select 'reciprocal rank', mrr::double, case when mrr >= 0.9 then 'PASS' when mrr >= 0.5 then 'REVIEW' else 'FAIL' end from t
      union all select 'cases', cases::double, case when cases <= 100 then 'PASS' when cases <= 1000 then 'REVIEW' else 'FAIL' end from t""",
    "replay_verification": """
      with d as (select chunk_id, content_hash, sha256(trim(content, ' ')) as again from evaluate_embeddings)
      select chunk_id, content_hash, 'stored' as side, 1::bigint as copies from d where again is distinct from content_hash
      union all select chunk_id, again, 'recomputed', 1::bigint from d where again is distinct from content_hash""",
    "case_problems": """
      select case_id, 'expected_document_uri must be a string' as problem from golden_cases where expected_document_uri is null
      union all select case_id, 'query_text must be a string' from golden_cases where query_text is null
      union all select case_id, 'query_text must not be empty' from golden_cases where trim(coalesce(query_text, 'x'), ' ') = ''
      union all select case_id, 'unknown category' from golden_cases where category is null or category not in ('image', 'training')
      union all select case_id, 'case_id must be positive' from golden_cases where case_id is null or case_id < 1""",
}
