"""Queries over vectors, rankings and evaluation runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.operators import ranking, vectors
from corpusmill.sources.tables import read_table

MODEL, DIM = "certhaven-embed-64", 64


def exact_topk_grouped(spark: SparkSession, base: str) -> DataFrame:
    rows = read_table(spark, base, "embeddings")
    query = rows.where("vec_id = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    pool = vectors.nearest_chunks(rows, query, _dim(rows), 50, ["vec_id"], ["label"]).drop("rank")
    best = vectors.group_by_document(pool, ["query_id"], "label", ["vec_id"], 8, 2)
    return best.select("vec_id", "label", "score", "document_rank", "chunk_rank")


def _dim(rows: DataFrame) -> int:
    return rows.select(F.size("embedding")).first()[0]


def knn_ranks(spark: SparkSession, base: str) -> DataFrame:
    rows = read_table(spark, base, "embeddings")
    queries = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    return vectors.nearest_chunks(rows, queries, _dim(rows), 10, ["vec_id"]).select("query_id", "vec_id", "score", "rank")


def _chunks(spark: SparkSession, base: str) -> DataFrame:
    rows = vectors.covered(read_table(spark, base, "evaluate_embeddings"), MODEL)
    return rows.select("chunk_id", F.col("document_uri").alias("canonical_uri"), "source_scope", "chunk_index", "content_hash", "content", "embedding")


def _queries(chunks: DataFrame) -> DataFrame:
    return chunks.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.col("content").alias("query_text"), F.col("embedding").alias("query_embedding"))


#: Scopes that may be searched, and the two lanes they form.
PUBLIC = ("about", "audit_service", "blog", "grc", "management_training", "policy", "professional_training", "security_testing", "service_faq")


def scope_search(spark: SparkSession, base: str) -> DataFrame:
    chunks = _chunks(spark, base)
    found = vectors.search(chunks.drop("content"), _queries(chunks), DIM, list(PUBLIC), documents=3)
    return found.select("query_id", "canonical_uri", "chunk_index", "content_hash", "score", "rank", "citation_uri")


def lane_quota_merge(spark: SparkSession, base: str) -> DataFrame:
    chunks = _chunks(spark, base)
    public = vectors.narrowed(chunks, list(PUBLIC), None).withColumn("lane", F.when(F.col("source_scope") == "blog", "blog").otherwise("own"))
    limits = vectors.Limits({"own": 5, "blog": 2}, 2, 50).check({"own", "blog"})
    ties = ["content_hash", "canonical_uri", "chunk_index"]
    pool = vectors.nearest_chunks(public, _queries(chunks), DIM, limits.pool, ties, lane="lane")
    merged = vectors.merge_lanes(pool, ["query_id"], "lane", "canonical_uri", ties, limits)
    return merged.select("query_id", "lane", "canonical_uri", "chunk_index", "score", "position")


def structured_lookup(spark: SparkSession, base: str) -> DataFrame:
    chunks = read_table(spark, base, "evaluate_embeddings", ["document_uri", "source_scope", "chunk_index", "content_hash"])
    return chunks.where("source_scope = 'blog' and chunk_index < 2")


def vector_validation(spark: SparkSession, base: str) -> DataFrame:
    rows = read_table(spark, base, "evaluate_embeddings", ["embedding", "embedding_model"])
    problem = F.coalesce(vectors.vector_problem(F.col("embedding"), DIM), F.lit("none"))
    return rows.groupBy("embedding_model", problem.alias("problem")).agg(F.count("*").alias("n"))


def _valid_hits(spark: SparkSession, base: str) -> DataFrame:
    """Every case's valid hits beside what the case expects."""
    hits = read_table(spark, base, "evaluate_retrieval", ["hit_id", "case_id", "document_uri", "lane", "top_score", "recorded_at"])
    valid = hits.where("document_uri is not null and top_score between -1 and 1 and not isnan(top_score)")
    return valid.join(read_table(spark, base, "golden_cases", ["case_id", "category", "answerable", "expected_document_uri"]), "case_id")


def _best_hits(rows: DataFrame, k: int, order: list) -> DataFrame:
    """The first ``k`` rows of each case with ``rank``; each task keeps its own first ``k`` before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy(*order))).where(F.col("rank") <= k)


def _by(column: str) -> list:
    return [F.col(column).desc(), F.col("hit_id")]


def first_hit_ranks(spark: SparkSession, base: str) -> DataFrame:
    rows = _valid_hits(spark, base)
    hit = F.col("document_uri") == F.col("expected_document_uri")
    return ranking.first_hits(rows, "case_id", "top_score", "hit_id", {"document_rank": hit, "blog_rank": hit & (F.col("lane") == "blog")})


def recall_by_category(spark: SparkSession, base: str) -> DataFrame:
    first = first_hit_ranks(spark, base)
    cases = read_table(spark, base, "golden_cases", ["case_id", "category", "answerable"]).where("answerable")
    both = cases.join(first, "case_id", "left")
    return ranking.metrics_by_category(both, "category", "document_rank", [1, 10, 50])


def document_positions(spark: SparkSession, base: str) -> DataFrame:
    top = _best_hits(_valid_hits(spark, base), 50, _by("top_score"))
    return ranking.document_positions(top, "case_id", "document_uri")


def threshold_report(spark: SparkSession, base: str) -> DataFrame:
    top = _best_hits(_valid_hits(spark, base), 1, _by("top_score")).withColumn("correct", F.coalesce(F.col("document_uri") == F.col("expected_document_uri"), F.lit(False)))
    return ranking.threshold_report(top, "top_score", "correct", "answerable")


def top_overlap(spark: SparkSession, base: str) -> DataFrame:
    """Per case, how far its ten best hits and its ten latest ones name the same documents."""
    rows = _valid_hits(spark, base)
    best = _best_hits(rows, 10, _by("top_score")).groupBy("case_id").agg(F.collect_set("document_uri").alias("a"))
    late = _best_hits(rows, 10, _by("recorded_at")).groupBy("case_id").agg(F.collect_set("document_uri").alias("b"))
    return best.join(late, "case_id").select("case_id", F.round(ranking.jaccard(F.col("a"), F.col("b")), 6).alias("overlap"))


def lane_changes(spark: SparkSession, base: str) -> DataFrame:
    hit = F.col("document_uri") == F.col("expected_document_uri")
    ranks = ranking.first_hits(_valid_hits(spark, base), "case_id", "top_score", "hit_id", {"a": hit & (F.col("lane") == "blog"), "b": hit & (F.col("lane") != "blog")})
    before, after = (ranks.where(F.col(c).isNotNull()).select("case_id", F.col(c).alias("rank")) for c in "ab")
    return ranking.run_changes(before, after, "case_id")


def latency_distribution(spark: SparkSession, base: str) -> DataFrame:
    return ranking.distribution(read_table(spark, base, "events", ["event_type", "value"]), "value", ["event_type"])


def corpus_fingerprint(spark: SparkSession, base: str) -> DataFrame:
    return ranking.corpus_fingerprint(read_table(spark, base, "evaluate_embeddings", ["content_hash"]), "content_hash")


def golden_setup_problems(spark: SparkSession, base: str) -> DataFrame:
    return ranking.setup_problems(read_table(spark, base, "golden_cases"), read_table(spark, base, "fixed_pages", ["canonical_uri"]))


def strategy_grid(spark: SparkSession, base: str) -> DataFrame:
    """Recall of every combination of lane quotas over the golden cases, in one pass."""
    rows = _valid_hits(spark, base).withColumnRenamed("top_score", "score").withColumn("lane", F.when(F.col("lane") == "blog", "blog").otherwise("own"))
    pool = vectors.nearest(rows, ["case_id", "lane"], ["hit_id"], 50).drop("rank")
    grid = spark.createDataFrame([(f"{own}+{blog}", lane, quota) for own in (3, 5, 8) for blog in (0, 1, 2, 3) for lane, quota in (("own", own), ("blog", blog))], "strategy string, lane string, quota int")
    offered = pool.join(F.broadcast(grid), "lane")
    kept = vectors.group_by_document(offered, ["strategy", "case_id", "lane"], "document_uri", ["hit_id"], "quota", 2)
    hit = kept.where("document_uri = expected_document_uri").groupBy("strategy", "case_id").agg(F.lit(1).alias("hit")).groupBy("strategy").agg(F.count("*").alias("cases_hit"))
    size = kept.groupBy("strategy").agg(F.count("*").alias("chunks"))
    return size.join(hit, "strategy", "left").select("strategy", "chunks", F.coalesce("cases_hit", F.lit(0)).alias("cases_hit"))


def strategy_report(spark: SparkSession, base: str) -> DataFrame:
    """``strategy_grid`` with its two references: ``unlaned``, one pool of 8 documents, and ``home``, only the lanes of the expected page, by default quotas.

    The lanes of a page are those of its hits; a case without such a page keeps both lanes, as one without expected page does.
    """
    rows = _valid_hits(spark, base).withColumnRenamed("top_score", "score").withColumn("lane", F.when(F.col("lane") == "blog", "blog").otherwise("own"))
    hits = read_table(spark, base, "evaluate_retrieval", ["document_uri", "lane"]).where("document_uri is not null")
    lanes = hits.select(F.col("document_uri").alias("expected_document_uri"), F.when(F.col("lane") == "blog", "blog").otherwise("own").alias("lane"), F.lit(True).alias("known")).distinct()
    known = lanes.select("expected_document_uri").distinct().withColumn("page_known", F.lit(True))
    pool = vectors.nearest(rows, ["case_id", "lane"], ["hit_id"], 50).drop("rank")
    at_home = pool.join(lanes, ["expected_document_uri", "lane"], "left").join(known, "expected_document_uri", "left").where("known or page_known is null")
    home = vectors.group_by_document(at_home.withColumn("quota", F.when(F.col("lane") == "blog", 2).otherwise(5)), ["case_id", "lane"], "document_uri", ["hit_id"], "quota", 2)
    one = vectors.nearest(rows.drop("lane"), ["case_id"], ["hit_id"], 50).drop("rank")
    unlaned = vectors.group_by_document(one, ["case_id"], "document_uri", ["hit_id"], 8, 2)
    both = None
    for name, kept in (("unlaned", unlaned), ("home", home)):
        part = kept.select(F.lit(name).alias("strategy"), "case_id", F.coalesce(F.col("document_uri") == F.col("expected_document_uri"), F.lit(False)).alias("hit"))
        both = part if both is None else both.unionByName(part)
    found = both.groupBy("strategy").agg(F.count("*").alias("chunks"), F.count_distinct(F.when(F.col("hit"), F.col("case_id"))).alias("cases_hit"))
    return strategy_grid(spark, base).unionByName(found)


def exact_topk_grouped_all(spark: SparkSession, base: str) -> DataFrame:
    """``exact_topk_grouped`` for every query of the stated set, those whose id is divisible by 50."""
    rows = read_table(spark, base, "embeddings")
    queries = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    pool = vectors.nearest_chunks(rows, queries, _dim(rows), 50, ["vec_id"], ["label"]).drop("rank")
    best = vectors.group_by_document(pool, ["query_id"], "label", ["vec_id"], 8, 2)
    return best.select("query_id", "vec_id", "label", "score", "document_rank", "chunk_rank")


QUERIES = {
    f.__name__: f
    for f in (
        exact_topk_grouped, knn_ranks, scope_search, lane_quota_merge, structured_lookup, vector_validation, first_hit_ranks, recall_by_category, document_positions,
        threshold_report, top_overlap, lane_changes, latency_distribution, corpus_fingerprint, golden_setup_problems, strategy_grid, strategy_report, exact_topk_grouped_all,
    )
}


def _cos(a: str, b: str) -> str:
    x, y = f"list_transform({a}, lambda x: x::double)", f"list_transform({b}, lambda x: x::double)"
    return f"round(list_inner_product({x}, {y}) / (sqrt(list_inner_product({x}, {x})) * sqrt(list_inner_product({y}, {y}))), 6)"


_USABLE = "embedding_model = 'certhaven-embed-64' and len(embedding) = 64 and not list_bool_or(list_transform(embedding, lambda x: x is null or isnan(x) or isinf(x))) and list_bool_or(list_transform(embedding, lambda x: x <> 0))"
_PUBLIC = ", ".join(f"'{s}'" for s in PUBLIC)
_HITS = """
  ranked as (select e.hit_id, e.case_id, e.document_uri, e.lane, e.top_score, e.recorded_at, g.category, g.answerable, g.expected_document_uri,
                    row_number() over (partition by e.case_id order by e.top_score desc, e.hit_id) as rank
             from evaluate_retrieval e join golden_cases g using (case_id)
             where e.document_uri is not null and not isnan(e.top_score) and e.top_score between -1 and 1)"""
_SCORED = f"""
  c as (select chunk_id, document_uri as canonical_uri, source_scope, chunk_index, content_hash, content, embedding from evaluate_embeddings where {_USABLE}),
  s as (select q.chunk_id as query_id, c.canonical_uri, c.source_scope, c.chunk_index, c.content_hash, {_cos('c.embedding', 'q.embedding')} as score
        from c, (select chunk_id, embedding, content from c where chunk_id % 50 = 0) q where c.source_scope in ({_PUBLIC}) and length(trim(q.content)) between 1 and 2000)"""
_FIRST = """first as (select case_id, min(rank) filter (where document_uri = expected_document_uri)::int as document_rank,
                      min(rank) filter (where document_uri = expected_document_uri and lane = 'blog')::int as blog_rank from ranked group by 1)"""
_METRICS = """count(*) as cases, round(count(*) filter (where document_rank <= 1) / greatest(count(*), 1), 6) as recall_1, round(count(*) filter (where document_rank <= 10) / greatest(count(*), 1), 6) as recall_10,
  round(count(*) filter (where document_rank <= 50) / greatest(count(*), 1), 6) as recall_50, round(coalesce(sum(1.0 / document_rank), 0) / greatest(count(*), 1), 6) as mrr"""

SQL = {
    "exact_topk_grouped": f"""
      with s as (select e.vec_id, e.label, {_cos('e.embedding', 'q.embedding')} as score from embeddings e, (select embedding from embeddings where vec_id = 0) q),
      p as (select * from s order by score desc, vec_id limit 50),
      k as (select *, row_number() over (partition by label order by score desc, vec_id) as chunk_rank from p),
      d as (select label, row_number() over (order by score desc, vec_id, label) as document_rank from k where chunk_rank = 1)
      select vec_id, label, score, document_rank::int as document_rank, chunk_rank::int as chunk_rank from k join d using (label) where chunk_rank <= 2 and document_rank <= 8""",
    "exact_topk_grouped_all": f"""
      with s as (select q.vec_id as query_id, e.vec_id, e.label, {_cos('e.embedding', 'q.embedding')} as score from embeddings e, (select vec_id, embedding from embeddings where vec_id % 50 = 0) q),
      p as (select * from s qualify row_number() over (partition by query_id order by score desc, vec_id) <= 50),
      k as (select *, row_number() over (partition by query_id, label order by score desc, vec_id) as chunk_rank from p),
      d as (select query_id, label, row_number() over (partition by query_id order by score desc, vec_id, label) as document_rank from k where chunk_rank = 1)
      select query_id, vec_id, label, score, document_rank::int as document_rank, chunk_rank::int as chunk_rank from k join d using (query_id, label) where chunk_rank <= 2 and document_rank <= 8""",
    "knn_ranks": f"""
      with s as (select q.vec_id as query_id, e.vec_id, {_cos('e.embedding', 'q.embedding')} as score from embeddings e, (select vec_id, embedding from embeddings where vec_id % 50 = 0) q),
      r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
      select query_id, vec_id, score, rank::int as rank from r where rank <= 10""",
    "scope_search": f"""
      with {_SCORED},
      p as (select * from s qualify row_number() over (partition by query_id order by score desc, content_hash, canonical_uri, chunk_index) <= 50),
      k as (select *, row_number() over (partition by query_id, canonical_uri order by score desc, content_hash, canonical_uri, chunk_index) as chunk_rank from p),
      d as (select query_id, canonical_uri, row_number() over (partition by query_id order by score desc, content_hash, canonical_uri, chunk_index) as document_rank from k where chunk_rank = 1)
      select query_id, canonical_uri, chunk_index, content_hash, score, row_number() over (partition by query_id order by document_rank, chunk_rank)::int as rank,
             case when starts_with(canonical_uri, 'https://') then canonical_uri end as citation_uri
      from k join d using (query_id, canonical_uri) where chunk_rank <= 2 and document_rank <= 3""",
    "lane_quota_merge": f"""
      with {_SCORED.replace("and length(trim(q.content)) between 1 and 2000", "")},
      l as (select *, case when source_scope = 'blog' then 'blog' else 'own' end as lane from s),
      p as (select * from l qualify row_number() over (partition by query_id, lane order by score desc, content_hash, canonical_uri, chunk_index) <= 50),
      k as (select *, row_number() over (partition by query_id, lane, canonical_uri order by score desc, content_hash, canonical_uri, chunk_index) as chunk_rank from p),
      d as (select query_id, lane, canonical_uri, score as best, content_hash as best_hash, chunk_index as best_index,
                   row_number() over (partition by query_id, lane order by score desc, content_hash, canonical_uri, chunk_index) as document_rank from k where chunk_rank = 1)
      select query_id, lane, canonical_uri, chunk_index, score,
             row_number() over (partition by query_id order by best desc, best_hash, canonical_uri, best_index, chunk_rank)::int as position
      from k join d using (query_id, lane, canonical_uri) where chunk_rank <= 2 and document_rank <= case lane when 'own' then 5 else 2 end""",
    "structured_lookup": "select document_uri, source_scope, chunk_index, content_hash from evaluate_embeddings where source_scope = 'blog' and chunk_index < 2",
    "vector_validation": """
      select embedding_model, case when embedding is null then 'missing' when len(embedding) <> 64 then 'dimension'
        when list_bool_or(list_transform(embedding, lambda x: x is null or isnan(x) or isinf(x))) then 'not_finite'
        when not list_bool_or(list_transform(embedding, lambda x: x <> 0)) then 'zero' else 'none' end as problem, count(*) as n from evaluate_embeddings group by 1, 2""",
    "first_hit_ranks": f"with {_HITS}, {_FIRST} select case_id, document_rank, blog_rank from first",
    "recall_by_category": f"""
      with {_HITS}, {_FIRST}, b as (select g.category, f.document_rank from golden_cases g left join first f using (case_id) where g.answerable)
      select category, 0 as is_total, {_METRICS} from b group by category union all select null, 1, {_METRICS} from b""",
    "document_positions": f"""
      with {_HITS}, f as (select case_id, document_uri, min(rank) as r from ranked where rank <= 50 group by 1, 2)
      select case_id, document_uri, row_number() over (partition by case_id order by r, document_uri)::int as position from f""",
    "threshold_report": f"""
      with {_HITS}, t as (select *, coalesce(document_uri = expected_document_uri, false) as correct from ranked where rank = 1),
      e as (select min(top_score) filter (where answerable and correct) as weakest_correct, max(top_score) filter (where not answerable) as strongest_unanswerable from t)
      select weakest_correct, strongest_unanswerable, (select count(*) from t where top_score >= weakest_correct) as strong_candidates from e""",
    "top_overlap": f"""
      with {_HITS}, l as (select *, row_number() over (partition by case_id order by recorded_at desc, hit_id) as late from ranked),
      s as (select case_id, coalesce(list(distinct document_uri) filter (where rank <= 10), []) as a, coalesce(list(distinct document_uri) filter (where late <= 10), []) as b from l group by 1)
      select case_id, round(case when len(list_distinct(list_concat(a, b))) = 0 then 1.0 else len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) end, 6) as overlap from s""",
    "lane_changes": f"""
      with {_HITS}, a as (select case_id, min(rank)::int as before from ranked where document_uri = expected_document_uri and lane = 'blog' group by 1),
      b as (select case_id, min(rank)::int as after from ranked where document_uri = expected_document_uri and lane <> 'blog' group by 1),
      c as (select case_id, before, after, case when after is null then 'lost' when before is null then 'found' when after > before then 'worse' when after < before then 'better' end as change from a full join b using (case_id))
      select case_id, before, after, change from c where change is not null""",
    "latency_distribution": """select event_type, count(*) as n, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95, max(value) as greatest, round(avg(value), 6) as mean
      from events where value is not null and not isnan(value) group by 1""",
    "corpus_fingerprint": """
      select sha256(coalesce(string_agg(content_hash, '' order by content_hash), '')) as fingerprint, count(content_hash) as hashes from evaluate_embeddings""",
    "golden_setup_problems": """
      select 'empty_query' as rule, case_id from golden_cases where trim(coalesce(query_text, '')) = ''
      union all select 'repeated_query', case_id from golden_cases qualify count(*) over (partition by lower(trim(query_text)), category) > 1
      union all select 'no_document', case_id from golden_cases where answerable and expected_document_uri is null
      union all select 'needless_document', case_id from golden_cases where not answerable and expected_document_uri is not null
      union all select 'missing_document', case_id from golden_cases g where expected_document_uri is not null and not exists (select 1 from fixed_pages f where f.canonical_uri = g.expected_document_uri)""",
    "strategy_grid": f"""
      with {_HITS}, l as (select hit_id, case_id, document_uri, expected_document_uri, top_score, case when lane = 'blog' then 'blog' else 'own' end as lane from ranked),
      p as (select * from l qualify row_number() over (partition by case_id, lane order by top_score desc, hit_id) <= 50),
      k as (select *, row_number() over (partition by case_id, lane, document_uri order by top_score desc, hit_id) as chunk_rank from p),
      d as (select case_id, lane, document_uri, row_number() over (partition by case_id, lane order by top_score desc, hit_id, document_uri) as document_rank from k where chunk_rank = 1),
      g as (select o.own || '+' || b.blog as strategy, t.lane, case t.lane when 'own' then o.own else b.blog end as quota
            from (values (3), (5), (8)) o(own), (values (0), (1), (2), (3)) b(blog), (values ('own'), ('blog')) t(lane)),
      x as (select g.strategy, k.* from k join d using (case_id, lane, document_uri) join g using (lane) where chunk_rank <= 2 and document_rank <= g.quota)
      select strategy, count(*) as chunks, count(distinct case_id) filter (where document_uri = expected_document_uri) as cases_hit from x group by 1""",
}
SQL["strategy_report"] = f"""
      with {_HITS}, l as (select hit_id, case_id, document_uri, expected_document_uri, top_score, case when lane = 'blog' then 'blog' else 'own' end as lane from ranked),
      lanes as (select distinct document_uri as page, case when lane = 'blog' then 'blog' else 'own' end as lane from evaluate_retrieval where document_uri is not null),
      p as (select * from l qualify row_number() over (partition by case_id, lane order by top_score desc, hit_id) <= 50),
      home as (select * from p where (expected_document_uri, lane) in (select page, lane from lanes) or expected_document_uri is null or expected_document_uri not in (select page from lanes)),
      hk as (select *, row_number() over (partition by case_id, lane, document_uri order by top_score desc, hit_id) as chunk_rank from home),
      hd as (select case_id, lane, document_uri, row_number() over (partition by case_id, lane order by top_score desc, hit_id, document_uri) as document_rank from hk where chunk_rank = 1),
      one as (select * from l qualify row_number() over (partition by case_id order by top_score desc, hit_id) <= 50),
      uk as (select *, row_number() over (partition by case_id, document_uri order by top_score desc, hit_id) as chunk_rank from one),
      ud as (select case_id, document_uri, row_number() over (partition by case_id order by top_score desc, hit_id, document_uri) as document_rank from uk where chunk_rank = 1),
      x as (select 'home' as strategy, case_id, document_uri = expected_document_uri as hit from hk join hd using (case_id, lane, document_uri) where chunk_rank <= 2 and document_rank <= case lane when 'blog' then 2 else 5 end
            union all select 'unlaned', case_id, document_uri = expected_document_uri from uk join ud using (case_id, document_uri) where chunk_rank <= 2 and document_rank <= 8)
      select strategy, chunks, cases_hit from ({SQL["strategy_grid"]})
      union all select strategy, count(*), count(distinct case_id) filter (where hit) from x group by 1"""
