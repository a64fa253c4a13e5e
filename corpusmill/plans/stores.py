"""Queries over synchronisation, run ledgers and backfill."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.operators import backfill, matching, synchronize
from corpusmill.operators.snapshots import good_runs
from corpusmill.plans.retrieval import MODEL
from corpusmill.sources.tables import read_table
from corpusmill.streaming.micro_batches import windowed_counts


def _deliveries(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    """The pages of each scope's first run as a store, and all records of its last run as a delivery."""
    runs = read_table(spark, base, "runs", ["run_id", "source_scope"])
    ends = runs.groupBy("source_scope").agg(F.min("run_id").alias("first_run"), F.max("run_id").alias("last_run"))
    records = read_table(spark, base, "contract", ["record_id", "run_id", "source_scope", "canonical_uri", "title", "blocks", "lang", "extractor_version"])
    records = records.join(ends, "source_scope").withColumn("content_hash", F.sha2(F.concat_ws("|", "title", "blocks"), 256))
    fixed = [F.lit(1).alias("hash_version"), F.lit(3).alias("normalizer_version"), "extractor_version", F.lit(3).alias("chunker_version")]
    first = records.where("run_id = first_run").withColumn("__rn", F.row_number().over(Window.partitionBy("canonical_uri").orderBy(F.col("record_id").desc()))).where("__rn = 1")
    store = first.select("canonical_uri", "source_scope", F.when(F.col("lang") == "fr", "archived").otherwise("active").alias("status"), "content_hash", *fixed)
    delivery = records.where("run_id = last_run").select("canonical_uri", "source_scope", F.col("record_id").alias("ordinal"), "content_hash", *fixed)
    return store, delivery


def sync_outcomes(spark: SparkSession, base: str) -> DataFrame:
    store, delivery = _deliveries(spark, base)
    return synchronize.record_outcomes(store, delivery).select("canonical_uri", "ordinal", "outcome", "rebuild")


def sync_counters(spark: SparkSession, base: str) -> DataFrame:
    store, delivery = _deliveries(spark, base)
    return synchronize.outcome_counts(synchronize.record_outcomes(store, delivery))


def reconcile_missing(spark: SparkSession, base: str) -> DataFrame:
    store, delivery = _deliveries(spark, base)
    return synchronize.missing_pages(store, delivery, F.col("source_scope"))


def store_after_run(spark: SparkSession, base: str) -> DataFrame:
    store, delivery = _deliveries(spark, base)
    store = store.withColumns({"gone_count": F.lit(1), "consecutive_failure_count": F.lit(2), "last_seen_at": F.lit(None).cast("timestamp"), "last_run_id": F.lit("before")})
    outcomes = synchronize.record_outcomes(store, delivery)
    missing = synchronize.missing_pages(store, delivery, F.col("source_scope"))
    failures = spark.createDataFrame([], "canonical_uri string, failed int")
    after = synchronize.next_store(store, outcomes, failures, missing, F.lit("now"), F.lit("2025-01-01").cast("timestamp"))
    return after.select("canonical_uri", "status", "gone_count", "consecutive_failure_count", "last_run_id", "content_hash")


def empty_inventory_guard(spark: SparkSession, base: str) -> DataFrame:
    """Scopes that hold active pages while a complete, empty inventory came in: they are not reconciled."""
    store, delivery = _deliveries(spark, base)
    listed = delivery.where("source_scope <> 'blog-00003'").select("source_scope").distinct()
    held = store.where("status = 'active'").groupBy("source_scope").agg(F.count("*").alias("active_pages"))
    return held.join(listed, "source_scope", "left_anti")


def _every_run(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The store of ``_deliveries``, the records of every run after the first of its scope, and those of these runs that are good, so that their inventories are complete."""
    runs = read_table(spark, base, "runs")
    later = runs.withColumn("first_run", F.min("run_id").over(Window.partitionBy("source_scope"))).where("run_id > first_run").drop("first_run")
    records = read_table(spark, base, "contract", ["record_id", "run_id", "source_scope", "canonical_uri", "title", "blocks", "extractor_version"])
    fixed = [F.lit(1).alias("hash_version"), F.lit(3).alias("normalizer_version"), "extractor_version", F.lit(3).alias("chunker_version")]
    after = records.join(later.select("run_id"), "run_id", "left_semi")
    deliveries = after.select("run_id", "canonical_uri", "source_scope", F.col("record_id").alias("ordinal"), F.sha2(F.concat_ws("|", "title", "blocks"), 256).alias("content_hash"), *fixed)
    return _deliveries(spark, base)[0], deliveries, later.join(good_runs(later).select("run_id"), "run_id", "left_semi").select("run_id", "source_scope")


def sync_outcomes_by_run(spark: SparkSession, base: str) -> DataFrame:
    """What every record of every run after the first does to the store that the runs before it left."""
    store, deliveries, _ = _every_run(spark, base)
    return synchronize.outcomes_of_runs(store, deliveries).select("run_id", "canonical_uri", "ordinal", "outcome", "rebuild")


def sync_counters_by_run(spark: SparkSession, base: str) -> DataFrame:
    store, deliveries, _ = _every_run(spark, base)
    return synchronize.outcome_counts(synchronize.outcomes_of_runs(store, deliveries).groupBy("run_id"))


def reconcile_missing_by_run(spark: SparkSession, base: str) -> DataFrame:
    return synchronize.missing_by_run(*_every_run(spark, base))


def store_after_every_run(spark: SparkSession, base: str) -> DataFrame:
    store, deliveries, complete = _every_run(spark, base)
    store = store.withColumns({"gone_count": F.lit(1), "consecutive_failure_count": F.lit(2), "last_seen_at": F.lit(None).cast("timestamp"), "last_run_id": F.lit("before")})
    after = synchronize.store_after_runs(store, deliveries, complete, F.lit("2025-01-01").cast("timestamp"))
    return after.select("canonical_uri", "status", "gone_count", "consecutive_failure_count", "last_run_id", "content_hash")


def empty_inventory_guard_by_run(spark: SparkSession, base: str) -> DataFrame:
    """Runs whose complete inventory came in empty while their scope held active pages, those of one scope taken as empty: they are not reconciled."""
    store, deliveries, complete = _every_run(spark, base)
    listed = deliveries.where("source_scope <> 'blog-00003'").select("run_id").distinct()
    held = synchronize.pages_of_runs(store, deliveries, complete).groupBy("run_id", "source_scope").agg(F.count("*").alias("active_pages"))
    return held.join(listed, "run_id", "left_anti")


def failure_counters(spark: SparkSession, base: str) -> DataFrame:
    events = read_table(spark, base, "events", ["event_id", "user_id", "event_type"])
    log = events.select(F.col("user_id").cast("string").alias("canonical_uri"), F.col("event_id").alias("ordinal"), (F.col("event_type") != "error").alias("succeeded"), F.lit(3).alias("stored_failures"))
    return synchronize.failure_streaks(log)


def run_ledger_latest(spark: SparkSession, base: str) -> DataFrame:
    return synchronize.latest_runs(read_table(spark, base, "runs")).select("source_scope", "run_id", "run_status", "started_at")


def stale_run_sweep(spark: SparkSession, base: str) -> DataFrame:
    runs = read_table(spark, base, "runs", ["run_id", "run_status", "finished_at", "abort_reason"])
    return synchronize.sweep_stale(runs, F.lit("2026-01-01 00:00:00").cast("timestamp"))


def state_transitions(spark: SparkSession, base: str) -> DataFrame:
    """Scopes whose last run ended otherwise than the one before it."""
    order = Window.partitionBy("source_scope").orderBy(F.col("started_at").desc(), F.col("run_id").desc())
    runs = read_table(spark, base, "runs", ["run_id", "source_scope", "run_status", "started_at"]).withColumn("rn", F.row_number().over(order))
    return matching.state_transitions(runs.where("rn = 2"), runs.where("rn = 1"), "source_scope", "run_status")


def _chunks(spark: SparkSession, base: str) -> DataFrame:
    return read_table(spark, base, "evaluate_embeddings", ["chunk_id", "content_hash", "content", "embedding", "embedding_model"])


def pending_plan(spark: SparkSession, base: str) -> DataFrame:
    return backfill.plan(_chunks(spark, base), MODEL).select("content_hash", F.sha2("content", 256).alias("digest"))


def backfill_batches(spark: SparkSession, base: str) -> DataFrame:
    batches = backfill.in_batches(backfill.plan(_chunks(spark, base), MODEL), 128)
    return batches.groupBy("batch_no").agg(F.count("*").alias("texts"), F.min("content_hash").alias("first_hash"))


def backfill_estimate(spark: SparkSession, base: str) -> DataFrame:
    return backfill.estimate(backfill.plan(_chunks(spark, base), MODEL))


def broken_hashes(spark: SparkSession, base: str) -> DataFrame:
    return backfill.broken_hashes(_chunks(spark, base))


def vector_writeback(spark: SparkSession, base: str) -> DataFrame:
    """Pending chunks filled with the vector another chunk of the same text has."""
    chunks = _chunks(spark, base)
    ready = chunks.where(F.col("embedding").isNotNull() & (F.col("embedding_model") == MODEL))
    vectors = ready.groupBy("content_hash").agg(F.min_by("embedding", "chunk_id").alias("embedding"))
    filled = backfill.write_back(chunks, vectors, MODEL)
    return filled.groupBy("embedding_model").agg(F.count("*").alias("chunks"), F.count("embedding").alias("with_vector"))


def missing_vectors(spark: SparkSession, base: str) -> DataFrame:
    chunks = _chunks(spark, base)
    store = chunks.where(F.col("embedding_model") == MODEL).select("content_hash")
    return backfill.missing_keys(chunks.select("content_hash").distinct(), store)


def duplicate_content(spark: SparkSession, base: str) -> DataFrame:
    chunks = read_table(spark, base, "evaluate_embeddings", ["chunk_id", "content_hash", "document_uri"])
    return chunks.groupBy("content_hash").agg(F.count("*").alias("chunks"), F.count_distinct("document_uri").alias("documents"), F.min("chunk_id").alias("first_chunk")).where("chunks > 1")


def hourly_events(spark: SparkSession, base: str) -> DataFrame:
    return windowed_counts(read_table(spark, base, "events", ["ts", "event_type", "value"]), "ts", ["event_type"])


QUERIES = {
    f.__name__: f
    for f in (
        sync_outcomes, sync_counters, reconcile_missing, store_after_run, empty_inventory_guard, sync_outcomes_by_run, sync_counters_by_run, reconcile_missing_by_run,
        store_after_every_run, empty_inventory_guard_by_run, failure_counters, run_ledger_latest, stale_run_sweep, state_transitions,
        pending_plan, backfill_batches, backfill_estimate, broken_hashes, vector_writeback, missing_vectors, duplicate_content, hourly_events,
    )
}

_DELIVERIES = """
  ends as (select source_scope, min(run_id) as first_run, max(run_id) as last_run from runs group by 1),
  rec as (select c.*, e.first_run, e.last_run, sha256(concat_ws('|', c.title, c.blocks)) as content_hash from contract c join ends e using (source_scope)),
  store as (select canonical_uri, source_scope, case when lang = 'fr' then 'archived' else 'active' end as status, content_hash, extractor_version
            from rec where run_id = first_run qualify row_number() over (partition by canonical_uri order by record_id desc) = 1),
  delivery as (select canonical_uri, source_scope, record_id as ordinal, content_hash, extractor_version from rec where run_id = last_run and canonical_uri is not null),
  seen as (select d.*, s.canonical_uri is not null as stored, s.status = 'archived' as archived, s.content_hash as old_hash, s.extractor_version as old_version,
                  row_number() over w as rn, lag(d.content_hash) over w as lag_hash, lag(d.extractor_version) over w as lag_version, row_number() over (partition by d.canonical_uri order by d.ordinal desc, d.content_hash desc) = 1 as is_last
           from delivery d left join store s using (canonical_uri) window w as (partition by d.canonical_uri order by d.ordinal, d.content_hash)),
  outcomes as (select canonical_uri, ordinal, content_hash, is_last,
      case when rn = 1 and not stored then 'new' when rn = 1 and archived then 'restored'
           when (case when rn = 1 then old_version else lag_version end) is not distinct from extractor_version
             then case when (case when rn = 1 then old_hash else lag_hash end) is not distinct from content_hash then 'unchanged' else 'changed' end
           else 'reprocessed' end as outcome,
      not ((case when rn = 1 then old_version else lag_version end) is not distinct from extractor_version and (case when rn = 1 then old_hash else lag_hash end) is not distinct from content_hash) as rebuild
    from seen)"""
_PENDING = f"pending as (select content_hash, arg_min(content, chunk_id) as content from evaluate_embeddings where embedding is null or embedding_model is distinct from '{MODEL}' group by 1)"

SQL = {
    "sync_outcomes": f"with {_DELIVERIES} select canonical_uri, ordinal, outcome, rebuild from outcomes",
    "sync_counters": f"with {_DELIVERIES} select " + ", ".join(f"count(*) filter (where outcome = '{k}') as {k}" for k in ("new", "unchanged", "changed", "reprocessed", "restored")) + " from outcomes",
    "reconcile_missing": f"with {_DELIVERIES} select canonical_uri from store s where status = 'active' and not exists (select 1 from delivery d where d.canonical_uri = s.canonical_uri)",
    "store_after_run": f"""with {_DELIVERIES}, l as (select *, bool_or(outcome <> 'unchanged') over (partition by canonical_uri) as rewritten from outcomes qualify is_last),
      m as (select canonical_uri from store s where status = 'active' and not exists (select 1 from delivery d where d.canonical_uri = s.canonical_uri))
      select coalesce(s.canonical_uri, l.canonical_uri) as canonical_uri, case when l.outcome is not null then 'active' else s.status end as status,
        (case when l.outcome is not null then 0 else 1 end + case when m.canonical_uri is not null then 1 else 0 end)::int as gone_count,
        (case when l.outcome is not null then 0 else 2 end)::int as consecutive_failure_count, case when l.outcome is not null then 'now' else 'before' end as last_run_id,
        case when l.rewritten then l.content_hash else s.content_hash end as content_hash
      from store s full join l using (canonical_uri) left join m on m.canonical_uri = coalesce(s.canonical_uri, l.canonical_uri)""",
    "empty_inventory_guard": f"""with {_DELIVERIES} select source_scope, count(*) as active_pages from store where status = 'active'
      and source_scope not in (select source_scope from delivery where source_scope <> 'blog-00003') group by 1""",
    "failure_counters": """
      with l as (select user_id, event_id, event_type <> 'error' as ok, max(event_id) filter (where event_type <> 'error') over (partition by user_id) as last_ok from events)
      select user_id::varchar as canonical_uri, count(*) filter (where not ok and (last_ok is null or event_id > last_ok)) + max(case when last_ok is null then 3 else 0 end) as failures from l group by 1""",
    "run_ledger_latest": "select source_scope, run_id, run_status, started_at from runs qualify row_number() over (partition by source_scope order by started_at desc, run_id desc) = 1",
    "stale_run_sweep": """select run_id, case when run_status = 'running' then 'aborted' else run_status end as run_status,
      case when run_status = 'running' then timestamptz '2026-01-01 00:00:00+00' else finished_at end as finished_at, case when run_status = 'running' then 'stale_run' else abort_reason end as abort_reason from runs""",
    "state_transitions": """
      with r as (select source_scope, run_status, row_number() over (partition by source_scope order by started_at desc, run_id desc) as rn from runs),
      p as (select coalesce(a.source_scope, b.source_scope) as source_scope, b.run_status as before, a.run_status as after from (select * from r where rn = 1) a full join (select * from r where rn = 2) b on a.source_scope = b.source_scope)
      select source_scope, before, after from p where before is distinct from after""",
    "pending_plan": f"with {_PENDING} select content_hash, sha256(content) as digest from pending",
    "backfill_batches": f"""with {_PENDING}, b as (select content_hash, (row_number() over (order by content_hash) - 1) // 128 as batch_no from pending)
      select batch_no::bigint as batch_no, count(*) as texts, min(content_hash) as first_hash from b group by 1""",
    "backfill_estimate": f"with {_PENDING} select count(*) as texts, coalesce(sum(length(content)), 0)::bigint as characters, ceil(coalesce(sum(length(content)), 0) / 4.0)::bigint as tokens from pending",
    "broken_hashes": "select chunk_id, content_hash from evaluate_embeddings where sha256(content) is distinct from content_hash",
    "vector_writeback": f"""
      with v as (select content_hash, arg_min(embedding, chunk_id) as e from evaluate_embeddings where embedding is not null and embedding_model = '{MODEL}' group by 1),
      f as (select case when (c.embedding is null or c.embedding_model is distinct from '{MODEL}') and v.e is not null then '{MODEL}' else c.embedding_model end as embedding_model,
                   case when (c.embedding is null or c.embedding_model is distinct from '{MODEL}') and v.e is not null then v.e else c.embedding end as embedding from evaluate_embeddings c left join v using (content_hash))
      select embedding_model, count(*) as chunks, count(embedding) as with_vector from f group by 1""",
    "missing_vectors": f"select distinct content_hash from evaluate_embeddings where content_hash not in (select content_hash from evaluate_embeddings where embedding_model = '{MODEL}')",
    "duplicate_content": "select content_hash, count(*) as chunks, count(distinct document_uri) as documents, min(chunk_id) as first_chunk from evaluate_embeddings group by 1 having count(*) > 1",
    "hourly_events": "select time_bucket(interval 1 hour, ts) as window_start, event_type, count(*) as n, round(avg(value), 6) as mean_value from events group by 1, 2",
}
