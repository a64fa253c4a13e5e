"""Synchronising a document store with delivered records, as set operations over snapshots.

A store is a table with a row per canonical_uri; a run turns the store and its delivery into the
next store. Nothing is updated in place: the new snapshot is written beside the old one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VERSIONS = ("hash_version", "normalizer_version", "extractor_version", "chunker_version")


def outcome(stored: Column, archived: Column, same_versions: Column, same_hash: Column) -> Column:
    """new, restored, unchanged, changed or reprocessed."""
    return (
        F.when(~stored, "new")
        .when(archived, "restored")
        .when(same_versions & same_hash, "unchanged")
        .when(same_versions, "changed")
        .otherwise("reprocessed")
    )


def record_outcomes(store: DataFrame, delivery: DataFrame) -> DataFrame:
    """Every delivered record with what it does, in delivery order.

    ``store``: (canonical_uri, status, content_hash, versions). ``delivery``: (canonical_uri,
    ordinal, content_hash, versions). The first record of a page meets the store, each later one
    the record before it; ``page_rewritten``
    tells whether any of a page's records differed from what stood before. Records without canonical_uri are ignored; equal ordinals are taken in
    the order of their hashes.
    """
    own = F.struct(*VERSIONS)
    state = store.select(
        "canonical_uri",
        F.lit(True).alias("__stored"),
        (F.col("status") == "archived").alias("__archived"),
        F.col("content_hash").alias("__hash"),
        own.alias("__versions"),
    )
    along = Window.partitionBy("canonical_uri").orderBy("ordinal", "content_hash")
    seen = delivery.where("canonical_uri is not null").join(state, "canonical_uri", "left")
    seen = seen.withColumn("__own", own)
    first = F.row_number().over(along) == 1
    before_hash = F.when(first, F.col("__hash")).otherwise(F.lag("content_hash").over(along))
    before_versions = F.when(first, F.col("__versions")).otherwise(F.lag("__own").over(along))
    stored = F.when(first, F.coalesce("__stored", F.lit(False))).otherwise(True)
    archived = F.when(first, F.coalesce("__archived", F.lit(False))).otherwise(False)
    kind = outcome(stored, archived, before_versions.eqNullSafe(F.col("__own")), before_hash.eqNullSafe(F.col("content_hash")))
    rebuilt = ~(before_versions.eqNullSafe(F.col("__own")) & before_hash.eqNullSafe(F.col("content_hash")))
    last = F.row_number().over(along.orderBy(F.col("ordinal").desc(), F.col("content_hash").desc())) == 1
    found = seen.select(*delivery.columns, kind.alias("outcome"), F.coalesce(rebuilt, F.lit(True)).alias("rebuild"), last.alias("is_last"))
    return found.withColumn("page_rewritten", F.max(F.col("outcome") != "unchanged").over(Window.partitionBy("canonical_uri")))


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """One row with the number of each outcome."""
    return outcomes.agg(*[F.count_if(F.col("outcome") == k).alias(k) for k in ("new", "unchanged", "changed", "reprocessed", "restored")])


def missing_pages(store: DataFrame, inventory: DataFrame, scope: str | Column) -> DataFrame:
    """Active pages of the scope that a complete inventory does not list."""
    return store.where((F.col("status") == "active") & (F.col("source_scope") == scope)).join(inventory.select("canonical_uri"), "canonical_uri", "left_anti").select("canonical_uri")


def may_reconcile(store: DataFrame, inventory: DataFrame, complete: bool, scope: str) -> str | None:
    """Why a run must not look for missing pages, or None where it may."""
    if not complete:
        return "inventory incomplete"
    if inventory.isEmpty() and not store.where((F.col("status") == "active") & (F.col("source_scope") == scope)).limit(1).isEmpty():
        return "empty inventory while active documents exist"
    return None


def failure_streaks(log: DataFrame) -> DataFrame:
    """(canonical_uri, failures): failures since the last success of each page, plus what the store held if none.

    ``log``: (canonical_uri, ordinal, succeeded, stored_failures).
    """
    state = log.groupBy("canonical_uri").agg(
        F.max(F.when(F.col("succeeded"), F.col("ordinal"))).alias("__last"), F.max(F.coalesce("stored_failures", F.lit(0))).alias("__stored")
    )
    failed = log.where(~F.col("succeeded")).select("canonical_uri", "ordinal").join(state, "canonical_uri")
    after = failed.where(F.col("__last").isNull() | (F.col("ordinal") > F.col("__last"))).groupBy("canonical_uri").agg(F.count("*").alias("__after"))
    kept = F.when(F.col("__last").isNull(), F.col("__stored")).otherwise(0)
    return state.join(after, "canonical_uri", "left").select("canonical_uri", (F.coalesce("__after", F.lit(0)) + kept).alias("failures"))


def next_store(store: DataFrame, outcomes: DataFrame, failures: DataFrame, missing: DataFrame, run_id: Column, seen_at: Column) -> DataFrame:
    """The store after a run: contents of the last record of each page, counters, and what was missed.

    Unchanged pages only get their sighting; pages not delivered keep all but their counters.
    ``failures``: (canonical_uri, failed); ``missing``: (canonical_uri), with ``steps`` where it stands for several
    runs. ``run_id`` may be ``__run_id``, the run of the page's last record, where the outcomes have one.
    """
    content = [c for c in store.columns if c not in ("canonical_uri", "status", "gone_count", "consecutive_failure_count", "last_seen_at", "last_run_id")]
    new = outcomes.where("is_last").select("canonical_uri", *[F.col(c).alias(f"__{c}") for c in content if c in outcomes.columns], F.lit(True).alias("__delivered"), F.col("page_rewritten").alias("__rewritten"), *[F.col(c).alias("__run_id") for c in outcomes.columns if c == "run_id"])
    absent = missing.select("canonical_uri", F.col("steps").alias("__missing")) if "steps" in missing.columns else missing.select("canonical_uri", F.lit(1).alias("__missing")).distinct()
    failed = failures.groupBy("canonical_uri").agg(F.sum("failed").alias("__failed"))
    both = store.join(new, "canonical_uri", "full_outer").join(absent, "canonical_uri", "left").join(failed, "canonical_uri", "left")
    delivered = F.col("__delivered").isNotNull()
    rewritten = F.coalesce("__rewritten", F.lit(False))
    columns = [F.when(rewritten, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in outcomes.columns else F.col(c) for c in content]
    gone = F.when(delivered, 0).otherwise(F.coalesce("gone_count", F.lit(0))) + F.coalesce("__missing", F.lit(0))
    bad = F.when(delivered, 0).otherwise(F.coalesce("consecutive_failure_count", F.lit(0))) + F.when(delivered, 0).otherwise(F.coalesce("__failed", F.lit(0)))
    return both.select(
        "canonical_uri",
        F.when(delivered, "active").otherwise(F.col("status")).alias("status"),
        gone.cast("int").alias("gone_count"),
        bad.cast("int").alias("consecutive_failure_count"),
        F.when(delivered, seen_at).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
        F.when(delivered, run_id).otherwise(F.col("last_run_id")).alias("last_run_id"),
        *columns,
    )


# --- several runs one after another ------------------------------------------------------


def outcomes_of_runs(store: DataFrame, deliveries: DataFrame) -> DataFrame:
    """``record_outcomes`` of every run after the one before it; ``deliveries`` have the run_id beside the ordinal.

    A run leaves the store with the last record of each page, so a page's records follow one another
    by run and ordinal. ``is_last`` and ``page_rewritten`` are over all runs.
    """
    found = record_outcomes(store, deliveries.withColumn("ordinal", F.struct("run_id", "ordinal")))
    return found.withColumn("ordinal", F.col("ordinal.ordinal"))


def pages_of_runs(store: DataFrame, deliveries: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, source_scope, canonical_uri): the active pages that each of ``runs`` finds in the store of its scope."""
    held = store.where("status = 'active'").select("source_scope", "canonical_uri", F.lit(None).cast("bigint").alias("run"))
    came = deliveries.where("canonical_uri is not null").select("source_scope", "canonical_uri", F.col("run_id").alias("run"))
    always = F.count_if(F.col("run").isNull()) > 0
    pages = held.unionByName(came).groupBy("source_scope", "canonical_uri").agg(F.when(~always, F.min("run")).alias("since"))
    return runs.select("run_id", "source_scope").join(pages, "source_scope").where("since is null or since < run_id").select("run_id", "source_scope", "canonical_uri")


def missing_by_run(store: DataFrame, deliveries: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, canonical_uri): ``missing_pages`` after each of ``runs``, those with a complete inventory.

    A run that brought nothing is passed over, as ``may_reconcile`` asks.
    """
    listed = deliveries.where("canonical_uri is not null").select("run_id", "canonical_uri").distinct()
    told = runs.join(listed.select("run_id").distinct(), "run_id", "left_semi")
    return pages_of_runs(store, deliveries, told).join(listed, ["run_id", "canonical_uri"], "left_anti").select("run_id", "canonical_uri")


def store_after_runs(store: DataFrame, deliveries: DataFrame, runs: DataFrame, seen_at: Column) -> DataFrame:
    """The store after every run of ``deliveries``, as ``next_store`` would leave it run by run.

    Every delivery clears a page's counter, so only the misses after its last one count.
    """
    outcomes = outcomes_of_runs(store, deliveries)
    last = outcomes.where("is_last").select("canonical_uri", F.col("run_id").alias("__last"))
    later = missing_by_run(store, deliveries, runs).join(last, "canonical_uri", "left").where("__last is null or run_id > __last")
    missing = later.groupBy("canonical_uri").agg(F.count("*").cast("int").alias("steps"))
    failures = store.sparkSession.createDataFrame([], "canonical_uri string, failed int")
    return next_store(store, outcomes, failures, missing, F.col("__run_id").cast("string"), seen_at)


def replace_chunks(chunks: DataFrame, rebuilt: DataFrame, fresh: DataFrame, key: str = "canonical_uri") -> DataFrame:
    """Chunks of rebuilt documents replaced; those of all others kept with their vectors."""
    return chunks.join(rebuilt.select(key).distinct(), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def latest_runs(ledger: DataFrame, scope: str = "source_scope") -> DataFrame:
    """The last run of each scope by started_at, then run_id."""
    order = Window.partitionBy(scope).orderBy(F.col("started_at").desc(), F.col("run_id").desc())
    return ledger.withColumn("__rn", F.row_number().over(order)).where("__rn = 1").drop("__rn")


def sweep_stale(ledger: DataFrame, now: Column) -> DataFrame:
    """Runs still ``running`` become ``aborted`` at ``now``, as before any new run of the ledger."""
    stale = F.col("run_status") == "running"
    return ledger.withColumn("finished_at", F.when(stale, now).otherwise(F.col("finished_at"))).withColumn(
        "abort_reason", F.when(stale, "stale_run").otherwise(F.col("abort_reason"))
    ).withColumn("run_status", F.when(stale, "aborted").otherwise(F.col("run_status")))


# --- gates -------------------------------------------------------------------------------


def raw_gate(url: Column, title: Column, body: Column, source_type: Column, least: int | None = None) -> Column:
    """Why a raw record is refused, or null: web payload, placeholder, empty body, too short."""

    def placeholder(text: Column) -> Column:
        return F.coalesce(F.lower(F.trim(text)) == "a", F.lit(False))

    gate = F.when(source_type == "web", "web_payload_refused").when(placeholder(url) | placeholder(title), "placeholder_record").when(F.coalesce(F.trim(F.regexp_replace(body, r"\s+", " ")) == "", F.lit(True)), "empty_body")
    return gate.when(F.length(body) < least, "below_floor") if least is not None else gate


def acceptance_gate(uri: Column, canonical: Column, title: Column, blocks: Column, any_text: Column, extractor_version: Column) -> Column:
    """Why a built record is refused, or null; the first failure counts."""
    return (
        F.when(F.coalesce(F.trim(uri) == "", F.lit(True)), "empty canonical_uri")
        .when(~uri.eqNullSafe(canonical), "canonical_uri is not normalized")
        .when(F.coalesce(F.trim(title) == "", F.lit(True)), "empty title")
        .when(F.coalesce(F.size(blocks) <= 0, F.lit(True)), "no content blocks")
        .when(~any_text, "no textual content")
        .when(F.coalesce(extractor_version < 1, F.lit(True)), "invalid extractor_version")
    )
