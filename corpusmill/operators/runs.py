"""Whole runs: one delivery into the store, and one backfill of its vectors.

A run holds the store's lock, opens its ledger entry before any work, and publishes documents and
chunks as new snapshots. Whatever fails leaves the old snapshots current and closes the entry.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.errors import BrokenStore, InvalidRequest
from corpusmill.functions.blocks import BLOCKS, HASH_VERSION
from corpusmill.functions.text import NORMALIZER_VERSION
from corpusmill.operators import backfill as fill
from corpusmill.operators import synchronize as sync
from corpusmill.operators.chunking import CHUNKER_VERSION, document_chunks
from corpusmill.scratch import durable
from corpusmill.scratch import scope as scope_of_tables
from corpusmill.sources.sinks import Snapshots, append_ledger, single_run

STORE = (
    f"canonical_uri string, source_scope string, content_type string, title string, blocks {BLOCKS}, content_hash string, status string, gone_count int, "
    "consecutive_failure_count int, last_seen_at timestamp, last_run_id string, hash_version int, normalizer_version int, extractor_version int, chunker_version int"
)
CHUNKS = "canonical_uri string, source_scope string, chunk_index int, content string, content_hash string, embedding array<float>, embedding_model string"


def _ledger(spark: SparkSession, root: str, run: str, mode: str, status: str, counts: dict | None = None, reason: str | None = None) -> None:
    append_ledger(spark, root, {"run_id": run, "run_mode": mode, "run_status": status, "at": datetime.now(UTC), "counts": counts, "abort_reason": reason})


def synchronize_scope(spark: SparkSession, root: str, scope: str, records: DataFrame, inventory: DataFrame, complete: bool = True, mode: str = "sync") -> dict[str, object]:
    """Deliver records of a scope into the store under ``root``; returns the run's counters.

    ``records``: (canonical_uri, title, blocks, content_hash, content_type, extractor_version,
    ordinal, reason); those with a reason are refused and counted as failures of their page, which
    keeps what it holds. Pages of the scope that a complete inventory lacks count as missing, after
    the records; nothing is removed. The run is a failure if anything raises. ``mode`` is that of the
    ledger; a backfill is no delivery and is refused before anything is read.
    """
    if mode == "backfill":
        raise InvalidRequest("a backfill delivers no records")
    snapshots = Snapshots(spark, root)
    with scope_of_tables(), single_run(spark, root) as run:
        _ledger(spark, root, run, mode, "running")
        try:
            counts = _deliver(spark, snapshots, scope, records, inventory, complete, run)
        except BaseException as error:
            _ledger(spark, root, run, mode, "failed", reason=type(error).__name__)
            raise
        _ledger(spark, root, run, mode, "succeeded", counts)
        return {"run_id": run} | counts


def _deliver(spark: SparkSession, snapshots: Snapshots, scope: str, records: DataFrame, inventory: DataFrame, complete: bool, run: str) -> dict[str, object]:
    store = snapshots.read("documents")
    store = spark.createDataFrame([], STORE) if store is None else store
    lacking = {"canonical_uri", "title", "blocks", "content_hash", "content_type", "extractor_version", "ordinal", "reason"} - set(records.columns)
    if lacking:
        raise ValueError(f"records lack {sorted(lacking)}")
    versions = {"hash_version": HASH_VERSION, "normalizer_version": NORMALIZER_VERSION, "chunker_version": CHUNKER_VERSION}
    delivered = durable(records.withColumns({k: F.lit(v) for k, v in versions.items()} | {"source_scope": F.lit(scope)}))
    accepted = delivered.where("reason is null").drop("reason")
    failures = delivered.where("reason is not null and canonical_uri is not null").groupBy("canonical_uri").agg(F.count("*").cast("int").alias("failed"))
    outcomes = durable(sync.record_outcomes(store, accepted))
    # what this run brought in is known before the inventory is held against it
    known = store.select("canonical_uri", "source_scope", "status").unionByName(outcomes.select("canonical_uri", "source_scope", F.lit("active").alias("status"))).distinct()
    skipped = sync.may_reconcile(known, inventory, complete, scope)
    missing = durable(sync.missing_pages(known, inventory, scope)) if skipped is None else spark.createDataFrame([], "canonical_uri string")
    now = F.lit(datetime.now(UTC)).cast("timestamp")
    after = sync.next_store(store, outcomes, failures, missing, F.lit(run), now)
    after = durable(after.select(*[f.name for f in spark.createDataFrame([], STORE).schema.fields]))
    chunks = snapshots.read("chunks")
    chunks = spark.createDataFrame([], CHUNKS) if chunks is None else chunks
    # a restored page whose content and rules are the stored ones keeps its chunks and vectors
    rebuilt = outcomes.groupBy("canonical_uri").agg(F.max("rebuild").alias("rebuild")).where("rebuild").select("canonical_uri")
    fresh = document_chunks(after.join(rebuilt, "canonical_uri", "left_semi"), "canonical_uri", "blocks").withColumn("source_scope", F.lit(scope))
    replaced = sync.replace_chunks(chunks, rebuilt, fresh).select(*chunks.columns)
    snapshots.publish("chunks", replaced)
    snapshots.publish("documents", after)
    counts = sync.outcome_counts(outcomes).first().asDict()
    refused = {r["reason"]: r["count"] for r in delivered.where("reason is not null").groupBy("reason").count().collect()}
    return counts | {"refused": refused, "missing": missing.count(), "inventory_complete": complete, "reconciliation_skipped": skipped}


def backfill_store(
    spark: SparkSession, root: str, identity: str, dim: int, embedder: Callable[[list[str]], Sequence[Sequence[float]]] | None = None, scopes: Sequence[str] | None = None, limit: int | None = None, batch_size: int = 128, pause: float = 2.0
) -> dict[str, object]:
    """Embed what is pending in active documents; without an embedder only say what would be done.

    Each text is embedded once however many chunks hold it, vectors are kept in the store's own
    vector table, and a second call finds nothing left to do. Vectors of the batches that succeeded
    are stored also where others failed; the run is then closed as failed with its counters.
    """
    snapshots = Snapshots(spark, root)
    with scope_of_tables(), single_run(spark, root) as run:
        chunks, documents = snapshots.read("chunks"), snapshots.read("documents")
        if chunks is None or documents is None:
            return {"texts": 0, "written": 0}
        active = documents.where("status = 'active'").select("canonical_uri")
        eligible = chunks.join(active, "canonical_uri", "left_semi")
        eligible = eligible.where(F.col("source_scope").isin(*scopes)) if scopes else eligible
        keyed = eligible.withColumn("chunk_id", F.xxhash64("canonical_uri", "chunk_index"))
        if not fill.broken_hashes(keyed).isEmpty():
            raise BrokenStore("a stored chunk is not what its hash says")
        planned = durable(fill.plan(keyed, identity, limit))
        texts = planned.count()
        if embedder is None or not texts:
            return {"texts": texts, "written": 0}
        _ledger(spark, root, run, "backfill", "running")
        try:
            began = time.monotonic()
            embedded = durable(fill.embed_batches(fill.in_batches(planned, batch_size), embedder, dim, pause=pause))
            vectors = embedded.where("status = 'embedded'").select("content_hash", "embedding")
            # only chunks of eligible documents may change
            inside = eligible.select("canonical_uri", "chunk_index").withColumn("__in", F.lit(True))
            marked = chunks.join(inside, ["canonical_uri", "chunk_index"], "left")
            touched = fill.write_back(marked.where("__in").drop("__in"), vectors, identity)
            written = touched.select(*chunks.columns).unionByName(marked.where("__in is null").select(*chunks.columns))
            snapshots.publish("chunks", written)
        except BaseException as error:
            _ledger(spark, root, run, "backfill", "failed", reason=type(error).__name__)
            raise
        left = fill.pending(keyed, identity).count()
        done = fill.pending(keyed, identity).select("content_hash").join(vectors, "content_hash", "left_semi").count()
        counts = fill.counters(left if limit is None else min(left, limit), embedded, done, left - done, round(time.monotonic() - began, 2))
        _ledger(spark, root, run, "backfill", "failed" if counts["stop_reason"] else "succeeded", counts, counts["stop_reason"])
        return {"texts": texts, "written": counts["embedded_texts"]} | counts
