"""Runs one after another against the same runs folded one at a time."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from corpusmill.operators import synchronize
from corpusmill.plans import stores
from corpusmill.sources.tables import read_table

VERSIONS = "hash_version int, normalizer_version int, extractor_version int, chunker_version int"


def test_runs_as_folded_one_by_one(spark):
    rng = random.Random(4)
    held = [(f"u{i}", "s", rng.choice(["active", "archived"]), f"h{i}", 1, 3, 1, 3, 1, 2, None, "before") for i in range(12)]
    store = spark.createDataFrame(held, f"canonical_uri string, source_scope string, status string, content_hash string, {VERSIONS}, gone_count int, consecutive_failure_count int, last_seen_at timestamp, last_run_id string")
    rows, ordinal = [], 0
    for run in (2, 3, 4, 6):
        for i in rng.sample(range(18), 9):
            for _ in range(rng.choice([1, 1, 2])):
                ordinal += 1
                rows.append((run, f"u{i}", "s", ordinal, rng.choice([f"h{i}", f"g{i}"]), 1, 3, rng.choice([1, 1, 2]), 3))
    deliveries = spark.createDataFrame(rows, f"run_id bigint, canonical_uri string, source_scope string, ordinal bigint, content_hash string, {VERSIONS}")
    complete = spark.createDataFrame([(2, "s"), (4, "s"), (5, "s"), (6, "s")], "run_id bigint, source_scope string")  # run 3 is incomplete, run 5 empty
    seen, nothing = F.lit("2025-01-01").cast("timestamp"), spark.createDataFrame([], "canonical_uri string, failed int")
    folded, outcomes, missed = store, set(), set()
    for run in (2, 3, 4, 6):
        delivery = deliveries.where(F.col("run_id") == run).drop("run_id")
        found = synchronize.record_outcomes(folded, delivery)
        missing = synchronize.missing_pages(folded, delivery, F.lit("s")).where(F.lit(run != 3))
        outcomes |= {(run, *r) for r in found.select("canonical_uri", "ordinal", "outcome", "rebuild").collect()}
        missed |= {(run, r[0]) for r in missing.collect()}
        after = synchronize.next_store(folded, found, nothing, missing, F.lit(str(run)), seen).collect()
        folded = spark.createDataFrame([tuple(r[c] for c in store.columns) for r in after], store.schema)
    got = synchronize.outcomes_of_runs(store, deliveries).select("run_id", "canonical_uri", "ordinal", "outcome", "rebuild")
    assert {tuple(r) for r in got.collect()} == outcomes and got.count() == len(rows)
    assert {tuple(r) for r in synchronize.missing_by_run(store, deliveries, complete).collect()} == missed
    at_once = synchronize.store_after_runs(store, deliveries, complete, seen).select(*store.columns)
    assert sorted(map(str, at_once.collect())) == sorted(map(str, folded.collect()))
    assert folded.where("gone_count > 1").count() > 0


def test_every_later_run_is_delivered(spark, base):
    records = read_table(spark, base, "contract", ["run_id", "source_scope"])
    first = read_table(spark, base, "runs", ["run_id", "source_scope"]).groupBy("source_scope").agg(F.min("run_id").alias("first_run"))
    later = {r["run_id"] for r in records.join(first, "source_scope").where("run_id > first_run").collect()}
    counters = stores.sync_counters_by_run(spark, base).collect()
    assert {r["run_id"] for r in counters} == later and len(counters) == len(later)
    assert sum(sum(r[1:]) for r in counters) == records.join(first, "source_scope").where("run_id > first_run").count()
