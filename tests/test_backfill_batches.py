"""Batches that fail: which errors are tried again, when a task stops, and what is counted."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import backfill


class RateLimitError(Exception):
    """Named like a provider's own."""


def planned(spark, count, size):
    rows = [(hashlib.sha256(str(n).encode()).hexdigest(), f"text {n}") for n in range(count)]
    return backfill.in_batches(spark.createDataFrame(rows, "content_hash string, content string"), size).coalesce(1)


def broken(error, when):
    """Raises at batches for which ``when`` holds of the calls so far."""
    calls = []

    def run(texts):
        calls.append(len(texts))
        if when(len(calls)):
            raise error("no")
        return [[1.0, float(len(t))] for t in texts]

    return run


def outcome(spark, embedder, attempts=1, count=60, size=10):
    rows = backfill.embed_batches(planned(spark, count, size).repartition(1), embedder, 2, attempts=attempts, pause=0.0).coalesce(1).collect()
    frame = spark.createDataFrame(rows, backfill._EMBEDDED)
    return backfill.counters(count, frame, sum(r["status"] == "embedded" for r in rows), sum(r["status"] != "embedded" for r in rows)), rows


@pytest.fixture(autouse=True)
def one_task(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_all_goes_well(spark):
    counts, rows = outcome(spark, broken(ValueError, lambda n: False))
    assert (counts["embedded_texts"], counts["batches"], counts["failed_batches"], counts["api_requests"], counts["stop_reason"]) == (60, 6, 0, 6, None)
    assert {r["content_hash"] for r in rows} == {hashlib.sha256(str(n).encode()).hexdigest() for n in range(60)}


def test_transient_errors_are_tried_again(spark):
    counts, _ = outcome(spark, broken(RateLimitError, lambda n: n % 2 == 1), attempts=2)
    assert (counts["embedded_texts"], counts["failed_batches"], counts["api_requests"], counts["stop_reason"]) == (60, 0, 12, None)


def test_one_failed_batch_leaves_its_texts_pending(spark):
    counts, _ = outcome(spark, broken(TimeoutError, lambda n: n == 2))
    assert (counts["embedded_texts"], counts["failed_batches"], counts["pending_after"], counts["stop_reason"]) == (50, 1, 10, "batches_failed")


def test_three_failures_in_a_row_stop(spark):
    counts, rows = outcome(spark, broken(ConnectionError, lambda n: n >= 2))
    assert (counts["embedded_texts"], counts["batches"], counts["failed_batches"], counts["stop_reason"]) == (10, 4, 3, "consecutive_failures")
    assert sum(r["status"] == "skipped" for r in rows) == 20


def test_any_other_error_stops_at_once(spark):
    counts, _ = outcome(spark, broken(PermissionError, lambda n: n == 3), attempts=4)
    assert (counts["embedded_texts"], counts["batches"], counts["failed_batches"], counts["api_requests"], counts["stop_reason"]) == (20, 3, 1, 3, "non_retryable_error")
    wrong, _ = outcome(spark, lambda texts: [[float("nan"), 1.0] for _ in texts])
    assert wrong["stop_reason"] == "non_retryable_error" and wrong["embedded_texts"] == 0


def test_what_is_transient():
    assert all(map(backfill.is_transient, (TimeoutError(), ConnectionResetError(), RateLimitError())))
    assert not any(map(backfill.is_transient, (ValueError(), PermissionError(), KeyError())))


def test_nothing_to_do(spark):
    counts, _ = outcome(spark, broken(ValueError, lambda n: True), count=0)
    assert (counts["unique_texts"], counts["batches"], counts["stop_reason"]) == (0, 0, None)
    assert backfill.in_batches(spark.createDataFrame([], "content_hash string, content string")).where(F.col("batch_no") > 0).count() == 0
