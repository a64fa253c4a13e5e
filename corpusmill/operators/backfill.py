"""Embedding backfill: what is pending, one text per hash, batches, and writing vectors back."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import digest


def pending(chunks: DataFrame, identity: str) -> DataFrame:
    """Chunks without a vector or with one of another model."""
    return chunks.where(F.col("embedding").isNull() | ~F.col("embedding_model").eqNullSafe(F.lit(identity)))


def plan(chunks: DataFrame, identity: str, limit: int | None = None) -> DataFrame:
    """(content_hash, content): one text per pending hash, that of the smallest chunk id.

    ``limit`` takes the first pending rows by (content_hash, chunk_id) before copies are merged.
    """
    todo = pending(chunks, identity).select("chunk_id", "content_hash", "content")
    if limit is not None:
        todo = todo.orderBy("content_hash", "chunk_id").limit(limit)
    return todo.groupBy("content_hash").agg(F.min_by("content", "chunk_id").alias("content"))


def broken_hashes(chunks: DataFrame) -> DataFrame:
    """Chunks whose stored hash is not their content's; must be empty before anything is embedded."""
    return chunks.where(~digest(F.col("content")).eqNullSafe(F.col("content_hash"))).select("chunk_id", "content_hash")


def in_batches(planned: DataFrame, size: int = 128) -> DataFrame:
    """Planned texts with ``batch_no``, consecutive by hash.

    The rank over all hashes is found in two steps, so that no task sorts everything: counts per
    leading hash digits give each range its offset, ranks are then taken within a range.
    """
    ranged = planned.withColumn("__range", F.substring("content_hash", 1, 3))
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    offsets = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("__range").orderBy("content_hash"))
    joined = ranged.withColumn("__rank", rank).join(F.broadcast(offsets.select("__range", "__before")), "__range")
    return joined.withColumn("batch_no", F.floor((F.col("__rank") + F.col("__before") - 1) / size)).drop("__range", "__rank", "__before")


def estimate(planned: DataFrame, characters_per_token: float = 4.0) -> DataFrame:
    """One row: texts, characters and estimated tokens."""
    return planned.agg(F.count("*").alias("texts"), F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("characters")).withColumn(
        "tokens", F.ceil(F.col("characters") / F.lit(characters_per_token))
    )


#: Errors after which the same call may succeed: transport, time, and what a provider names so.
TRANSIENT = (ConnectionError, TimeoutError)
TRANSIENT_NAMES = frozenset(("APIConnectionError", "APITimeoutError", "RateLimitError", "InternalServerError"))
FAILURES_IN_A_ROW = 3


def is_transient(error: BaseException) -> bool:
    """Whether a failed call is worth repeating unchanged; a rejected key, a bad request or a malformed answer is not."""
    return isinstance(error, TRANSIENT) or any(c.__name__ in TRANSIENT_NAMES for c in type(error).__mro__)


def _checked(vectors: Sequence[Sequence[float]], count: int, dim: int) -> list[list[float]]:
    found = [list(map(float, v)) for v in vectors]
    if len(found) != count or any(len(v) != dim or any(x != x or abs(x) == float("inf") for x in v) for v in found):
        raise ValueError("the embedder's answer does not fit its texts")
    return found


_EMBEDDED = "batch_no bigint, status string, error string, requests int, content_hash string, embedding array<float>"


def embed_batches(planned: DataFrame, embedder: Callable[[list[str]], Sequence[Sequence[float]]], dim: int, attempts: int = 4, pause: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """Planned texts with batch_no as (batch_no, status, error, requests, content_hash, embedding): a row per text, and what became of its batch.

    Batches are called in order within a task, each whole. A transient error is tried again after
    ``pause``, twice and four times as many seconds; a batch still failing is ``failed``. After three
    failed batches in a row, or one error that is not transient, the task calls no more and the rest
    is ``skipped``: ``stopped`` is the error's name at the batch where it did. Nothing is lost: what
    has no vector is pending in the next run. ``requests`` counts calls, on a batch's first row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        row_failures, ended = 0, False
        held: pd.DataFrame | None = None

        def call(part: pd.DataFrame) -> pd.DataFrame:
            nonlocal row_failures, ended
            vectors, status, name, requests = [None] * len(part), "skipped", None, 0
            if not ended:
                for attempt in range(attempts):
                    try:
                        requests += 1
                        vectors, status, name = _checked(embedder(list(part["content"])), len(part), dim), "embedded", None
                        row_failures = 0
                        break
                    except Exception as error:  # whatever the provider raises is recorded by name
                        vectors, status, name = [None] * len(part), "failed", type(error).__name__
                        if not is_transient(error):
                            ended = True
                            break
                        if attempt + 1 < attempts:
                            sleep(pause * 2**attempt)
                if status == "failed":
                    row_failures += 1
                    ended = ended or row_failures >= FAILURES_IN_A_ROW
            calls = [requests] + [0] * (len(part) - 1)
            return pd.DataFrame({"batch_no": part["batch_no"].to_numpy(), "status": status, "error": name, "requests": calls, "content_hash": part["content_hash"].to_numpy(), "embedding": vectors})

        for frame in batches:
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            last = frame["batch_no"].iloc[-1] if len(frame) else None
            for number, part in frame.groupby("batch_no", sort=True):
                if number == last:
                    held = part
                else:
                    yield call(part)
        if held is not None and len(held):
            yield call(held)

    return planned.select("batch_no", "content_hash", "content").repartitionByRange("batch_no").sortWithinPartitions("batch_no", "content_hash").mapInPandas(run, _EMBEDDED)


def counters(selected_chunks: int, embedded: DataFrame, rows_updated: int, pending_after: int, elapsed_seconds: float = 0.0) -> dict[str, object]:
    """What a backfill did, from the rows of ``embed_batches``; ``stop_reason`` is none for one that finished its plan."""
    per = embedded.groupBy("batch_no").agg(F.max("status").alias("status"), F.max("error").alias("error"), F.sum("requests").alias("requests"), F.count("*").alias("texts"))
    hard = ~F.coalesce(F.col("error").isin(*[c.__name__ for c in TRANSIENT], *TRANSIENT_NAMES), F.lit(True))
    got = per.agg(
        F.coalesce(F.sum("texts"), F.lit(0)).alias("unique_texts"), F.coalesce(F.sum(F.when(F.col("status") == "embedded", F.col("texts"))), F.lit(0)).alias("embedded_texts"),
        F.count_if(F.col("status") != "skipped").alias("batches"), F.count_if(F.col("status") == "failed").alias("failed_batches"), F.coalesce(F.sum("requests"), F.lit(0)).alias("api_requests"),
        F.count_if(F.col("status") == "skipped").alias("skipped"), F.count_if((F.col("status") == "failed") & hard).alias("hard"),
    ).first().asDict()
    skipped, hard_errors = got.pop("skipped"), got.pop("hard")
    reason = "non_retryable_error" if hard_errors else "consecutive_failures" if skipped else "batches_failed" if got["failed_batches"] else None
    return {"selected_chunks": selected_chunks} | got | {"rows_updated": rows_updated, "prompt_tokens": 0, "pending_after": pending_after, "elapsed_seconds": elapsed_seconds, "stop_reason": reason}


def embed(planned: DataFrame, embedder: Callable[[list[str]], Sequence[Sequence[float]]], dim: int, size: int = 128, attempts: int = 4, pause: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(content_hash, embedding) of planned texts, by Arrow batches on the executors; any failure is an error.

    A failing call is tried again as by ``embed_batches``; a batch of the wrong count, dimension or
    with a number that is not finite is an error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for at in range(0, len(frame), size):
                part = frame.iloc[at : at + size]
                for attempt in range(attempts):
                    try:
                        vectors = _checked(embedder(list(part["content"])), len(part), dim)
                        break
                    except Exception as error:
                        if attempt + 1 == attempts or not is_transient(error):
                            raise
                        sleep(pause * 2**attempt)
                yield pd.DataFrame({"content_hash": part["content_hash"].to_numpy(), "embedding": vectors})

    return planned.select("content_hash", "content").mapInPandas(run, "content_hash string, embedding array<float>")


def write_back(chunks: DataFrame, vectors: DataFrame, identity: str) -> DataFrame:
    """Chunks with new vectors where they are pending and their hash has one; all else as it was."""
    new = vectors.select("content_hash", F.col("embedding").alias("__new"))
    todo = F.col("embedding").isNull() | ~F.col("embedding_model").eqNullSafe(F.lit(identity))
    take = todo & F.col("__new").isNotNull()
    return (
        chunks.join(new, "content_hash", "left")
        .withColumn("embedding_model", F.when(take, identity).otherwise(F.col("embedding_model")))
        .withColumn("embedding", F.when(take, F.col("__new")).otherwise(F.col("embedding")))
        .drop("__new")
        .select(*chunks.columns)
    )


def evaluation_texts(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(content_hash, content, kind) of what an evaluation embeds: queries (query_text) first, then chunks (content, content_hash), one row per hash.

    A chunk whose text is a query's is that query; of chunks with one hash any text stands, being equal.
    """
    asked = queries.select(digest(F.col("query_text")).alias("content_hash"), F.col("query_text").alias("content"), F.lit(0).alias("place"))
    every = asked.unionByName(chunks.select("content_hash", "content", F.lit(1).alias("place"))).where("content_hash is not null")
    best = every.groupBy("content_hash").agg(F.min(F.struct("place", "content")).alias("b"))
    return best.select("content_hash", "b.content", F.when(F.col("b.place") == 0, "query").otherwise("chunk").alias("kind"))


def missing_keys(wanted: DataFrame, store: DataFrame, key: str = "content_hash") -> DataFrame:
    """Texts of which the vector store has none yet."""
    return wanted.join(store.select(key), key, "left_anti")


def hashing_embedder(dim: int) -> Callable[[list[str]], list[list[float]]]:
    """Unit vectors derived from word hashes; deterministic, for tests and dry runs."""
    import zlib

    def run(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * dim
            for word in text.lower().split():
                h = zlib.crc32(word.encode())
                v[h % dim] += 1.0 if h & 1 << 20 else -1.0
            length = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / length for x in v] if any(v) else [1.0, *[0.0] * (dim - 1)])
        return out

    return run
