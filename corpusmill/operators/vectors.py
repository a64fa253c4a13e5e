"""Exact vector retrieval: cosine scores, grouping by document, lane quotas and evidence checks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.errors import InvalidRequest, NotEmbedded
from corpusmill.functions.urls import citation


def norm(vector: Column) -> Column:
    """Euclidean length in double precision."""
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine of two vectors of one length; null where a length differs or a vector is zero."""
    below = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when((F.size(a) == F.size(b)) & (below > 0), dot(a, b) / below)


def usable(vector: Column, dim: int) -> Column:
    """Exactly ``dim`` finite numbers, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dim) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def vector_problem(vector: Column, dim: int) -> Column:
    """``missing``, ``dimension``, ``not_finite``, ``zero`` or null."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        F.when(vector.isNull(), "missing")
        .when(F.size(vector) != dim, "dimension")
        .when(bad, "not_finite")
        .when(~F.exists(vector, lambda x: x != 0), "zero")
    )


#: Bytes of query vectors up to which they are sent to every task that scores chunks, and scores held at a time.
QUERY_BYTES, SCORES = 64 << 20, 4_000_000


def nearest_chunks(
    chunks: DataFrame, queries: DataFrame, dim: int, k: int, ties: Sequence[str], keep: Sequence[str] = (), lane: str | None = None, vector: str = "embedding", digits: int = 6, half: bool = False
) -> DataFrame:
    """(query_id, lane, *ties, *keep, score, rank): the ``k`` best chunks of every query, per lane if there is one.

    ``queries``: (query_id, query_embedding). Scores are cosines, rounded so that equal ones tie;
    ties are settled by ``ties``, ascending. Unusable vectors take no part. With ``half`` both sides
    are held to half precision first, as a store of half vectors would.

    The search is exact: queries are a stated set, measured first and held by every task, the
    chunks stream past in Arrow batches, one matrix product each. They pass twice: first each task gives
    the ``k`` best scores of every query, from which the least score that counts is known; then only rows
    that reach it are handed on, ties at the edge included, so the shuffle carries about ``k`` rows per
    query, however many queries and tasks there are. More than ``QUERY_BYTES`` of queries are
    taken in slices of that size, the chunks passing by once more for each.
    """
    asked = queries.where(usable(F.col("query_embedding"), dim)).select("query_id", "query_embedding")
    columns = list(dict.fromkeys([*([lane] if lane else []), *ties, *keep]))
    kinds = dict(chunks.dtypes)
    schema = ", ".join(["query_id bigint", *(f"`{c}` {kinds[c]}" for c in columns), "score double"])
    passing = chunks.where(usable(F.col(vector), dim)).select(*columns, vector)

    def score(held: pd.DataFrame) -> DataFrame:
        shared = _held(chunks.sparkSession, held, dim, half)
        edges = _edges(passing.select(*([lane] if lane else []), vector), shared, k, lane, vector, digits, half)
        return passing.mapInPandas(_scorer(chunks.sparkSession, shared, edges, columns, lane, vector, digits, half), schema)

    most = max(1, QUERY_BYTES // (dim * 8))
    held = asked.limit(most + 1).toPandas()
    if len(held) <= most:
        best = score(held)
    else:
        slices, best = -(-asked.count() // most), None
        for at in range(slices):
            found = score(asked.where(F.pmod(F.xxhash64("query_id"), F.lit(slices)) == at).toPandas())
            best = found if best is None else best.unionByName(found)
    return nearest(best, ["query_id", *([lane] if lane else [])], list(ties), k)


def _held(spark: SparkSession, held: pd.DataFrame, dim: int, half: bool):
    matrix = np.stack(held["query_embedding"].to_numpy()).astype(np.float64) if len(held) else np.zeros((0, dim))
    matrix = matrix.astype(np.float16).astype(np.float64) if half else matrix
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
    return spark.sparkContext.broadcast((held["query_id"].to_numpy(), matrix))


def _scored_parts(batches: Iterator[pd.DataFrame], matrix: np.ndarray, lane: str | None, vector: str, digits: int, half: bool) -> Iterator[tuple[object, pd.DataFrame, np.ndarray]]:
    """(lane, rows, their scores with every query), part by part."""
    rows = max(1, SCORES // max(1, len(matrix)))
    for batch in batches:
        for at in range(0, len(batch) if len(matrix) else 0, rows):
            part = batch.iloc[at : at + rows]
            x = np.stack(part[vector].to_numpy()).astype(np.float16 if half else np.float64).astype(np.float64)
            found = np.round((x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)) @ matrix.T, digits)
            for name, own in part.groupby(lane).indices.items() if lane else [("", np.arange(len(part)))]:
                yield name, part.iloc[own], found[own]


def _lane_name(name: object) -> str | None:
    return None if pd.isna(name) else str(name)


def _edges(passing: DataFrame, shared, k: int, lane: str | None, vector: str, digits: int, half: bool) -> dict[str | None, np.ndarray]:
    """Per lane every query's ``k``-th best score, -inf where there are fewer rows; one number per query and lane comes to the driver."""

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str | None, np.ndarray] = {}
        for name, _, scores in _scored_parts(batches, shared.value[1], lane, vector, digits, half):
            key = _lane_name(name)
            every = np.concatenate([held[key], scores.astype(np.float32)]) if key in held else scores.astype(np.float32)
            held[key] = np.partition(every, len(every) - k, axis=0)[len(every) - k :] if len(every) > k else every
        for key, scores in held.items():
            for at in range(0, scores.shape[1], 10_000):
                yield pd.DataFrame({"lane": key, "place": np.arange(at, min(at + 10_000, scores.shape[1])), "scores": list(scores[:, at : at + 10_000].T)})

    tops = passing.mapInPandas(best, "lane string, place int, scores array<float>")
    kth = F.get(F.sort_array(F.flatten(F.collect_list("scores")), asc=False), F.lit(k - 1))
    found = tops.groupBy("lane", "place").agg(kth.alias("edge")).toPandas()
    # single precision and the last bits of a product stay below this
    slack = 1e-6 + 1.5 * 10.0**-digits
    edges: dict[str | None, np.ndarray] = {}
    for name, own in found.groupby("lane", dropna=False):
        edge = edges[_lane_name(name)] = np.full(len(shared.value[0]), -np.inf)
        edge[own["place"].to_numpy()] = own["edge"].fillna(-np.inf).to_numpy(np.float64) - slack
    return edges


def _scorer(spark: SparkSession, shared, edges: dict[str | None, np.ndarray], columns: list[str], lane: str | None, vector: str, digits: int, half: bool):
    least = spark.sparkContext.broadcast(edges)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, matrix = shared.value
        for name, part, scores in _scored_parts(batches, matrix, lane, vector, digits, half):
            row, query = np.nonzero(scores >= least.value[_lane_name(name)])
            out = part.iloc[row][columns]
            out.insert(0, "query_id", names[query])
            out["score"] = scores[row, query]
            yield out

    return score


def nearest(scored_rows: DataFrame, by: list[str], ties: list[str], k: int) -> DataFrame:
    """The ``k`` best per ``by`` with ``rank``; each task keeps its own best ``k`` before the shuffle."""
    order = [F.col("score").desc(), *[F.col(t).asc() for t in ties]]
    window = Window.partitionBy(*by).orderBy(*order) if by else Window.partitionBy(F.lit(0)).orderBy(*order)
    return scored_rows.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def group_by_document(pool: DataFrame, by: list[str], document: str, ties: list[str], documents: int | str, per_document: int) -> DataFrame:
    """The best documents of each ``by`` with their best chunks, as ``document_rank`` and ``chunk_rank``.

    A document stands where its best chunk stands. ``documents`` is a number or a quota column.
    """
    order = [F.col("score").desc(), *[F.col(t).asc() for t in ties]]
    within = pool.withColumn("chunk_rank", F.row_number().over(Window.partitionBy(*by, document).orderBy(*order))).where(F.col("chunk_rank") <= per_document)
    ahead = Window.partitionBy(*by, document)
    first = ["score", *ties]
    for name in first:
        best = F.max(F.when(F.col("chunk_rank") == 1, F.col(name))).over(ahead)
        within = within.withColumn(f"__{name}", best)
    place = Window.partitionBy(*by).orderBy(F.col("__score").desc(), *[F.col(f"__{t}").asc() for t in ties], document) if by else Window.partitionBy(F.lit(0)).orderBy(F.col("__score").desc(), *[F.col(f"__{t}").asc() for t in ties], document)
    quota = F.lit(documents) if isinstance(documents, int) else F.col(documents)
    ranked = within.withColumn("document_rank", F.dense_rank().over(place)).where(F.col("document_rank") <= quota)
    return ranked.drop(*[f"__{n}" for n in first])


@dataclass(frozen=True)
class Limits:
    """How much each lane gives: documents, chunks of each, and chunks scored before grouping."""

    documents: dict[str, int] = field(default_factory=dict)
    per_document: int = 2
    pool: int = 50

    def check(self, lanes: set[str]) -> Limits:
        if set(self.documents) - lanes:
            raise ValueError("unknown lane")
        if any(n < 0 for n in self.documents.values()) or self.per_document < 1:
            raise ValueError("quotas cannot be negative and a document gives at least one chunk")
        if self.pool < max(self.documents.values(), default=0) * self.per_document:
            raise ValueError("the pool is smaller than what a lane may give")
        return self


def merge_lanes(pool: DataFrame, by: list[str], lane: str, document: str, ties: list[str], limits: Limits) -> DataFrame:
    """Group each lane's pool of best chunks, cut it by the lane's quota, then one list over lanes with ``position`` from 1.

    A document's chunks stay together; documents are ordered by their best score.
    """
    quotas = pool.sparkSession.createDataFrame(sorted(limits.documents.items()), f"`{lane}` string, quota int")
    pool = pool.drop("rank").join(F.broadcast(quotas), lane)
    grouped = group_by_document(pool, [*by, lane], document, ties, "quota", limits.per_document)
    whole = Window.partitionBy(*by, lane, document)
    best = grouped.withColumn("__best", F.max("score").over(whole))
    for t in ties:
        best = best.withColumn(f"__{t}", F.max(F.when(F.col("chunk_rank") == 1, F.col(t))).over(whole))
    order = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.col("__best").desc(), *[F.col(f"__{t}").asc() for t in ties], document, "chunk_rank")
    return best.withColumn("position", F.row_number().over(order)).drop("__best", *[f"__{t}" for t in ties])


def evidence_problems(rows: DataFrame, public: list[str]) -> DataFrame:
    """Rows of a result that break an invariant, with the first broken one as ``problem``."""
    uuid = "(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
    problem = (
        F.when(~F.coalesce(F.col("source_scope").isin(*public), F.lit(False)), "scope")
        .when(F.coalesce(F.length("content_hash"), F.lit(0)) != 64, "hash")
        .when(F.coalesce(F.col("rank"), F.lit(0)) < 1, "rank")
        .when((F.col("method") == "vector") != F.col("score").isNotNull(), "score")
        .when(F.col("citation_uri").isNotNull() & ~F.col("citation_uri").startswith("https://"), "citation")
        .when(F.concat_ws(" ", "citation_uri", "canonical_uri", "title").rlike(uuid), "identifier")
    )
    return rows.withColumn("problem", problem).where("problem is not null")


def narrowed(rows: DataFrame, public: list[str], requested: list[str] | None) -> DataFrame:
    """Rows of the requested public scopes; asking for any other scope is an error."""
    if requested is not None and not set(requested) <= set(public):
        raise ValueError("only public scopes can be asked for")
    return rows.where(F.col("source_scope").isin(*(public if requested is None else requested)))


def covered(chunks: DataFrame, identity: str) -> DataFrame:
    """Chunks embedded under an identity; having none at all is an error, unlike a search that finds nothing."""
    rows = chunks.where(F.col("embedding").isNotNull() & (F.col("embedding_model") == identity))
    if rows.isEmpty():
        raise NotEmbedded(f"no chunk is embedded as {identity}")
    return rows


def search(chunks: DataFrame, queries: DataFrame, dim: int, public: list[str], scopes: list[str] | None = None, documents: int = 8, per_document: int = 2, pool: int = 50) -> DataFrame:
    """Evidence for each query: the best chunks of the best documents with rank and citation.

    ``queries``: (query_id, query_text, query_embedding). A query without 1 to 2,000 characters
    after trimming, or with an unusable vector, has no evidence. ``chunks``: (canonical_uri,
    source_scope, chunk_index, content_hash, embedding, ...); with mapping_status and parent_uri an
    image is cited by its confirmed parent. Equal scores: content_hash, then canonical_uri, then
    chunk_index.
    """
    if documents < 1:
        raise InvalidRequest("at least one document")
    asked = queries.where(F.length(F.trim("query_text")).between(1, 2000)).select("query_id", "query_embedding")
    ties = ["content_hash", "canonical_uri", "chunk_index"]
    proven = [c for c in ("mapping_status", "parent_uri") if c in chunks.columns]
    rows = nearest_chunks(narrowed(chunks, public, scopes), asked, dim, pool, ties, ["source_scope", *proven])
    best = group_by_document(rows.drop("rank"), ["query_id"], "canonical_uri", ties, documents, per_document)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("document_rank", "chunk_rank"))
    told = lambda c: F.col(c) if c in proven else F.lit(None).cast("string")
    return best.withColumn("rank", rank).withColumn("citation_uri", citation(F.col("canonical_uri"), F.col("source_scope"), told("mapping_status"), told("parent_uri")))
