"""Structured reads: chunks of active documents of public scopes, in order, without any search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.errors import NotPublic

#: Leading chunks of a page that make up a profile.
PROFILE_CHUNKS = 2


def structured_read(chunks: DataFrame, documents: DataFrame, public: Sequence[str], condition: Column | None = None) -> DataFrame:
    """(canonical_uri, title, source_scope, chunk_index, content, content_hash): chunks of active public documents that meet a condition.

    ``documents``: (canonical_uri, title, source_scope, status); ``chunks``: (canonical_uri,
    chunk_index, content, content_hash). Order is (canonical_uri, chunk_index), see ``ranked``. The
    status and the scopes reach the scan of the documents; the join is Spark's by measured sizes.
    """
    live = documents.where((F.col("status") == "active") & F.col("source_scope").isin(*public)).select("canonical_uri", "title", "source_scope")
    rows = chunks.select("canonical_uri", "chunk_index", "content", "content_hash").join(live, "canonical_uri")
    rows = rows.where(condition) if condition is not None else rows
    return rows.select("canonical_uri", "title", "source_scope", "chunk_index", "content", "content_hash")


def in_order(rows: DataFrame) -> DataFrame:
    """Sorted by page and place; a range sort, so no task holds more than its share."""
    return rows.orderBy("canonical_uri", "chunk_index")


def scope_documents(chunks: DataFrame, documents: DataFrame, public: Sequence[str], scope: str) -> DataFrame:
    """Every chunk of a scope's active documents, as office locations are read."""
    if scope not in public:
        raise NotPublic(f"not a public scope: {scope}")
    return structured_read(chunks, documents, public, F.col("source_scope") == scope)


def page_profile(chunks: DataFrame, documents: DataFrame, public: Sequence[str], uri: str, leading: int = PROFILE_CHUNKS) -> DataFrame:
    """The leading chunks of one page, as a company profile is read."""
    return structured_read(chunks, documents, public, (F.col("canonical_uri") == uri) & (F.col("chunk_index") < leading))


def pages_by_uri(chunks: DataFrame, documents: DataFrame, public: Sequence[str], uris: Sequence[str]) -> DataFrame:
    """The chunks of the named pages."""
    return structured_read(chunks, documents, public, F.col("canonical_uri").isin(*uris))


def corpus_scan(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """All chunks of active documents, whatever their scope, with what an evaluation needs of them."""
    live = documents.where("status = 'active'").select("canonical_uri", "source_scope")
    return chunks.select("canonical_uri", "chunk_index", "content_hash", "content").join(live, "canonical_uri")
