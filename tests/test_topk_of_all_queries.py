"""Grouped top-k for every query of the stated set."""

from __future__ import annotations

from corpusmill.plans import retrieval
from corpusmill.sources.tables import read_table


def test_every_query_is_searched(spark, base):
    rows = retrieval.exact_topk_grouped_all(spark, base).collect()
    ids = {r["vec_id"] for r in read_table(spark, base, "embeddings").select("vec_id").collect()}
    assert {r["query_id"] for r in rows} == {i for i in ids if i % 50 == 0} and len({r["query_id"] for r in rows}) > 1
    one = sorted(tuple(r) for r in retrieval.exact_topk_grouped(spark, base).collect())
    assert sorted(tuple(r)[1:] for r in rows if r["query_id"] == 0) == one
    for query in {r["query_id"] for r in rows}:
        own = [r for r in rows if r["query_id"] == query]
        assert max(r["document_rank"] for r in own) <= 8 and max(r["chunk_rank"] for r in own) <= 2
        assert min(own, key=lambda r: (r["document_rank"], r["chunk_rank"]))["vec_id"] is not None
