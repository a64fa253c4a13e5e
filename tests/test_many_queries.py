"""Searches of so many queries that chunks pass by in small parts."""

from __future__ import annotations

import numpy as np

from corpusmill.operators import vectors


def test_what_is_handed_on_does_not_grow_with_the_parts(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((600, 4)).astype(np.float32)
    rows = spark.createDataFrame([(i, "ab"[i % 2], v.tolist()) for i, v in enumerate(x)], "id bigint, lane string, embedding array<float>").coalesce(2)
    asked = rows.where("id < 40").selectExpr("id as query_id", "embedding as query_embedding")
    monkeypatch.setattr(vectors, "SCORES", 40 * 10)  # ten rows at a time, five of either lane
    sent = []
    whole = vectors.nearest
    monkeypatch.setattr(vectors, "nearest", lambda best, *more: sent.append(best.count()) or whole(best, *more))
    got = {(r["query_id"], r["lane"], r["id"]) for r in vectors.nearest_chunks(rows, asked, 4, 3, ["id"], lane="lane").collect()}
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    scores = np.round(unit @ unit.T, 6)
    want = {(q, "ab"[own], i) for q in range(40) for own in (0, 1) for i in sorted(range(own, 600, 2), key=lambda i: (-scores[q, i], i))[:3]}
    assert got == want and sent[0] < 1.1 * 40 * 2 * 3
