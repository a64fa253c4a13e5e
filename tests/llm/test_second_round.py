"""Neighbours that lists far wider than neighbourhoods keep apart."""

from __future__ import annotations

import numpy as np

from corpusmill.llm.similar_vectors import similar_pairs


def test_neighbours_are_found_where_lists_hold_many_neighbourhoods(spark):
    # neighbourhoods of eight at random places, as in the tables; 128 lists over 12,000 rows have them cut at every border
    rng = np.random.default_rng(5)
    heads = np.repeat(rng.standard_normal((1500, 64)), 8, axis=0)
    x = (heads + 0.33 * rng.standard_normal(heads.shape)).astype(np.float32)
    ids = rng.permutation(len(x)) + 1
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    want = set()
    for at in range(0, len(x), 2000):
        scores = unit[at : at + 2000] @ unit.T
        scores[np.arange(len(scores)), at + np.arange(len(scores))] = -1
        for i, near in enumerate(np.argsort(-scores, axis=1)[:, :5]):
            want |= {(min(ids[at + i], ids[j]), max(ids[at + i], ids[j])) for j in near if scores[i, j] >= 0.85}
    rows = [(int(i), str(i), "m", v.tolist()) for i, v in zip(ids, x, strict=True)]
    df = spark.createDataFrame(rows, "chunk_id bigint, content_hash string, embedding_model string, embedding array<float>")
    got = {tuple(r) for r in similar_pairs(df, "m", 64, sample_rows=1536).collect()}
    assert len(got & want) > 0.98 * len(want) and len(got & want) > 0.99 * len(got)
