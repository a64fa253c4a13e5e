"""Personal information by names, words and weights of all documents, not of a sample."""

from __future__ import annotations

import numpy as np

from corpusmill.llm import personal_information as pii
from tests.llm.test_personal_information import DOCS, make


def test_small_parts_make_one_model_of_all_documents(spark):
    texts, truth = make(4, 900)
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    model = pii._model(df, 150, 11).value
    assert model.names == pii.gather_names(texts)
    assert model.ordinary == pii._ordinary_words([pii.weak_labels(t, model.names) for t in texts])
    other = pii._model(spark.createDataFrame(rows[::-1], DOCS).repartition(5), 150, 11).value
    assert all(np.array_equal(getattr(model, name), getattr(other, name)) for name in ("own", "near", "triples", "steps", "skips"))
    found = {tuple(r)[:3] for r in pii.find_personal_information(df, fit_documents=150).collect()}
    want = {(n, k, s) for n, own in enumerate(truth) for k, s in own}
    assert len(found & want) > 0.98 * len(want) and len(found & want) > 0.98 * len(found)


def test_shares_do_not_grow_with_the_table():
    texts = ["Please call Ms Anna Karlstein on Monday."] * 30 + ["yours truly, anna"] * 5 + ["The lead auditor samples the plan."] * 2965
    one, many = pii.gather_names(texts), pii.gather_names(texts * 4)
    assert one == many and one.given == {"anna"}
