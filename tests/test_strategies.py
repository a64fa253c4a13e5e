"""The two reference strategies of the report against a plain loop over the cases."""

from __future__ import annotations

import math
from collections import defaultdict

from corpusmill.plans import retrieval
from corpusmill.sources.tables import read_table


def chosen(hits, documents):
    best = sorted(hits, key=lambda h: (-h["top_score"], h["hit_id"]))[:50]
    by_document = defaultdict(list)
    for h in best:
        by_document[h["document_uri"]].append(h)
    return [h for own in list(by_document.values())[:documents] for h in own[:2]]


def test_reference_strategies(spark, base):
    hits = [r.asDict() for r in read_table(spark, base, "evaluate_retrieval").collect()]
    lane = lambda h: "blog" if h["lane"] == "blog" else "own"
    lanes, of_case = defaultdict(set), defaultdict(list)
    for h in hits:
        if h["document_uri"] is not None:
            lanes[h["document_uri"]].add(lane(h))
            if h["top_score"] is not None and not math.isnan(h["top_score"]) and -1 <= h["top_score"] <= 1:
                of_case[h["case_id"]].append(h)
    want = {"unlaned": [0, 0], "home": [0, 0]}
    for case in read_table(spark, base, "golden_cases").collect():
        own, page = of_case[case["case_id"]], case["expected_document_uri"]
        homes = lanes.get(page) or {"own", "blog"}
        kept = {"unlaned": chosen(own, 8), "home": [h for n, quota in (("own", 5), ("blog", 2)) if n in homes for h in chosen([h for h in own if lane(h) == n], quota)]}
        for name, rows in kept.items():
            want[name][0] += len(rows)
            want[name][1] += any(h["document_uri"] == page for h in rows)
    got = {r["strategy"]: [r["chunks"], r["cases_hit"]] for r in retrieval.strategy_report(spark, base).collect()}
    assert len(got) == 14 and {n: got[n] for n in want} == want
    grid = {r["strategy"]: [r["chunks"], r["cases_hit"]] for r in retrieval.strategy_grid(spark, base).collect()}
    assert {n: got[n] for n in grid} == grid
