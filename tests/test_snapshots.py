from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

import pytest

from corpusmill.operators.snapshots import change_counts, compare_snapshots, fold_json, fold_text, page_key
from corpusmill.sources.tables import read_table

CONTRACT = "record_id bigint, run_id bigint, source_scope string, canonical_uri string, title string, blocks string, lang string, content_type string, retrieved_at timestamp, next_run string, side string"
RUNS = "run_id bigint, source_scope string, run_mode string, run_status string, started_at timestamp, inventory_complete boolean, changed int, pair string"
T0 = datetime(2024, 1, 1)


def run(i, scope="s", mode="sync", status="succeeded", complete=True, changed=0):
    return (i, scope, mode, status, T0 + timedelta(days=i or 0), complete, changed, "x")


def record(i, run_id, uri, title="t", blocks="[]", lang="en", kind="page", minute=0):
    return (i, run_id, "s", uri, title, blocks, lang, kind, T0 + timedelta(minutes=minute), "x", "x")


def changes(spark, records, runs):
    rows = compare_snapshots(spark.createDataFrame(records, CONTRACT), spark.createDataFrame(runs, RUNS)).collect()
    return {tuple(r) for r in rows}


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ("  HTTPS://Www.Example.COM:443/A/b/?q=1#x ", "https://www.example.com/A/b"),
        ("http://e.com:80/%7euser/%2fx%c3%a9", "http://e.com/~user/%2Fx%C3%A9"),
        ("http://e.com:8080", "http://e.com:8080"),
        ("https://e.com/", "https://e.com"),
        ("/just/a/path/", "/just/a/path"),
        (None, None),
    ],
)
def test_page_key(given, wanted):
    assert page_key(given) == wanted


def test_json_values():
    assert fold_json('{"b": 1.0, "a": ["x  y"]}') == fold_json('{"a":["x y "],"b":1}')
    assert fold_json("[1,2]") != fold_json("[2,1]")
    assert fold_json("not json") == fold_json("not  json") != fold_json('"not json"')
    assert fold_json('"caf\\u0065\\u0301"') == fold_json('"café"')
    assert fold_json(None) is None


def test_changes(spark):
    runs = [run(1), run(2, status="failed", complete=False), run(3), run(4, mode="backfill"), run(5)]
    records = [
        record(1, 1, "https://e.com/a"), record(2, 1, "https://e.com/b"), record(3, 1, "https://e.com/c", blocks='{"x": 1, "y": 2}'),
        record(4, 2, "https://e.com/zzz"),
        record(5, 3, "https://E.com/a/"), record(6, 3, "https://e.com/c", blocks='{"y":2,"x":1}'), record(7, 3, "https://e.com/d", title="new"), record(7, 3, "https://e.com/d", title="new"),
        # superseded records of one page: the latest counts, then the highest record_id
        record(8, 5, "https://e.com/a", title="old", minute=1), record(9, 5, "https://e.com/a", title="t", minute=2), record(10, 5, "https://e.com/c", title="1"), record(11, 5, "https://e.com/c", title="2"),
    ]
    assert changes(spark, records, runs) == {
        (3, "https://e.com/b", "removed"), (3, "https://e.com/d", "added"), (5, "https://e.com/d", "removed"), (5, "https://e.com/c", "changed"),
    }


def test_nulls_empty_and_long(spark):
    runs = [run(1), run(2), run(None), (9, None, "sync", "succeeded", None, None, None, None)]
    records = [record(1, 1, None), record(None, 1, "https://e.com/a", None, None, None, None), record(2, 2, "https://e.com/a", None, "x" * 200_000, None, None), record(3, None, "https://e.com/q")]
    assert changes(spark, records, runs) == {(2, "https://e.com/a", "changed")}
    assert changes(spark, [], []) == set()
    assert changes(spark, records, []) == set()


def test_against_brute_force(spark, base):
    contract, runs = read_table(spark, base, "contract"), read_table(spark, base, "runs")
    rows, ledger = [r.asDict() for r in contract.collect()], [r.asDict() for r in runs.collect()]
    good = sorted((r for r in ledger if r["run_mode"] == "sync" and r["run_status"] == "succeeded" and r["inventory_complete"]), key=lambda r: (r["source_scope"], r["started_at"]))
    state = {}
    for r in sorted(rows, key=lambda r: (r["retrieved_at"], r["record_id"])):
        state[r["run_id"], page_key(r["canonical_uri"])] = (fold_text(r["title"]), fold_json(r["blocks"]), r["lang"], r["content_type"])
    want = set()
    for before, now in zip(good, good[1:], strict=False):
        if before["source_scope"] == now["source_scope"]:
            a = {u: c for (run_id, u), c in state.items() if run_id == before["run_id"]}
            b = {u: c for (run_id, u), c in state.items() if run_id == now["run_id"]}
            want |= {(now["run_id"], u, "added") for u in b.keys() - a.keys()} | {(now["run_id"], u, "removed") for u in a.keys() - b.keys()}
            want |= {(now["run_id"], u, "changed") for u in a.keys() & b.keys() if a[u] != b[u]}
    assert {tuple(r) for r in compare_snapshots(contract, runs).collect()} == want
    counts = {r["run_id"]: r["true_changed"] for r in change_counts(contract, runs).collect()}
    assert counts == {now["run_id"]: sum(1 for w in want if w[0] == now["run_id"] and w[2] == "changed") for before, now in zip(good, good[1:], strict=False) if before["source_scope"] == now["source_scope"]}


def test_random_multisets(spark):
    rng = random.Random(4)
    pages = {k: {f"https://e.com/{i}": rng.choice("xyz") for i in range(12) if rng.random() < 0.7} for k in (1, 2)}
    records = [record(n, k, u, title=t) for n, (k, u, t) in enumerate((k, u, t) for k, own in pages.items() for u, t in own.items())]
    a, b = pages[1], pages[2]
    want = {(2, u, "added") for u in b.keys() - a.keys()} | {(2, u, "removed") for u in a.keys() - b.keys()} | {(2, u, "changed") for u in a.keys() & b.keys() if a[u] != b[u]}
    assert changes(spark, records, [run(1), run(2)]) == want
    assert json.loads(fold_json("[1, 2.5, true]")) == [1, 2.5, True]
