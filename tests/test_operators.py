from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from corpusmill.functions.blocks import BLOCKS
from corpusmill.operators import backfill, chunking, hierarchy, matching, ranking, synchronize, vectors


def naive_chunks(units, size, overlap):
    out, run = [], []

    def flush():
        joined = "\n\n".join(run)
        run.clear()
        at = 0
        while joined:
            out.append(joined[at : at + size])
            if at + size >= len(joined):
                break
            at += size - overlap

    for atomic, words in units:
        if atomic:
            flush()
            if words:
                out.append(words)
        elif words:
            run.append(words)
    flush()
    return out


def test_chunks_against_plain_loop(spark):
    rng = random.Random(2)
    documents, want = [], {}
    for key in range(60):
        units, blocks = [], []
        for _ in range(rng.randrange(0, 7)):
            words = "".join(rng.choice("ab ") for _ in range(rng.choice((0, 1, 5, 40, 90)))).strip()
            if rng.random() < 0.3:
                units.append((True, "q\n" + words if words else "q"))
                blocks.append({"type": "faq_pair", "question": "q", "answer": [{"type": "paragraph", "text": words}]})
            elif rng.random() < 0.2:
                units.append((False, ""))
                blocks.append({"type": "image", "alt": " Contact  US "})
            else:
                units.append((False, words))
                blocks.append({"type": "paragraph", "text": words})
        documents.append((key, blocks))
        want[key] = naive_chunks(units, 30, 7)
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(f"k int, b {BLOCKS}")
    names = [f.name for f in schema["b"].dataType.elementType.fields]
    leaf = [f.name for f in schema["b"].dataType.elementType["answer"].dataType.elementType.fields]
    fill = lambda b: {n: b.get(n) if n != "answer" or b.get(n) is None else [{m: a.get(m) for m in leaf} for a in b[n]] for n in names}
    df = spark.createDataFrame([(k, [fill(b) for b in bs]) for k, bs in documents], schema)
    got: dict[int, list[str]] = {k: [] for k in want}
    for r in sorted(chunking.document_chunks(df, "k", "b", 30, 7).collect(), key=lambda r: (r["k"], r["chunk_index"])):
        got[r["k"]].append(r["content"])
    assert got == want


def test_window_context(spark):
    units = spark.createDataFrame([(1, 0, "aaaa", ["A"]), (1, 1, "bbbb", ["A", "B"]), (1, 2, "cc", ["C"])], "k int, ord int, text string, heading_path array<string>")
    chunks = spark.createDataFrame([(1, 0, "aaaa"), (1, 1, "x"), (1, 2, "y")], "k int, chunk_index int, content string")
    rows = {r["chunk_index"]: r["heading_path"] for r in chunking.window_context(chunks, units, "k", 8, 2).collect()}
    assert rows == {0: ["A"], 1: ["A", "B"], 2: ["C"]}


def test_vectors_edge_cases(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [1.0]), (6, [2.0, 0.0]), (7, [1.0, 1.0])], "id bigint, embedding array<float>")
    queries = spark.createDataFrame([(9, [3.0, 0.0]), (10, [0.0, 0.0])], "query_id bigint, query_embedding array<float>")
    found = vectors.nearest_chunks(rows, queries, 2, 2, ["id"]).collect()
    assert [(r["query_id"], r["id"], r["score"], r["rank"]) for r in sorted(found, key=lambda r: r["rank"])] == [(9, 1, 1.0, 1), (9, 6, 1.0, 2)]
    problems = {r["id"]: r["p"] for r in rows.select("id", vectors.vector_problem(F.col("embedding"), 2).alias("p")).collect()}
    assert problems == {1: None, 2: "zero", 3: "missing", 4: "not_finite", 5: "dimension", 6: None, 7: None}
    assert vectors.nearest_chunks(rows.where("false"), queries, 2, 2, ["id"]).count() == 0
    assert vectors.nearest_chunks(rows, queries.where("false"), 2, 2, ["id"]).count() == 0
    value = rows.where("id = 7").select(vectors.cosine(F.col("embedding"), F.array(F.lit(1.0), F.lit(0.0))).alias("c")).first()["c"]
    assert value == pytest.approx(2**-0.5)


def test_coverage(spark):
    chunks = spark.createDataFrame([(1, [1.0], "m"), (2, None, "n")], "id int, embedding array<float>, embedding_model string")
    assert vectors.covered(chunks, "m").count() == 1
    with pytest.raises(LookupError):
        vectors.covered(chunks, "n")


def test_limits():
    with pytest.raises(ValueError):
        vectors.Limits({"x": 1}).check({"y"})
    with pytest.raises(ValueError):
        vectors.Limits({"y": 30}, 2, 50).check({"y"})
    with pytest.raises(ValueError):
        vectors.narrowed(None, ["a"], ["b"])


def test_evidence_problems(spark):
    good = ("blog", "h" * 64, 1, "vector", 0.5, "https://e.com", "https://e.com", "t")
    rows = [good, ("secret", *good[1:]), (*good[:1], "x", *good[2:]), (*good[:4], None, *good[5:]), (*good[:5], "http://e.com", *good[6:]), (*good[:7], "12345678-1234-1234-1234-123456789abc")]
    df = spark.createDataFrame(rows, "source_scope string, content_hash string, rank int, method string, score double, citation_uri string, canonical_uri string, title string")
    assert sorted(r["problem"] for r in vectors.evidence_problems(df, ["blog"]).collect()) == ["citation", "hash", "identifier", "scope", "score"]


STORE = "canonical_uri string, source_scope string, status string, content_hash string, hash_version int, normalizer_version int, extractor_version int, chunker_version int, gone_count int, consecutive_failure_count int, last_seen_at timestamp, last_run_id string"


def page(uri, status="active", digest="a", version=1):
    return (uri, "s", status, digest, 1, 3, version, 3, 2, 1, None, "r0")


def test_a_run(spark):
    store = spark.createDataFrame([page("same"), page("moved"), page("back", "archived"), page("old", version=0), page("gone"), page("broken")], STORE)
    names = ["canonical_uri", "ordinal", "content_hash", "hash_version", "normalizer_version", "extractor_version", "chunker_version"]
    rows = [("same", 1, "a"), ("moved", 2, "b"), ("moved", 3, "b"), ("back", 4, "a"), ("old", 5, "a"), ("new", 6, "a"), ("new", 7, "c"), (None, 8, "a")]
    delivery = spark.createDataFrame([(*r, 1, 3, 1, 3) for r in rows], ", ".join(f"{n} {'string' if n in ('canonical_uri', 'content_hash') else 'int'}" for n in names))
    outcomes = synchronize.record_outcomes(store, delivery)
    got = {(r["canonical_uri"], r["ordinal"]): (r["outcome"], r["rebuild"]) for r in outcomes.collect()}
    assert got == {
        ("same", 1): ("unchanged", False), ("moved", 2): ("changed", True), ("moved", 3): ("unchanged", False), ("back", 4): ("restored", False), ("old", 5): ("reprocessed", True), ("new", 6): ("new", True), ("new", 7): ("changed", True),
    }
    assert synchronize.outcome_counts(outcomes).first().asDict() == {"new": 1, "unchanged": 2, "changed": 2, "reprocessed": 1, "restored": 1}
    missing = synchronize.missing_pages(store, delivery, "s")
    assert sorted(r[0] for r in missing.collect()) == ["broken", "gone"]
    failures = spark.createDataFrame([("broken", 2)], "canonical_uri string, failed int")
    after = {r["canonical_uri"]: r for r in synchronize.next_store(store, outcomes, failures, missing, F.lit("r1"), F.lit("2025-01-01").cast("timestamp")).collect()}
    assert {u: (r["status"], r["gone_count"], r["consecutive_failure_count"], r["content_hash"], r["last_run_id"]) for u, r in after.items()} == {
        "same": ("active", 0, 0, "a", "r1"), "moved": ("active", 0, 0, "b", "r1"), "back": ("active", 0, 0, "a", "r1"), "old": ("active", 0, 0, "a", "r1"),
        "new": ("active", 0, 0, "c", "r1"), "gone": ("active", 3, 1, "a", "r0"), "broken": ("active", 3, 3, "a", "r0"),
    }
    assert synchronize.may_reconcile(store, delivery, False, "s") == "inventory incomplete"
    assert synchronize.may_reconcile(store, delivery.where("false"), True, "s") == "empty inventory while active documents exist"
    assert synchronize.may_reconcile(store, delivery, True, "s") is None


def test_nested_lists(spark):
    tables = {
        "page": spark.createDataFrame([(1, "p", 10), (2, "q", None), (3, "r", 99)], "id int, title string, intro_id int"),
        "intro": spark.createDataFrame([(10, "Intro", "None")], "id int, head string, tail string"),
        "link": spark.createDataFrame([(1, 10, 7), (2, 10, 5), (3, 10, 404)], "id int, intro int, item int"),
        "item": spark.createDataFrame([(5, "five"), (7, "seven")], "id int, name string"),
        "sublink": spark.createDataFrame([(1, 5, 2), (2, 5, 1)], "id int, item int, sub int"),
        "sub": spark.createDataFrame([(1, "one"), (2, "two")], "id int, word string"),
    }
    inner = hierarchy.ListSpec("sublink", "item", "sub", "sub", ("word",), name="subs")
    outer = hierarchy.ListSpec("link", "intro", "item", "item", ("name",), nested=inner)
    spec = hierarchy.PageSpec("page", ("title",), (hierarchy.SectionSpec("intro", "intro", "intro_id", ("head", "tail"), (outer,), {"tail": ("None",)}),))
    rows = {r["title"]: r for r in hierarchy.assemble(tables, spec).collect()}
    section = rows["p"]["section_intro"]
    assert (section["head"], section["tail"]) == ("Intro", None)
    assert [(i["name"], [s["word"] for s in i["subs"]]) for i in section["items"]] == [("seven", []), ("five", ["two", "one"])]
    assert rows["q"]["missing_sections"] == rows["r"]["missing_sections"] == ["intro"]


def test_matching(spark):
    a = spark.createDataFrame([(1, "x/Audit_Report-final.png"), (2, "plain"), (3, None), (4, "")], "a int, n string")
    b = spark.createDataFrame([(10, "audit report final.jpg"), (11, "audit_report-final.png"), (12, "audit report final version two"), (13, "Plain")], "b int, m string")
    got = {(r["a"], r["b"]): r["tier"] for r in matching.name_matches(a, b, "a", "b", "n", "m").collect()}
    assert got == {(1, 10): "folded", (1, 11): "exact", (1, 12): "truncated", (2, 13): "exact"}
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "child string, parent string")
    walk = {(r["ancestor"], r["depth"]) for r in matching.ancestors(edges, spark.createDataFrame([("a",)], "id string"), 5).collect()}
    assert walk == {("a", 0), ("b", 1), ("c", 2)}


def test_ranking_of_nothing(spark):
    none = spark.createDataFrame([], "category string, rank int")
    row = ranking.metrics_by_category(none, "category", "rank", [1]).collect()
    assert [(r["cases"], r["recall_1"], r["mrr"]) for r in row if r["is_total"]] in ([], [(0, 0.0, 0.0)])
    both = spark.createDataFrame([(["a"], ["a", "b"]), ([], [])], "x array<string>, y array<string>")
    assert [r[0] for r in both.select(ranking.jaccard(F.col("x"), F.col("y"))).collect()] == [0.5, 1.0]


def test_backfill_is_idempotent(spark):
    rows = [(1, "h1", "one", None, None), (2, "h1", "one", None, None), (3, "h2", "two", [1.0, 0.0], "other"), (4, "h3", "three", [0.0, 1.0], "m")]
    chunks = spark.createDataFrame(rows, "chunk_id bigint, content_hash string, content string, embedding array<float>, embedding_model string")
    planned = backfill.plan(chunks, "m")
    assert sorted(r["content_hash"] for r in planned.collect()) == ["h1", "h2"]
    assert {r["batch_no"] for r in backfill.in_batches(planned, 1).collect()} == {0, 1}
    filled = backfill.write_back(chunks, backfill.embed(planned, backfill.hashing_embedder(2), 2), "m")
    assert filled.columns == chunks.columns and filled.where("embedding_model = 'm'").count() == 4
    assert backfill.plan(filled, "m").count() == 0
    assert sorted(r["chunk_id"] for r in backfill.broken_hashes(chunks).collect()) == [1, 2, 3, 4]


def test_corpus_fingerprint_is_one_stream_over_sorted_hashes(spark):
    rng = random.Random(2)
    hashes = [hashlib.sha256(str(rng.randrange(400)).encode()).hexdigest() for _ in range(1500)] + ["f" * 64] * 9000
    df = spark.createDataFrame([(h,) for h in [*hashes, None]], "h string").repartition(7)
    want = hashlib.sha256("".join(sorted(hashes)).encode()).hexdigest()
    assert tuple(ranking.corpus_fingerprint(df, "h").first()) == (want, len(hashes))
    assert tuple(ranking.corpus_fingerprint(df.where("false"), "h").first()) == (hashlib.sha256(b"").hexdigest(), 0)
