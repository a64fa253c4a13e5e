from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from corpusmill import commands, errors, scratch
from corpusmill.operators import backfill, composition as C, runs
from corpusmill.operators.hierarchy import ListSpec
from corpusmill.sources import sinks
from corpusmill.sources.sinks import Snapshots, single_run


def posts(spark, rows):
    return spark.createDataFrame([(i, u, t, h, q, a) for i, u, t, h, q, a in rows], "id bigint, url string, title string, html string, question1 string, answer1 string")


def test_post_records(spark):
    rows = [
        (1, "one", "One", "<h2>H</h2><p>body</p>", "<p>1. Why?</p>", "<p>Because.</p>"), (2, "two", "a", "<p>x</p>", None, None), (3, "three", "T", " \n", None, None),
        (4, None, "T", "<p>x</p>", None, None), (5, "five", "T", "<p>x</p>", "<ol><li>Why?</li></ol>", "<img src=x>"), (6, "six", "", "<p>x</p>", None, None), (7, "seven", "T", "<hr>", None, None),
    ]
    found = {r["source_ref"]: r for r in C.post_records(posts(spark, rows), "https://e.com/blog/", slots=1).collect()}
    assert {k: r["reason"] for k, r in found.items()} == {
        "post#1": None, "post#2": "placeholder_record", "post#3": "empty_body", "post#4": "unusable_identity", "post#5": None, "post#6": "empty title", "post#7": "no content blocks",
    }
    assert [b["type"] for b in found["post#1"]["blocks"]] == ["heading", "paragraph", "faq_pair"]
    assert found["post#1"]["blocks"][2]["question"] == "1. Why?" and found["post#5"]["half_pairs"] == 1
    assert found["post#1"]["canonical_uri"] == "https://e.com/blog/one"


def test_composed_page(spark):
    tables = {
        "page": spark.createDataFrame([(1, "p", "Page", 5, True), (2, "q", "Other", None, True), (3, "r", "Hidden", 5, False)], "id int, slug string, title string, intro int, live boolean"),
        "intro": spark.createDataFrame([(5, "Intro ", "img.png")], "id int, head string, pic string"),
        "note": spark.createDataFrame([(9, "late"), (4, "first")], "id int, words string"),
        "link": spark.createDataFrame([(2, 5, 1), (1, 5, 2), (3, 5, 1)], "id int, intro int, item int"),
        "item": spark.createDataFrame([(1, "Alpha", "a b"), (2, "Beta", "")], "id int, name string, words string"),
    }
    cards = ListSpec("link", "intro", "item", "item", ("name", "words"), name="cards")
    every = ListSpec("item", "id", "id", "item", ("name", "words"), name="every")
    page = C.Page("s", "page", "https://e.com/", "page", "slug", "title", (
        C.Section("intro", "intro", ("head", "pic"), (C.Step("heading", "head"), C.Step("cards", "cards", ("name", "words"), level=3), C.Step("items", "cards", ("name",)), C.Step("table", "cards", ("name", "words"), header=("N", "W")), C.Step("pairs", "cards", ("name", "words")), C.Step("image", "pic")), (cards,), "intro"),
        C.Section("note", "note", ("words",), (C.Step("fixed", text="Fixed."), C.Step("paragraph", "words"), C.Step("items", "every", ("name",))), whole_lists=(every,)),
    ), published="live")
    found = {r["title"]: r for r in C.compose_pages(tables, page).collect()}
    assert set(found) == {"Page", "Other"}
    told = [(b["type"], b["text"] or b["items"] or b["rows"] or b["question"]) for b in found["Page"]["blocks"]]
    assert told == [
        ("heading", "Intro"), ("heading", "Beta"), ("heading", "Alpha"), ("paragraph", "a b"), ("heading", "Alpha"), ("paragraph", "a b"), ("list", ["Beta", "Alpha"]),
        ("table", [["Beta", ""], ["Alpha", "a b"], ["Alpha", "a b"]]), ("faq_pair", "Alpha"), ("faq_pair", "Alpha"), ("paragraph", "Fixed."), ("paragraph", "first"), ("list", ["Alpha", "Beta"]),
    ]
    assert found["Other"]["missing_sections"] == ["intro"] and found["Page"]["images"][0]["src"] == "img.png"


def test_runs_and_backfill(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    first = posts(spark, [(1, "one", "One", "<p>alpha beta</p>", None, None), (2, "two", "Two", "<p>gamma</p>", None, None), (3, "bad", "a", "<p>x</p>", None, None)])
    records = C.post_records(first, "https://e.com/").withColumn("ordinal", F.col("extractor_version").cast("bigint"))
    pages = records.select("canonical_uri")
    report = runs.synchronize_scope(spark, root, "blog", records, pages)
    assert (report["new"], report["refused"], report["missing"]) == (2, {"placeholder_record": 1}, 0)
    assert runs.backfill_store(spark, root, "m", 8) == {"texts": 2, "written": 0}
    done = runs.backfill_store(spark, root, "m", 8, backfill.hashing_embedder(8))
    assert (done["texts"], done["written"], done["embedded_texts"], done["batches"], done["pending_after"], done["stop_reason"]) == (2, 2, 2, 1, 0, None)
    assert runs.backfill_store(spark, root, "m", 8, backfill.hashing_embedder(8))["texts"] == 0
    second = posts(spark, [(1, "one", "One", "<p>alpha beta</p>", None, None), (4, "four", "Four", "<p>delta</p>", None, None)])
    records = C.post_records(second, "https://e.com/").withColumn("ordinal", F.lit(1).cast("bigint"))
    report = runs.synchronize_scope(spark, root, "blog", records, records.select("canonical_uri"))
    assert (report["new"], report["unchanged"], report["missing"]) == (1, 1, 1)
    state = {r["canonical_uri"]: r for r in Snapshots(spark, root).read("documents").collect()}
    assert state["https://e.com/two"]["gone_count"] == 1 and state["https://e.com/one"]["gone_count"] == 0
    chunks = {r["canonical_uri"]: r["embedding"] is not None for r in Snapshots(spark, root).read("chunks").collect()}
    assert chunks == {"https://e.com/one": True, "https://e.com/two": True, "https://e.com/four": False}
    skipped = runs.synchronize_scope(spark, root, "blog", records.where("false"), records.select("canonical_uri").where("false"))
    assert skipped["reconciliation_skipped"] == "empty inventory while active documents exist"
    with pytest.raises(Exception):
        runs.synchronize_scope(spark, root, "blog", records.drop("title"), pages)
    states = [r["run_status"] for r in spark.read.parquet(f"{root}/ledger").orderBy("at").collect()]
    assert states[:2] == ["running", "succeeded"] and states[-1] == "failed"


def test_commands(spark, tmp_path, base, capsys):
    root = f"file://{tmp_path}/store"
    assert commands.main(["sync", "--base", base, "--store", root], spark) == 0
    reports = [json.loads(line) for line in capsys.readouterr().out.splitlines()]
    assert [r["scope"] for r in reports] == ["blog", "service_faq"] and all(r["new"] > 0 for r in reports)
    assert commands.main(["backfill", "--store", root], spark) == 0
    with single_run(spark, root):
        assert commands.main(["backfill", "--store", root], spark) == 2
    assert commands.main(["sync", "--base", "/nowhere", "--store", root], spark) == 1
    assert commands.main(["query", "chunk_windows", "--base", base, "--to", str(tmp_path / "out")], spark) == 0


def test_a_backfill_is_no_delivery(spark, tmp_path):
    with pytest.raises(errors.InvalidRequest) as caught:
        runs.synchronize_scope(spark, str(tmp_path), "s", spark.range(0), spark.range(0), mode="backfill")
    assert caught.value.problem() == {"title": "Invalid Request", "status": 400, "detail": "a backfill delivers no records"}
    assert issubclass(errors.NotEmbedded, LookupError) and issubclass(sinks.RunIsActive, errors.RunConflict)


def test_tables_of_a_scope_go_with_it(spark):
    kept = scratch.durable(spark.range(2))
    with pytest.raises(RuntimeError), scratch.scope():
        gone = scratch.durable(spark.range(3))
        assert gone.count() == 3
        raise RuntimeError
    path = gone.inputFiles()[0] if gone.rdd.getNumPartitions() else ""
    assert kept.count() == 2 and not (path and spark._jvm.java.io.File(path.removeprefix("file:")).exists())
