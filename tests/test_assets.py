from __future__ import annotations

import json

from pyspark.sql import functions as F

from corpusmill.operators import assets
from corpusmill.sources import rest


def test_keys_and_urls(spark):
    rows = [("/set/", "a.png", "set/a.png"), ("set", "b/c.png", None), ("a\\b", "c.png", None), ("..", "c.png", None), ("set", "c.gif", None), (None, "c.png", None)]
    df = spark.createDataFrame(rows, "c string, n string, want string")
    assert all(r["k"] == r["want"] for r in df.select("want", assets.image_key(F.col("c"), F.col("n")).alias("k")).collect())
    urls = spark.createDataFrame([("//cdn/x", "https://cdn/x"), ("https://e.com/a", "https://e.com/a"), ("/m/a b+c.png", "https://r/m/a%20b%2Bc.png")], "p string, want string")
    assert all(r["u"] == r["want"] for r in urls.select("want", assets.public_url(F.col("p"), "https://r/").alias("u")).collect())


def test_roots_proofs_and_states(spark):
    pairs = spark.createDataFrame([("https://m/x/a.png", "/a.png"), ("https://m/x/d/b.png", "d/b.png"), ("https://other", "c")], "u string, p string")
    assert assets.media_root(pairs, "u", "p").first().asDict() == {"root": "https://m/x", "pairs": 2}
    mixed = pairs.unionByName(spark.createDataFrame([("https://n/a.png", "a.png")], pairs.schema))
    assert assets.media_root(mixed, "u", "p").first()["root"] is None
    mapping = spark.createDataFrame([("i", "p", "d"), ("j", "p", "x")], "item string, page string, digest string")
    proofs = spark.createDataFrame([("i", "p", "d", "confirmed_exact"), ("j", "p", "d", "confirmed_exact")], "item string, page string, digest string, status string")
    assert {tuple(r) for r in assets.proven_mappings(mapping, proofs).collect()} == {("i", "p", "confirmed"), ("j", None, "unresolved")}
    a, b = spark.createDataFrame([("i",), ("j",)], "k string"), spark.createDataFrame([("j",)], "k string")
    assert [tuple(r) for r in assets.disjoint_problems([a, b], "k").collect()] == [("j", 2)]
    names = spark.createDataFrame([("nav_x",), ("page",), ("page_meta",)], "n string")
    assert {r["n"]: r["excluded"] for r in assets.table_kinds(names, "n", ["nav_"], ["_meta"]).collect()} == {"nav_x": "prefix nav_", "page": None, "page_meta": "suffix _meta"}
    assert assets.longest_first(spark.createDataFrame([("k", "ab"), ("k", "abc"), ("k", "abd")], "k string, v string"), "k", "v").first()["v"] == "abc"


def test_same_content(spark):
    from tests.test_functions import png
    import numpy as np

    pixels = np.random.default_rng(2).integers(0, 255, (3, 3, 4), dtype=np.uint8)
    files = {"a": png(pixels, 6, 0), "b": png(pixels, 6, 1), "c": png(255 - pixels, 6, 0)}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "id string, content binary").withColumns({"digest": F.sha2("content", 256), "width": F.lit(3), "height": F.lit(3)})
    got = {tuple(r) for r in assets.same_content(df.where("id = 'a'"), df).collect()}
    assert got == {("a", "a", "confirmed_exact"), ("a", "b", "confirmed_pixel_identical")}


def test_records_json_and_plans(spark):
    rows = spark.createDataFrame([(1, "x", "A", 2, "x  A"), (2, " ", "B", 0, "no")], "id int, s string, c string, n int, whole string")
    problems = assets.record_problems(rows, "id", ["s"], ["s"], {"c": ["A"]}, ["n"], (F.concat_ws(" ", "s", "c"), "whole"))
    assert sorted(tuple(r) for r in problems.collect()) == [(2, "n must be positive"), (2, "s must not be empty"), (2, "unknown c"), (2, "whole is not rebuilt")]
    value = {"a": ["x", {"b:": 'q"\\: y'}], "c": "é\n", "n": 1}
    got = spark.createDataFrame([(json.dumps(value),), ("[]",)], "j string").select(assets.json_strings(F.col("j")).alias("s")).collect()
    assert [sorted(r["s"]) for r in got] == [sorted(["x", 'q"\\: y', "é\n"]), []]
    assert assets.plan_operators(spark.range(9).groupBy().count()).get("HashAggregate", 0) >= 1
    same = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    assert {tuple(r) for r in assets.replay_differences(same, same.distinct(), ["k"]).collect()} == {(1, "stored", 1)}


def test_json_pages(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"results": [{"k": 1}, 2, {"k": "ü"}]}))
    rows = rest.read_json_pages(spark, [f"file://{tmp_path}/a.json"]).orderBy("position").collect()
    assert [json.loads(r["object"]) for r in rows] == [{"k": 1}, {"k": "ü"}]
