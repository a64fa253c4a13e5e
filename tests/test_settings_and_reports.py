from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from corpusmill import commands, settings
from corpusmill.operators import composition, ranking, vectors
from corpusmill.sources import blog, readers, sinks


def test_settings_are_typed():
    found = settings.load({"CORPUSMILL_STORE": " /s ", "CORPUSMILL_BATCH_SIZE": "7", "CORPUSMILL_LOG_JSON": "Yes", "OTHER": "x"})
    assert (found.store, found.batch_size, found.log_json, found.request_timeout) == ("/s", 7, True, 60.0)
    with pytest.raises(ValueError, match="CORPUSMILL_BATCH_SIZE must be of type int") as caught:
        settings.load({"CORPUSMILL_BATCH_SIZE": "secret"})
    assert "secret" not in str(caught.value)


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([(2, "a|b", None), (1, "x", 0.5)], "id int, name string, share double")
    text = sinks.report_markdown("Run", {"shares": (rows, ["id"])})
    assert text.splitlines()[2:] == ["## shares", "", "| id | name | share |", "| --- | --- | --- |", "| 1 | x | 0.5 |", "| 2 | a\\|b |  |"]
    assert json.loads(sinks.report_json("Run", {"shares": (rows, ["id"])})) == {"title": "Run", "shares": [{"id": 1, "name": "x", "share": 0.5}, {"id": 2, "name": "a|b", "share": None}]}
    with pytest.raises(ValueError, match="too many rows"):
        sinks.report_json("Run", {"all": (spark.range(sinks.REPORT_ROWS + 1), ["id"])})
    path = str(tmp_path / "lines")
    sinks.write_json_lines(rows, path, ["id"])
    assert [r["value"] for r in spark.read.text(path).collect()] == ['{"id":1,"name":"x","share":0.5}', '{"id":2,"name":"a|b","share":null}']


def test_a_snapshot_with_one_more_column(spark):
    assert [tuple(r) for r in sinks.evolve(spark.range(1), "n", "int", 3).collect()] == [(0, 3)]
    with pytest.raises(ValueError):
        sinks.evolve(spark.range(1), "id", "int")


def test_files_over_the_size_are_told(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    (tmp_path / "b.bin").write_bytes(b"x" * 50)
    files, problems = readers.read_files(spark, str(tmp_path), most_bytes=10)
    assert [(r["path"].rpartition("/")[2], r["digest"]) for r in files.collect()] == [("a.bin", hashlib.sha256(b"abc").hexdigest())]
    assert [(r["path"].rpartition("/")[2], r["length"], r["problem"]) for r in problems.collect()] == [("b.bin", 50, "too large")]


def test_object_requests_and_vector_stores(spark):
    urls = spark.createDataFrame([(" https://e.com/a.PNG?x=1",), ("http://e.com/b",), (None,), ("",), ("http://e.com/b",)], "u string")
    got = {r["url"]: (r["cache_name"], r["problem"]) for r in readers.object_requests(urls, "u").collect()}
    name = lambda u: hashlib.sha256(u.encode()).hexdigest()
    assert got == {"https://e.com/a.PNG?x=1": (name("https://e.com/a.PNG?x=1") + ".png", None), "http://e.com/b": (name("http://e.com/b"), "not https")}
    store = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [1.0, 2.0]), ("b", [1.0]), ("c", None)], "content_hash string, embedding array<float>")
    found = {tuple(r) for r in readers.vector_store_problems(store, {"model": "m", "dimensions": 2, "vectors": 6}, "other", 2).collect()}
    assert found == {("model", 1), ("truncated store", 2), ("vector length", 2), ("repeated key", 1)}


def test_blog_tables(spark):
    posts = spark.createDataFrame([tuple({"id": n, "url": u, "blog_meta_id": m}.get(f.name) for f in blog.POSTS.fields) for n, u, m in ((2, "b", None), (1, " A ", 9), (3, "  ", 8), (4, None, 9))], blog.POSTS)
    meta = spark.createDataFrame([(9, "T", "D", None, None, "en")], blog.META)
    assert [tuple(r) for r in blog.identities(posts, "https://e.com/blog/").collect()] == [(1, "https://e.com/blog/A"), (2, "https://e.com/blog/b")]
    rows = blog.rows_with_metadata(posts, meta)
    assert len(rows.columns) == 26 and [(r["id"], r["meta_title"]) for r in rows.collect()] == [(1, "T"), (2, None), (3, None), (4, "T")]
    assert len(blog.POSTS.names) == 21 and len(blog.META.names) == 6


@pytest.mark.parametrize("by", [None, ["g"]])
def test_percentiles_of_any_distribution(spark, by):
    values = [None, float("nan"), *[float(i % 97) for i in range(5000)], *[7.0] * 3000, 1e300, -1e300]
    df = spark.createDataFrame([(str(i % 3), v) for i, v in enumerate(values)] + [("one", 5.0), (None, 1.0), (None, 2.0)], "g string, v double")
    want = df.where("v is not null and not isnan(v)").groupBy(*(by or [])).agg(F.count("*").alias("n"), *[F.expr(f"percentile_disc({p}) within group (order by v)").alias(n) for n, p in (("p50", 0.5), ("p95", 0.95))])
    got = ranking.distribution(df, "v", by).where("g is not null") if by else ranking.distribution(df, "v", by)
    want = want.where("g is not null") if by else want
    assert sorted(map(tuple, got.select(*(by or []), "n", "p50", "p95").collect())) == sorted(map(tuple, want.collect()))


def test_reports_and_page_scopes_by_command(spark, base, tmp_path):
    assert commands.main(["evaluate", "--base", base, "--to", str(tmp_path / "report")], spark) == 0
    assert {"recall_by_category", "threshold_report", "strategy_report", "corpus_fingerprint"} < set(json.loads((tmp_path / "report.json").read_text()))
    assert (tmp_path / "report.md").read_text().startswith("# evaluate\n")
    rows = spark.createDataFrame([(1, "A", "a street", "1", "2")], "id bigint, name string, address string, latitude string, longitude string")
    rows.write.parquet(str(tmp_path / "site" / "subone_officelocation.parquet"))
    assert commands.main(["sync", "--base", str(tmp_path / "site"), "--store", str(tmp_path / "store"), "--scope", "office_locations"], spark) == 0
    stored = sinks.Snapshots(spark, str(tmp_path / "store")).read("documents").collect()
    assert [(r["canonical_uri"], r["source_scope"], r["status"]) for r in stored] == [("https://www.certhaven.example/contactus#office-locations", "office_locations", "active")]
    assert commands.main(["sync", "--base", str(tmp_path / "nowhere"), "--store", str(tmp_path / "other"), "--scope", "grc"], spark) == 1


def test_percentiles_of_a_null_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), ("a", 5.0)], "g string, v double")
    assert sorted(map(str, ranking.distribution(df, "v", ["g"]).select("g", "n", "p50", "p95").collect())) == ["Row(g='a', n=1, p50=5.0, p95=5.0)", "Row(g=None, n=2, p50=1.0, p95=2.0)"]


def test_pairs_with_typographic_quotes_keep_their_record(spark):
    faq = spark.createDataFrame([("d", "k", "https://e.com/p", "Title", [("What is a “gap”?", "A ‘gap’ is a \"hole\"."), ("Half?", None)])], "dictionary_name string, faq_key string, parent_canonical_uri string, parent_title string, pairs array<struct<question:string,answer:string>>")
    row = composition.pair_list_records(faq).first()
    assert [(b["question"], b["answer"][0]["text"]) for b in row["blocks"]] == [('What is a "gap"?', "A 'gap' is a \"hole\".")] and row["half_pairs"] == 1


def test_evidence_of_images_cites_the_confirmed_parent(spark):
    chunks = spark.createDataFrame([(f"https://e.com/{n}", "image_descriptions", 0, f"h{n}", [1.0, float(n)], s, "https://e.com/parent") for n, s in ((0, "confirmed"), (1, "unresolved"))], "canonical_uri string, source_scope string, chunk_index int, content_hash string, embedding array<double>, mapping_status string, parent_uri string")
    asked = spark.createDataFrame([(1, "q", [1.0, 0.0])], "query_id bigint, query_text string, query_embedding array<double>")
    found = vectors.search(chunks, asked, 2, ["image_descriptions"]).collect()
    assert {r["canonical_uri"]: r["citation_uri"] for r in found} == {"https://e.com/0": "https://e.com/parent", "https://e.com/1": None}


def test_more_queries_than_one_slice(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)], "vec_id bigint, embedding array<double>")
    asked = rows.where("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    want = sorted(map(tuple, vectors.nearest_chunks(rows, asked, 3, 4, ["vec_id"]).collect()))
    monkeypatch.setattr(vectors, "QUERY_BYTES", 5 * 3 * 8)
    assert sorted(map(tuple, vectors.nearest_chunks(rows, asked, 3, 4, ["vec_id"]).collect())) == want and len(want) == 48
