from __future__ import annotations

import json

import pytest
from pyspark.sql import types as T

from corpusmill.operators.synchronize import VERSIONS
from corpusmill.sources import readers, sinks
from corpusmill.streaming.micro_batches import synchronize_stream, windowed_counts

SCRIPT = """
/* c */ export const OTHER = {};
export const FAQ: Record<string, X[]> = {
  // first
  'audit': [{ question: "A \\u0041?", answer: 'it\\'s "so"' , }, ],
  plain_key: [],
};
"""


def test_dictionary(spark, tmp_path):
    assert readers.parse_dictionary(SCRIPT, "FAQ") == {"audit": [{"question": "A A?", "answer": 'it\'s "so"'}], "plain_key": []}
    for broken in (SCRIPT.replace("plain_key", "audit"), SCRIPT.replace("question", "ask"), SCRIPT.replace("\\u0041", "\\q"), SCRIPT.replace("};", "")):
        with pytest.raises(ValueError):
            readers.parse_dictionary(broken, "FAQ")
    with pytest.raises(ValueError):
        readers.parse_dictionary(SCRIPT, "NONE")
    (tmp_path / "faq.ts").write_text(SCRIPT)
    rows = readers.read_dictionaries(spark, str(tmp_path), ["FAQ", "OTHER"]).collect()
    assert sorted((r["dictionary"], r["key"], len(r["pairs"])) for r in rows) == [("FAQ", "audit", 1), ("FAQ", "plain_key", 0)]


def test_json(spark, tmp_path):
    schema = T.StructType.fromDDL("key string, n int")
    path = tmp_path / "d.json"
    path.write_text(json.dumps({"version": 1, "origin": "o", "documents": [{"key": "a", "n": 1}, {"key": "b", "n": 2}]}))
    rows = readers.read_json_dataset(spark, str(path), 1, "documents", schema, ["key"], ["origin"]).orderBy("position").collect()
    assert [(r["key"], r["n"], r["origin"]) for r in rows] == [("a", 1, "o"), ("b", 2, "o")]
    with pytest.raises(ValueError):
        readers.read_json_dataset(spark, str(path), 2, "documents", schema, ["key"])
    lines = tmp_path / "l.jsonl"
    lines.write_text('{"key":"a","n":1}\n\n[1]\n{"key":\n')
    good, bad = readers.read_json_lines(spark, str(lines), schema)
    assert [r["key"] for r in good.collect()] == ["a"]
    assert sorted(r["problem"] for r in bad.collect()) == ["not a JSON object", "not valid JSON"]


def test_snapshots_lock_and_vectors(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    store = sinks.Snapshots(spark, root)
    assert store.read("t") is None
    first = store.publish("t", spark.range(3))
    store.publish("t", store.read("t").where("id > 0"))
    assert store.read("t").count() == 2
    store.prune("t", first)
    with sinks.single_run(spark, root), pytest.raises(sinks.RunIsActive), sinks.single_run(spark, root):
        pass
    with sinks.single_run(spark, root):
        sinks.append_ledger(spark, root, {"run_id": "r", "run_mode": "sync", "run_status": "running", "counts": {"new": 1}})
    path = f"file://{tmp_path}/vectors"
    rows = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [1.0, 2.0])], "content_hash string, embedding array<float>")
    sinks.append_vectors(rows, path, 2)
    sinks.append_vectors(rows, path, 2)
    assert readers.read_vectors(spark, path, 2).count() == 1
    with pytest.raises(Exception):
        sinks.append_vectors(spark.createDataFrame([("b", [1.0])], rows.schema), path, 2)
    assert json.loads(sinks.render_json(spark.range(2), ["id"], {"version": 1}, "rows")) == {"version": 1, "rows": [{"id": 0}, {"id": 1}]}
    with pytest.raises(ValueError):
        sinks.refuse_secrets("has pw", ["pw"])


def test_streams(spark, tmp_path, base):
    schema = "canonical_uri string, ordinal int, content_hash string, " + ", ".join(f"{v} int" for v in VERSIONS)
    source = str(tmp_path / "in")
    empty = spark.createDataFrame([], "canonical_uri string, status string, content_hash string, gone_count int, consecutive_failure_count int, last_seen_at timestamp, last_run_id string, " + ", ".join(f"{v} int" for v in VERSIONS))
    store = sinks.Snapshots(spark, f"file://{tmp_path}/store")
    for rows in ([("a", 1, "x", 1, 1, 1, 1), ("b", 2, "x", 1, 1, 1, 1)], [("a", 1, "y", 1, 1, 1, 1)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        query = synchronize_stream(spark.readStream.schema(schema).parquet(source), store, "pages", str(tmp_path / "cp"), empty)
        query.awaitTermination(120)
    assert {(r["canonical_uri"], r["content_hash"], r["last_run_id"]) for r in store.read("pages").collect()} == {("a", "y", "1"), ("b", "x", "0")}
    events = spark.readStream.schema(spark.read.parquet(f"{base}/events.parquet").schema).parquet(f"{base}/events.parquet*")
    counts = windowed_counts(events, "ts", ["event_type"]).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    counts.awaitTermination(120)
    assert spark.table("counts").selectExpr("sum(n)").first()[0] == spark.read.parquet(f"{base}/events.parquet").count()
