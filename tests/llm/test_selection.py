from __future__ import annotations

import functools
import math
import random
from collections import defaultdict
from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import mixing, packing, queries, similar_vectors, tokens, top_per_group
from corpusmill.sources.tables import read_table
from tests import oracle


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, base, name):
    assert oracle.difference(spark, oracle.connect(base), queries.QUERIES[name], queries.SQL[name], base) == ""


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_every_query_runs(spark, base, name):
    assert queries.QUERIES[name](spark, base).count() > 0


HITS = "hit_id bigint, case_id bigint, document_uri string, content_hash string, lane string, top_score double, recorded_at timestamp, rank int, `__band` int"


def best_three(rows):
    last = {}
    for r in rows:
        if r[2] is not None:
            key = (r[2], r[1], r[3])
            if key not in last or (r[6] or datetime.min, r[0]) > (last[key][6] or datetime.min, last[key][0]):
                last[key] = r
    groups = defaultdict(list)
    for r in last.values():
        if r[5] is not None and not math.isnan(r[5]) and -1 <= r[5] <= 1:
            groups[r[2]].append(r)
    first = lambda x: (x is not None, x if x is not None else 0)
    return sorted(r[0] for own in groups.values() for r in sorted(own, key=lambda r: (-r[5], r[3] is not None, r[3] or "", *first(r[1])))[:3])


def test_top_hits(spark):
    rng, t0 = random.Random(3), datetime(2024, 1, 1)
    scores = [None, float("nan"), float("inf"), 2.0, -1.0, 1.0, *[round(rng.uniform(-1, 1), 1) for _ in range(30)]]
    rows = [
        (i, rng.choice([None, 1, 2, 3]), "hot" if i % 3 == 0 else rng.choice([None, *[f"u{k}" for k in range(40)]]), rng.choice("abcdef") if i % 17 else None, "l", rng.choice(scores), t0 + timedelta(minutes=rng.randrange(50)), 1, 1)
        for i in range(1500)
    ]
    df = spark.createDataFrame(rows, HITS).repartition(6)
    assert sorted(r["hit_id"] for r in top_per_group.top_hits(df).collect()) == best_three(rows)
    assert top_per_group.top_hits(df.where("false")).count() == 0
    few = top_per_group.top_n_per_group(df.where("hit_id is not null").dropDuplicates(["hit_id"]), "document_uri", "top_score", ["hit_id"], ["hit_id"], 1, shares=())
    assert few.groupBy("document_uri").count().where("count > 1").count() == 0


pairs_of = functools.partial(similar_vectors.similar_pairs, model="certhaven-embed-64", dim=64)


def exact_pairs(ids, x, k=5, least=0.85):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = set()
    for i in range(len(x)):
        s = np.round(x @ x[i], 12)
        near = sorted((-s[j], ids[j]) for j in range(len(x)) if j != i and s[j] >= least)[:k]
        out |= {(min(ids[i], b), max(ids[i], b)) for _, b in near}
    return out


CHUNKS = "chunk_id bigint, content_hash string, embedding array<float>, embedding_model string, bucket int, home string"


def test_similar_vectors(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((300, 64))
    x = (centres[rng.integers(0, 300, 6000)] + 0.25 * rng.standard_normal((6000, 64))).astype(np.float32)
    rows = [(i * 3, f"h{i}", list(map(float, v)), "certhaven-embed-64", 0, "x") for i, v in enumerate(x)]
    bad = [None, [], [1.0], [0.0] * 64, [float("nan")] * 64, [float("inf")] + [1.0] * 63, [None] + [1.0] * 63]
    rows += [(100_000 + i, f"b{i}", v, "certhaven-embed-64", 0, "x") for i, v in enumerate(bad)]
    rows += [(200_000, "other", rows[0][2], "trial", 0, "x"), (200_001, "h5", rows[0][2], "certhaven-embed-64", 0, "x"), (200_002, None, rows[0][2], "certhaven-embed-64", 0, "x"), (200_003, "m", rows[0][2], None, 0, "x")]
    df = spark.createDataFrame(rows, CHUNKS).repartition(5)
    got = {tuple(r) for r in pairs_of(df).collect()}
    want = exact_pairs([i * 3 for i in range(6000)], x.astype(np.float64))
    assert len(got & want) / len(want) >= 0.97 and len(got & want) / len(got) >= 0.97
    assert all(a < b for a, b in got)


def test_similar_vectors_on_the_tables(spark, base):
    chunks = read_table(spark, base, "evaluate_embeddings")
    reps = similar_vectors.usable_vectors(chunks, "certhaven-embed-64", 64).toPandas()
    want = exact_pairs(reps["chunk_id"].tolist(), np.stack(reps["embedding"]).astype(np.float64))
    assert {tuple(r) for r in pairs_of(chunks).collect()} == want


def test_one_vector_under_many_texts(spark):
    rng = np.random.default_rng(6)
    hot = list(map(float, rng.standard_normal(64)))
    rows = [(i, f"h{i}", hot if i % 3 == 0 else list(map(float, rng.standard_normal(64))), "certhaven-embed-64", 0, "x") for i in range(300)]
    got = {tuple(r) for r in pairs_of(spark.createDataFrame(rows, CHUNKS)).collect()}
    assert got == exact_pairs([r[0] for r in rows], np.array([r[2] for r in rows]).astype(np.float32).astype(np.float64))
    for n in (0, 1):
        assert pairs_of(spark.createDataFrame(rows[:n], CHUNKS)).count() == 0


def chunks_of(spark, x):
    rows = [(i, f"h{i}", list(map(float, v)), "certhaven-embed-64", 0, "x") for i, v in enumerate(x.astype(np.float32))]
    return spark.createDataFrame(rows, CHUNKS).repartition(5)


def test_divided_buckets(spark, monkeypatch):
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((200, 64))
    x = (centres[rng.integers(0, 200, 4000)] + 0.25 * rng.standard_normal((4000, 64))).astype(np.float32)
    monkeypatch.setattr(similar_vectors, "TASK_ROWS", 300)
    df, want = chunks_of(spark, x), exact_pairs(list(range(4000)), x.astype(np.float64))
    got = {tuple(r) for r in pairs_of(df, sample_rows=500, block_rows=150, own_rows=50).collect()}
    assert len(got & want) / len(want) >= 0.95 and len(got & want) / len(got) >= 0.95


def test_bucket_that_cannot_be_divided(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.standard_normal(64) + 0.02 * rng.standard_normal((700, 64))
    monkeypatch.setattr(similar_vectors, "TASK_ROWS", 250)
    monkeypatch.setattr(similar_vectors, "LEVELS", 0)
    got = {tuple(r) for r in pairs_of(chunks_of(spark, x), sample_rows=60, block_rows=100).collect()}
    want = exact_pairs(list(range(700)), x.astype(np.float32).astype(np.float64))
    assert len(got & want) / len(want) >= 0.98 and len(got & want) / len(got) >= 0.98


def test_copies_of_a_row_do_not_grow_with_the_rows():
    """All levels of lists over 1, 10 and 100 times the rows, on one bounded sample; 1 row a list to 100."""
    sv, rng, copies, largest = similar_vectors, np.random.default_rng(9), [], []
    for rows in (3_000, 30_000, 300_000):
        x = rng.standard_normal((rows, 16)).astype(np.float32)
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        lists = sv.fit_lists(unit[:3_000], rows, 1)
        row, bucket, home = sv.assign(lists, x, sv.PROBES)
        todo, sent, most = [(row[bucket == b], home[bucket == b]) for b in np.unique(bucket)], 0, 0
        while todo:
            own_rows, live = todo.pop()
            if live.sum() <= 512:
                sent, most = sent + len(own_rows), max(most, int(live.sum()))
                continue
            cells = sv.own_lists(x[own_rows[live]][: sv.OWN_SAMPLE], int(live.sum()), 1, 128)
            r, own, h = sv.own_assign(cells, x[own_rows], live)
            todo += [(own_rows[r[own == c]], h[own == c]) for c in np.unique(own)]
        copies.append(sent / rows)
        largest.append(most)
    assert max(largest) <= 512
    assert copies[2] < 2.6 * copies[1] and copies[2] < 20, copies


def test_scan_against_all(spark):
    rng = np.random.default_rng(7)
    x = (rng.standard_normal(64) + 0.3 * rng.standard_normal((900, 64))).astype(np.float64)
    ids = np.arange(900)
    turned = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ similar_vectors.rotation(64, 1)
    a, b, c = similar_vectors.scan(turned, turned, 0.85, 5, ids, ids)
    got = {(min(i, j), max(i, j)) for i, j in zip(ids[a], ids[b], strict=True)}
    want = exact_pairs(list(range(900)), x)
    assert len(got & want) / len(want) > 0.98 and (c >= 0.85).all()


DOCS = "doc_id bigint, text string, lang string, source string, content_type string, canonical_uri string, n_tokens string, container_id string, copies int"


def doc(i, text, source="s", lang="en", kind="page"):
    return (i, text, lang, source, kind, f"u{i}", "x", "x", 0)


def test_containers(spark):
    rng = random.Random(1)
    rows = [doc(i, "word " * rng.randrange(1, 900)) for i in range(700)]
    rows += [doc(1000, None), doc(1001, ""), doc(1002, "big " * 5000), doc(None, "nameless one"), doc(5, "twice"), doc(5, "twice"), doc(1003, " " * 30)]
    df = spark.createDataFrame(rows, DOCS)
    packed = packing.fill_containers(df, 2048, group_items=100).toPandas()
    sizes = {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(df.drop("n_tokens"), ["doc_id"]).collect() if r["doc_id"] != 5}
    fill = packed.groupby("container_id")["n_tokens"].sum()
    assert fill.max() <= 2048 and packed["n_tokens"].sum() == sum(r["n_tokens"] for r in tokens.count_tokens(df.drop("n_tokens"), ["doc_id"]).collect())
    assert len(fill) <= math.ceil(packed["n_tokens"].sum() / 2048) + 2
    whole = packed[packed["doc_id"].map(lambda d: sizes.get(d, 0) <= 2048)]
    assert (whole["part_no"] == 1).all()
    big = packed[packed["doc_id"] == 1002].sort_values("part_no")
    assert big["n_tokens"].tolist()[:-1] == [2048] * (len(big) - 1) and big["token_start"].tolist() == [2048 * i for i in range(len(big))]
    assert packing.fill_containers(df.where("false")).count() == 0


@pytest.mark.parametrize("seed", range(12))
def test_local_search_keeps_items_and_never_needs_more_bins(seed):
    rng = random.Random(seed)
    sizes = [rng.choice((rng.randrange(1, 101), rng.randrange(30, 60))) for _ in range(rng.randrange(0, 120))]
    bins = packing.pack(sizes, 100)
    fill = defaultdict(int)
    for b, s in zip(bins, sizes, strict=True):
        fill[b] += s
    plain = packing.Bins(100)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        plain.place(i, sizes[i])
    assert all(f <= 100 for f in fill.values()) and math.ceil(sum(sizes) / 100) <= len(fill) <= len(plain.items)
    assert len(fill) == 0 or set(bins) == set(range(len(fill)))


def test_local_search_beats_best_fit():
    assert len(set(packing.pack([44, 34, 28, 23, 20, 18, 17, 16], 100))) == 2


TARGETS = "source string, target_share double, max_repeats int"


def test_mixture(spark):
    rows = [doc(i, "token " * 50, "large") for i in range(300)] + [doc(1000 + i, "token " * 50, "small") for i in range(10)] + [doc(2000 + i, "Wort " * 30, "german", "de") for i in range(100)]
    rows += [doc(3000, "other", "untargeted"), doc(3001, None, "large"), doc(3002, "x", None), doc(4000, "y " * 9, "kinless", None, None)]
    df = spark.createDataFrame(rows, DOCS)
    targets = spark.createDataFrame([("large", 0.5, 1), ("small", 0.2, 3), ("german", 0.2, 2), ("absent", 0.05, 2), ("kinless", 0.05, None), (None, 0.1, 1)], TARGETS)
    mixed = mixing.mix_sources(df, targets).toPandas()
    caps = {"large": 1, "small": 3, "german": 2}
    assert set(mixed["source"]) == set(caps) and all((own["copies"] <= caps[s]).all() for s, own in mixed.groupby("source"))
    shares = {r["source"]: r for r in mixing.mix_shares(df, targets).collect()}
    assert shares["absent"]["tokens"] == shares["kinless"]["tokens"] == 0
    assert shares["small"]["tokens"] == 3 * shares["small"]["available"]
    for s in ("large", "german"):
        assert abs(shares[s]["tokens"] - shares[s]["budget"]) <= 60
    again = mixing.mix_sources(df.repartition(3), targets).toPandas()
    assert sorted(map(tuple, mixed[["doc_id", "copies"]].values)) == sorted(map(tuple, again[["doc_id", "copies"]].values))
    assert mixing.mix_sources(df.where("false"), targets).count() == mixing.mix_sources(df, targets.where("false")).count() == 0


def test_shortage_goes_to_siblings_first():
    root = mixing.Node("all")
    for path, weight, cap in ((("page", "en", "a"), 0.3, 10), (("page", "en", "b"), 0.3, 1000), (("page", "de", "c"), 0.2, 1000), (("mail", "en", "d"), 0.2, 1000)):
        root.add(path, weight, cap)
    mixing.share_out(root, 100)
    assert {leaf.name: round(leaf.budget) for leaf in root.leaves()} == {"a": 10, "b": 50, "c": 20, "d": 20}
    mixing.share_out(root, 10_000)
    assert sum(leaf.budget for leaf in root.leaves()) == 3010


def test_prefix_of_a_hot_source(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), (F.col("id") % 7).cast("string")).alias("text"), F.lit("en").alias("lang"), F.lit("hot").alias("source"), F.lit("page").alias("content_type"))
    df = df.unionByName(df.limit(50).withColumns({"doc_id": F.col("doc_id") + 100_000, "source": F.lit("cold")}))
    targets = spark.createDataFrame([("hot", 0.6, 1), ("cold", 0.4, 1)], TARGETS)
    shares = {r["source"]: r for r in mixing.mix_shares(df, targets).collect()}
    assert shares["cold"]["tokens"] == shares["cold"]["available"] and abs(shares["hot"]["tokens"] - shares["hot"]["budget"]) <= 3


def test_readme_names_the_bounds_of_the_code():
    text = " ".join((Path(__file__).resolve().parents[2] / "README.md").read_text().split())
    assert f"at most {similar_vectors.SAMPLE_ROWS:,} rows (`SAMPLE_ROWS`)" in text
    assert f"at most {similar_vectors.SAMPLE_ROWS // similar_vectors.SAMPLE_PER_LIST:,} lists" in text
