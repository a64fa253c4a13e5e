"""Ranking quality: first hits, recall and reciprocal rank, percentiles, overlaps and comparisons of runs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Ranges of a group's values whose counts locate a percentile.
PERCENTILE_RANGES = 4096


def first_hits(rows: DataFrame, case: str, score: str, tie: str, wanted: dict[str, Column]) -> DataFrame:
    """(case, a rank per name of ``wanted``): where the best row of each condition stands among all of the case; null for a miss.

    Rows are ordered by score descending, then by a numeric tie ascending. Nothing is ranked: the best
    row of each condition is a grouped maximum, and its rank is one more than the rows ahead of it, a
    count with map-side sums, so a case may have any number of rows.
    """
    place = F.struct(F.col(score).alias("s"), (-F.col(tie)).alias("t"))
    best = rows.groupBy(case).agg(*[F.max(F.when(hit, place)).alias(f"__{name}") for name, hit in wanted.items()])
    ahead = [F.when(F.first(f"__{n}").isNotNull(), F.count_if(place > F.col(f"__{n}")) + 1).cast("int").alias(n) for n in wanted]
    return rows.select(case, score, tie).join(best, case).groupBy(case).agg(*ahead)


def rank_metrics(rank: Column, cut_offs: list[int]) -> list[Column]:
    """Cases, recall at each cut-off and mean reciprocal rank; no case gives zeros."""
    n = F.greatest(F.count("*"), F.lit(1))
    recalls = [F.round(F.count_if(F.coalesce(rank <= k, F.lit(False))) / n, 6).alias(f"recall_{k}") for k in cut_offs]
    inverse = F.coalesce(F.sum(1.0 / rank), F.lit(0.0)) / n
    return [F.count("*").alias("cases"), *recalls, F.round(inverse, 6).alias("mrr")]


def metrics_by_category(hits: DataFrame, category: str, rank: str, cut_offs: list[int]) -> DataFrame:
    """Metrics over all cases (category null, ``is_total`` 1) and per category, in one pass of grouping sets."""
    return (
        hits.groupingSets([[], [category]], category)
        .agg(F.grouping(category).cast("int").alias("is_total"), *rank_metrics(F.col(rank), cut_offs))
    )


def document_positions(returned: DataFrame, case: str, document: str) -> DataFrame:
    """(case, document, position): documents by first appearance in the returned list."""
    first = returned.groupBy(case, document).agg(F.min("rank").alias("first_rank"))
    return first.select(case, document, F.row_number().over(Window.partitionBy(case).orderBy("first_rank", document)).alias("position"))


def distribution(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Count, nearest-rank percentiles, greatest value and mean; nulls and NaN are left out.

    Percentiles come from counts per value, summed in two steps: over ranges of values, then over the
    values of the one range that holds the percentile. So a group of any number of distinct values
    needs no buffer of its own, and no task sorts a whole group.
    """
    by, keys = list(by or []), ["__key"]
    # a struct is equal to itself also where a column in it is null
    key = (F.struct(*by) if by else F.lit(1)).alias("__key")
    kept = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).withColumn("__v", F.col(value).cast("double"))
    ends = kept.groupBy(*by).agg(F.count("*").alias("n"), F.min("__v").alias("__low"), F.max("__v").alias("__high"), F.max(value).alias("greatest"), F.round(F.avg(value), 6).alias("mean"))
    ends = ends.select("*", key)
    counts = kept.groupBy(*by, "__v", value).agg(F.count("*").alias("__c")).select("__v", value, "__c", key).join(ends.select(*keys, "n", "__low", "__high"), keys)
    width = F.col("__high") - F.col("__low")
    counts = counts.withColumn("__range", F.when(width > 0, F.floor((F.col("__v") - F.col("__low")) / width * (PERCENTILE_RANGES - 1))).otherwise(0))
    ranges = counts.groupBy(*keys, "__range", "n").agg(F.sum("__c").alias("__c"))
    order = Window.partitionBy(*keys).orderBy("__range")
    ranges = ranges.withColumn("__upto", F.sum("__c").over(order)).withColumn("__before", F.col("__upto") - F.col("__c"))
    out = ends.drop("__low", "__high")
    for p in (0.5, 0.95):
        name, place = f"p{int(p * 100)}", F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(p) - F.lit(1e-9)))
        holding = ranges.where((F.col("__before") < place) & (F.col("__upto") >= place)).select(*keys, "__range", "__before")
        within = Window.partitionBy(*keys).orderBy("__v")
        inside = counts.join(holding, [*keys, "__range"]).withColumn("__at", F.col("__before") + F.sum("__c").over(within))
        out = out.join(inside.where(F.col("__at") >= place).groupBy(*keys).agg(F.min(value).alias(name)), keys, "left")
    return out.select(*by, "n", "p50", "p95", "greatest", "mean")


def threshold_report(top: DataFrame, score: str, correct: str, answerable: str) -> DataFrame:
    """Weakest correct top score, strongest score without an answer, and top hits at or above the first."""
    ends = top.agg(
        F.min(F.when(F.col(answerable) & F.col(correct), F.col(score))).alias("weakest_correct"),
        F.max(F.when(~F.col(answerable), F.col(score))).alias("strongest_unanswerable"),
    )
    strong = top.join(F.broadcast(ends)).agg(F.count_if(F.col(score) >= F.col("weakest_correct")).alias("strong_candidates"))
    return ends.join(F.broadcast(strong))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all members of two arrays; two empty ones agree wholly."""
    every = F.size(F.array_union(a, b))
    return F.when(every == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / every)


def run_changes(before: DataFrame, after: DataFrame, case: str, rank: str = "rank") -> DataFrame:
    """Cases whose first rank differs between two runs: ``lost``, ``found``, ``worse`` or ``better``."""
    both = before.select(case, F.col(rank).alias("before")).join(after.select(case, F.col(rank).alias("after")), case, "full_outer")
    kind = (
        F.when(F.col("before").isNotNull() & F.col("after").isNull(), "lost")
        .when(F.col("before").isNull() & F.col("after").isNotNull(), "found")
        .when(F.col("after") > F.col("before"), "worse")
        .when(F.col("after") < F.col("before"), "better")
    )
    return both.withColumn("change", kind).where("change is not null")


def corpus_fingerprint(rows: DataFrame, hash_column: str) -> DataFrame:
    """(fingerprint, hashes): SHA-256 of all hashes, copies included, one behind the other in ascending order.

    Nulls are left out; no hash gives the digest of nothing. The digest is one stream by its
    definition: hashes are counted and range-sorted in parallel, then one task reads the runs in
    order, a run at a time, and keeps nothing but the state of the digest.
    """
    counted = rows.where(F.col(hash_column).isNotNull()).groupBy(F.col(hash_column).cast("string").alias("h")).agg(F.count("*").alias("n"))

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"first": batch["h"].iloc[:1].to_numpy(), "h": [batch["h"].to_numpy()], "n": [batch["n"].to_numpy()]})

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, count = hashlib.sha256(), 0
        for batch in batches:
            for hashes, numbers in zip(batch["h"], batch["n"], strict=True):
                for h, n in zip(hashes, numbers, strict=True):
                    count += int(n)
                    piece = h.encode()
                    for at in range(0, int(n), 4096):
                        state.update(piece * min(4096, int(n) - at))
        yield pd.DataFrame({"fingerprint": [state.hexdigest()], "hashes": [count]})

    ordered = counted.repartitionByRange("h").sortWithinPartitions("h").mapInPandas(runs, "first string, h array<string>, n array<bigint>")
    one = ordered.repartition(1).sortWithinPartitions("first")
    whole = one.mapInPandas(stream, "fingerprint string, hashes bigint")
    return whole.agg(F.coalesce(F.first("fingerprint"), F.lit(hashlib.sha256().hexdigest())).alias("fingerprint"), F.coalesce(F.first("hashes"), F.lit(0)).alias("hashes"))


def setup_problems(cases: DataFrame, documents: DataFrame) -> DataFrame:
    """(rule, case_id) of golden cases that cannot be evaluated: empty or repeated query, answerable without a
    document, unanswerable with one, or expecting a document that is missing."""
    empty = cases.where("trim(coalesce(query_text, '')) = ''").select(F.lit("empty_query").alias("rule"), "case_id")
    key = F.lower(F.trim("query_text"))
    repeated = cases.withColumn("n", F.count("*").over(Window.partitionBy(key, "category"))).where("n > 1").select(F.lit("repeated_query").alias("rule"), "case_id")
    without = cases.where("answerable and expected_document_uri is null").select(F.lit("no_document").alias("rule"), "case_id")
    needless = cases.where("not answerable and expected_document_uri is not null").select(F.lit("needless_document").alias("rule"), "case_id")
    known = documents.select(F.col("canonical_uri").alias("expected_document_uri"))
    missing = cases.where("expected_document_uri is not null").join(known, "expected_document_uri", "left_anti").select(F.lit("missing_document").alias("rule"), "case_id")
    return empty.unionByName(repeated).unionByName(without).unionByName(needless).unionByName(missing)


def setup_report(cases: DataFrame, expected: DataFrame, chunks: DataFrame, model: str, dim: int, profiles: dict[str, int], expected_chunks: int) -> DataFrame:
    """(rule, subject): every reason why an evaluation must not start; none means go.

    ``cases``: (case_id, answerable, expected_document_uri); ``expected``: (case_id, content_hash) of
    expected chunks; ``chunks``: (canonical_uri, content, content_hash, embedded) of the active
    corpus. Rules on the corpus name how many chunks they hold for, those on cases the case and what
    it expects. ``profiles`` are the supported models with their dimensions.
    """
    spark = cases.sparkSession
    fixed = []
    if model not in profiles:
        fixed.append(("unsupported_model", model))
    elif profiles[model] != dim:
        fixed.append(("dimension", f"{dim}, expected {profiles[model]}"))
    rules = spark.createDataFrame(fixed, "rule string, subject string")
    blank = F.trim(F.regexp_replace("content", r"\s+", " ")) == ""
    corpus = chunks.agg(
        F.count("*").alias("n"), F.count_if(F.coalesce(blank, F.lit(True))).alias("empty_chunks"),
        F.count_if(~F.sha2("content", 256).eqNullSafe(F.col("content_hash"))).alias("hash_mismatch"), F.count_if("embedded").alias("already_embedded"),
    ).withColumn("chunk_count", F.when(F.col("n") != expected_chunks, F.col("n")).otherwise(0))
    counted = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("k")) for r in ("chunk_count", "empty_chunks", "hash_mismatch", "already_embedded")])
    of_corpus = corpus.select(F.explode(counted).alias("c")).where("c.k > 0").select("c.rule", F.col("c.k").cast("string").alias("subject"))
    none = cases.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("no_cases").alias("rule"), F.lit("").alias("subject"))
    name = lambda what: F.concat(F.col("case_id").cast("string"), F.lit(": "), what)
    uris = chunks.select(F.col("canonical_uri").alias("expected_document_uri")).distinct()
    wanted = cases.where("expected_document_uri is not null")
    parts = [
        wanted.join(uris, "expected_document_uri", "left_anti").select(F.lit("document_not_active").alias("rule"), name(F.col("expected_document_uri")).alias("subject")),
        expected.join(chunks.select("content_hash").distinct(), "content_hash", "left_anti").select(F.lit("hash_not_in_corpus").alias("rule"), name(F.col("content_hash")).alias("subject")),
        cases.where("answerable and expected_document_uri is null").select(F.lit("answerable_without_document").alias("rule"), F.col("case_id").cast("string").alias("subject")),
        cases.where("not answerable").join(expected.select("case_id").distinct().withColumn("__e", F.lit(True)), "case_id", "left")
        .where("expected_document_uri is not null or __e").select(F.lit("unanswerable_with_evidence").alias("rule"), F.col("case_id").cast("string").alias("subject")),
    ]
    owned = chunks.select(F.col("canonical_uri").alias("expected_document_uri"), "content_hash").distinct()
    asked = expected.join(cases.select("case_id", "expected_document_uri"), "case_id")
    parts.append(asked.join(owned, ["expected_document_uri", "content_hash"], "left_anti").select(F.lit("hash_not_in_document").alias("rule"), name(F.col("content_hash")).alias("subject")))
    for part in (of_corpus, none, *parts):
        rules = rules.unionByName(part)
    return rules
