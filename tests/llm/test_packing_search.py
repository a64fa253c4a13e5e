"""The search for fewer bins goes on until no step helps."""

from __future__ import annotations

import random
from collections import defaultdict

from pyspark.sql import functions as F

from corpusmill.llm import packing


def bins_of(sizes, capacity):
    own = defaultdict(list)
    for item, b in enumerate(packing.pack(sizes, capacity)):
        own[b].append(sizes[item])
    assert all(sum(items) <= capacity for items in own.values()) and sum(map(len, own.values())) == len(sizes)
    return list(own.values())


def helps(bins, capacity):
    """A move or exchange that would still raise the sum of squared fills."""
    for g, giver in enumerate(bins):
        offers = {x for x in giver} | {x + y for n, x in enumerate(giver) for y in giver[n + 1 :]}
        for t, taker in enumerate(bins):
            if t != g and sum(taker) < capacity and sum(giver) < capacity:
                gains = set(giver) | {o - b for o in offers for b in set(taker)}
                if any(0 < x <= capacity - sum(taker) and sum(taker) + x > sum(giver) for x in gains):
                    return True
    return False


def test_search_ends_where_nothing_helps():
    for seed, low, high, capacity in ((1, 60, 280, 400), (2, 20, 120, 401), (3, 5, 40, 400)):
        rng = random.Random(seed)
        sizes = [rng.randrange(low, high) for _ in range(250)]
        bins = bins_of(sizes, capacity)
        assert len(bins) == -(-sum(sizes) // capacity) or not helps(bins, capacity)


def test_fewer_bins_than_a_bounded_search():
    rng = random.Random(3)
    assert len(bins_of([rng.randrange(300, 1400) for _ in range(3000)], 2048)) < 1267


def test_turns_lose_nothing(spark):
    texts = spark.range(600).select(F.col("id").alias("doc_id"), F.expr("repeat('audit plan ', 20 + int(pmod(hash(id), 500)))").alias("text"))
    packed = packing.fill_containers(texts, 512, group_items=40)
    fills = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("n"))
    assert fills.where("n > 512").count() == 0 and packed.select("doc_id").distinct().count() == 600
    assert packed.count() == packed.select("doc_id", "part_no").distinct().count()
