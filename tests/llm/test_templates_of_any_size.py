"""Templates depend on the lines alone."""

from __future__ import annotations

import random

from corpusmill.llm import repeated_lines
from tests.llm.test_pairs_and_lines import BLOG

TOPICS = [f"{a}{b}" for a in "abcdef" for b in ("alpha", "beta", "gamma", "delta", "omega")]


def test_templates_do_not_depend_on_sizes_or_partitions(spark, monkeypatch):
    rows = [(i, f"s{i % 2}", f"filed under {TOPICS[i // 2 % 30]} by the desk on monday\nread more {'xyz'[i % 3]} of {'abc'[i // 3 % 3]} every day\nalone {chr(97 + i % 26)} {i}", None, None) for i in range(120)]
    df = spark.createDataFrame(rows, BLOG)

    def templates(blog):
        return sorted(tuple(r) for r in repeated_lines.repeated_templates(blog).collect())

    want = templates(df.coalesce(1))
    assert {("s0", "filed under <*> by the desk on monday", 60), ("s1", "filed under <*> by the desk on monday", 60)} <= set(want)
    assert templates(df.repartition(9)) == want
    monkeypatch.setattr(repeated_lines, "LEAF_LINES", 1)
    monkeypatch.setattr(repeated_lines, "TREE_TEMPLATES", 2)
    assert templates(df) == want
    monkeypatch.setattr(repeated_lines, "BROADCAST_ROWS", 0)
    assert templates(df) == want


def test_a_leaf_finds_what_comparing_all_templates_finds():
    rng = random.Random(3)
    lines = [["read", "more", *(rng.choice("abcdefgh"[: 2 + p]) for p in range(7))] for _ in range(400)]
    plain, leaf = [], repeated_lines.Leaf()
    for line in lines:
        repeated_lines.grow(plain, line)
        leaf.grow(line)
    assert leaf.templates == plain and len(plain) > 3
    assert repeated_lines.Leaf(plain).fixed == {place: own for place, own in leaf.fixed.items() if own}
    assert [leaf.matching(line) for line in lines] == [repeated_lines.matching(plain, line) for line in lines]
