"""File names matched as the nested loop over all pairs would match them."""

from __future__ import annotations

import re
import urllib.parse

from pyspark.sql import functions as F

from corpusmill.operators import matching
from corpusmill.plans import hierarchies
from corpusmill.sources.tables import read_table

LEFT = ["x/photo.png", "a/Annual_Report-2024.pdf", "roadmap.svg", "team_roadmap.png", "a-very-long-file-name.png", "100%.png", "a+b.png", "plain name.jpg", "", None, "my-roadmap.png", "report.final.pdf"]
RIGHT = [
    "y/photo_a1b2c3d.png", "photo.png", "photo.jpg", "Photo.png", "annual report 2024.pdf", "annual%5Freport%2D2024.pdf", "team.png", "team_roadmap_Ab12Cd3.png", "a_very_long_file_name_of_a_page.png",
    "a_very_long_file_nam.png", "a_very_long_file_na.png", "100%25.png", "a+b.png", "a%2Bb.png", "plain%20name_1234567.gif", "", None, "my.png", "report.png",
]


def kind(a, b):
    if not a or not b:
        return None
    name = [urllib.parse.unquote(x.rsplit("/", 1)[-1]) for x in (a, b)]
    stem = [re.sub(r"\.[A-Za-z0-9]+$", "", x) for x in name]
    forms = [{f for s in (x, re.sub(r"_[A-Za-z0-9]{7}$", "", x)) if (f := re.sub(r"[-_\s]+", "_", s).strip("_").casefold())} for x in stem]
    if name[0] == name[1]:
        return "exact"
    if stem[0] == stem[1]:
        return "stem"
    if forms[0] & forms[1]:
        return "folded"
    cut = any(min(len(x), len(y)) >= 20 and (x.startswith(y) or y.startswith(x)) for x in forms[0] for y in forms[1])
    return "truncated" if cut else None


def test_file_names(spark):
    left, right = (spark.createDataFrame([(n,) for n in names], "n string").withColumnRenamed("n", c) for names, c in ((LEFT, "a"), (RIGHT, "b")))
    got = {(r["a"], r["b"]): r["tier"] for r in matching.file_matches(left, right, "a", "b", "a", "b").collect()}
    assert got == {(a, b): k for a in LEFT for b in RIGHT if (k := kind(a, b))}
    assert got["x/photo.png", "y/photo_a1b2c3d.png"] == "folded" and got["a-very-long-file-name.png", "a_very_long_file_nam.png"] == "truncated"


def counts(a, others):
    """Links of one file by each tier's own condition."""
    name = lambda x: urllib.parse.unquote(x.rsplit("/", 1)[-1])
    stem = lambda x: re.sub(r"\.[A-Za-z0-9]+$", "", name(x))
    forms = lambda x: {f for s in (stem(x), re.sub(r"_[A-Za-z0-9]{7}$", "", stem(x))) if (f := re.sub(r"[-_\s]+", "_", s).strip("_").casefold())}
    cut = sum(x != y and min(len(x), len(y)) >= 20 and (x.startswith(y) or y.startswith(x)) for b in others for x in forms(a) for y in forms(b))
    same_stem = sum(bool(stem(a)) and stem(a) == stem(b) for b in others)
    return sum(name(a) == name(b) for b in others), same_stem, sum(bool(forms(a) & forms(b)) for b in others), cut


def test_links_are_counted_without_pairs(spark):
    left, right = (spark.createDataFrame([(n,) for n in names], "n string").withColumnRenamed("n", c) for names, c in ((LEFT + LEFT[:3], "a"), (RIGHT * 2, "b")))
    got = {r["a"]: (r["exact"], r["stem"], r["folded"], r["truncated"]) for r in matching.file_links(left, right, "a", "b", "a", "b").collect()}
    others = [b for b in RIGHT if b]
    assert got == {a: counts(a, others) for a in LEFT if a}


def test_a_name_that_a_third_of_all_files_share(spark):
    left = spark.range(30_000).select(F.concat(F.lit("s"), "id", F.when(F.col("id") % 3 == 0, "/logo.png").otherwise(F.concat(F.lit("/n"), "id", F.lit(".png")))).alias("a"))
    found = matching.file_links(left, left.withColumnRenamed("a", "b"), "a", "b", "a", "b")
    assert {tuple(r) for r in found.groupBy("exact").count().collect()} == {(10_000, 10_000), (1, 20_000)}
    links = matching.name_links(left, left.withColumnRenamed("a", "b"), "a", "b", "a", "b")
    assert {tuple(r) for r in links.groupBy("pages").count().collect()} == {(10_000, 10_000), (1, 20_000)}


def test_every_later_run_is_matched(spark, base):
    records = read_table(spark, base, "contract", ["run_id", "source_scope", "canonical_uri"])
    firsts = read_table(spark, base, "runs", ["run_id", "source_scope"]).groupBy("source_scope").agg(F.min("run_id").alias("first_run"))
    records = records.join(firsts, "source_scope").collect()
    first, later = {r["canonical_uri"] for r in records if r["run_id"] == r["first_run"]}, {r["canonical_uri"] for r in records if r["run_id"] > r["first_run"]}
    got = {r["first_uri"]: (r["exact"], r["stem"], r["folded"], r["truncated"]) for r in hierarchies.tiered_file_match(spark, base).collect()}
    assert got == {a: counts(a, later) for a in first}
    status = {r["first_uri"]: r["pages"] for r in hierarchies.file_match_status(spark, base).collect()}
    assert status == {a: max(counts(a, later)[:3]) for a in first}
