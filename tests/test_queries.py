"""Every core query against its SQL, and those without SQL for a stable schema."""

from __future__ import annotations

import hashlib
from collections import Counter

import pytest

from corpusmill.functions import markup
from corpusmill.plans import registry
from corpusmill.sources.tables import read_table
from tests import oracle


@pytest.fixture(scope="module")
def duck(base):
    return oracle.connect(base)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows_as_sql(spark, duck, base, name):
    assert oracle.difference(spark, duck, registry.QUERIES[name], registry.SQL[name], base) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs_without_sql(spark, base, name):
    df = registry.QUERIES[name](spark, base)
    assert len(set(df.columns)) == len(df.columns)
    again = registry.QUERIES[name](spark, base)
    once, twice = (oracle.rows_of(x.columns, [tuple(map(str, r)) for r in x.collect()]) for x in (df, again))
    # no good run of these tables delivers nothing, and there is no image scope
    assert once == twice and (sum(once.values()) > 0 or name in ("empty_inventory_guard_by_run", "image_records"))


@pytest.fixture(scope="module")
def posts(spark, base):
    """Every post's blocks and counters in plain Python."""
    rows = read_table(spark, base, "blog").select("post_id", "html").collect()
    return {r["post_id"]: markup.convert(r["html"], "https://www.certhaven.example/blog/") for r in rows if r["html"] is not None}


def rendered(block):
    cells = [block["header"], *block["rows"]] if block.get("header") else block.get("rows") or []
    return {"list": "\n".join(block.get("items") or []), "table": "\n".join(" | ".join(r) for r in cells), "image": block.get("alt")}.get(block["type"], block.get("text")) or ""


def test_html_blocks_row_by_row(spark, base, posts):
    got = {(r["post_id"], r["block_no"]): (r["block_type"], r["digest"]) for r in registry.QUERIES["html_blocks"](spark, base).collect()}
    want = {(post, n): (b["type"], hashlib.sha256(rendered(b).encode()).hexdigest()) for post, (blocks, _) in posts.items() for n, b in enumerate(blocks)}
    assert got == want
    counters = Counter()
    for _, (_, counts) in posts.items():
        counters.update({k: v for k, v in counts.items()})
    assert {r["rule"]: r["removed"] for r in registry.QUERIES["html_removal_counters"](spark, base).collect()} == counters


def test_blog_chunks_row_by_row(spark, base, posts):
    want = {}
    for post, (blocks, _) in posts.items():
        idle = [b["type"] == "image" and b["alt"].lower() in ("test", "contact us") for b in blocks]
        run = "\n\n".join(t for t in ("" if i else rendered(b) for i, b in zip(idle, blocks, strict=True)) if t)
        cuts = range(0, max(1, len(run) - 150), 850) if run else ()
        want |= {(post, n): hashlib.sha256(run[at : at + 1000].encode()).hexdigest() for n, at in enumerate(cuts)}
    assert {(r["post_id"], r["chunk_index"]): r["content_hash"] for r in registry.QUERIES["blog_chunks"](spark, base).collect()} == want


def test_records_hash_their_title_and_blocks(spark, base, posts):
    """Posts whose blocks are paragraphs and headings alone, byte by byte."""
    plain = {p: blocks for p, (blocks, _) in posts.items() if blocks and all(b["type"] in ("paragraph", "heading") and not b.get("links") for b in blocks)}
    titles = {r["post_id"]: r["title"] for r in read_table(spark, base, "blog").select("post_id", "title").collect()}
    got = {r["source_ref"].rpartition("#")[2]: r["content_hash"] for r in registry.QUERIES["blog_records"](spark, base).where("half_pairs >= 0 and n_blocks > 0").collect()}
    fold = lambda t: " ".join(markup.tidy(t).split())
    checked = 0
    for post, blocks in plain.items():
        records = [["DOC", fold(titles[post])], *[["H", str(b["level"]), fold(b["text"])] if b["type"] == "heading" else ["P", fold(b["text"])] for b in blocks]]
        want = hashlib.sha256("".join("\x1f".join(r) + "\x1e" for r in records).encode()).hexdigest()
        checked += got.get(str(post)) == want
    assert not plain or checked


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["run_id", "canonical_uri", "change_type"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
