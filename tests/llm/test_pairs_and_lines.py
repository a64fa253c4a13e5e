from __future__ import annotations

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import broken_pairs, html_text, repeated_lines, splitting
from corpusmill.sources.tables import read_table

FAQ = "faq_id bigint, pairs array<struct<question:string,answer:string>>, defect string, pair_no string"
SENTENCES = [
    "The lead auditor reviews the audit plan before the opening meeting.", "The client confirms the risk register at the closing meeting.",
    "The quality lead updates the supplier list, because regulators ask for it.", "The data steward samples the travel plan once a quarter.",
]


def judged(spark, rows):
    return {(r["faq_id"], r["pair_no"]): r["defect"] for r in broken_pairs.find_broken_pairs(spark.createDataFrame(rows, FAQ)).collect()}


def test_defects(spark):
    q = "<p>2. How long does the certification of the data centre take?</p>"
    cases = {
        None: ["The lead auditor reviews the audit plan before the opening meeting.", "Yes", "Three years", "I cannot stress enough how useful an audit is.", "How long does the certification of the data centre take? The client confirms the risk register at the closing meeting."],
        "empty": [None, "", " \n", "<p>&nbsp;</p>", "n/a", "…", "​", "TBD"],
        "copied": ["how long does the certification of the data centre take", "Q: How long does the certification the of data centre take?", "How long does the certification of the data centre take? How long does the certification of the data centre take?"],
        "refusal": ["I'm sorry, but I can't help with that.", "Leider kann ich diese Frage nicht beantworten.", "No comment. Thank you for your understanding.", "Je ne suis pas autorisé à donner cette information."],
        "truncated": ["The lead auditor reviews the audit plan before the", "The client confirms the risk register at the closing meeting. The data ste", "The quality lead updates the (", "The data steward samples the travel […]"],
        "wrong_language": ["Der Kunde prüft das Risikoregister und die Lieferantenliste vor dem Gespräch."],
    }
    filler = [(100 + i, [(q, SENTENCES[i % 4] + " " + SENTENCES[(i + 1) % 4])] * 3, "x", "x") for i in range(60)]
    flat = [(kind, answer) for kind, answers in cases.items() for answer in answers]
    got = judged(spark, [(1, [(q, a) for _, a in flat], "x", "x"), *filler])
    assert {n: got.get((1, n)) for n in range(1, len(flat) + 1)} == {n: kind for n, (kind, _) in enumerate(flat, 1)}
    assert all(key[0] == 1 for key in got)


def test_pairs_at_the_edges(spark):
    rows = [(1, None, None, None), (2, [], None, None), (3, [None, (None, "Yes."), ("Q?", None)], None, None), (None, [("a?", None)], None, None), (4, [("q?", "word " * 50_000 + "end.")], None, None), (4, [("q?", None)], None, None), (4, [("q?", None)], None, None)]
    found = broken_pairs.find_broken_pairs(spark.createDataFrame(rows, FAQ)).collect()
    assert sorted(((r["faq_id"] or 0), r["pair_no"], r["defect"]) for r in found) == [(0, 1, "empty"), (3, 1, "empty"), (3, 3, "empty"), (4, 1, "empty"), (4, 1, "empty")]
    assert broken_pairs.find_broken_pairs(spark.createDataFrame([], FAQ)).count() == 0


@pytest.mark.parametrize("question, answer, copy", [
    ("How long does the audit take?", "how long does the audit TAKE", True), ("Why?", "Why?", True), ("Why?", "Who?", False), ("Is it safe?", "Yes, it is.", False),
    ("How long does the audit of ISO 22301 take?", "How long does the audit of ISO 22301 take? How long does the audit of ISO 22301 take?", True),
    ("How long does the audit of ISO 22301 take?", "How long does the audit of ISO 22301 take? Two days.", False), ("What is ISO 9001 for?", "ISO 9001 and ISO 14001", False),
])
def test_compression_decides_copies(monkeypatch, question, answer, copy):
    assert broken_pairs.is_copy(question, answer) == copy
    monkeypatch.setattr(broken_pairs, "new_share", lambda q, a: 1.0)
    assert not broken_pairs.is_copy(question, answer)


def test_share_that_is_new():
    question = "How long does the certification of data centre audits take at ISO 22301?"
    assert broken_pairs.new_share(question, question) == 0
    assert broken_pairs.new_share(question, "Two audit days per site are enough for most clients.") > 0.8


def test_refusals_of_any_length():
    long = "I am sorry, but after going through everything that was sent to us over the last weeks, and with all due respect for the effort behind the request, the many colleagues involved and the time that has passed since, we are not able, for reasons that have been explained to you before, to say anything on this."
    assert len(long.split()) > 50 and broken_pairs.is_refusal(long)
    assert not broken_pairs.is_refusal("We cannot answer for other bodies. " + "The lead auditor reviews the audit plan before the opening meeting. " * 3)


BLOG = "post_id bigint, site string, html string, leaf string, key string"


def brute(rows):
    total, seen, lines = defaultdict(int), defaultdict(set), []
    for n, (post, site, html, *_) in enumerate(rows):
        total[site] += 1
        for no, line in enumerate((html or "").split("\n") if html is not None else [], 1):
            key = repeated_lines.line_key(line)
            if key:
                seen[site, key].add(n)
                lines.append((post, no, site, key))
    return sorted((p or 0, no) for p, no, s, k in lines if len(seen[s, k]) >= 5 and 10 * len(seen[s, k]) >= total[s])


def test_repeated_lines(spark):
    rows = [(i, "a" if i % 3 else None, f"<p>Text {chr(97 + i % 26)}{i}</p>\n<small>Read <b>{i}</b> more&nbsp;times</small>\r\n" + ("Rare line\n" if i < 9 else "") + "<br/>\nSame start same start X " + "xyz"[i % 3], None, None) for i in range(40)]
    rows += [(50, "a", None, None, None), (51, "a", "", None, None), (None, "a", "read  5 MORE times", None, None), (52, "b", "read more times", None, None), (3, "a", rows[3][2], None, None)]
    df = spark.createDataFrame(rows, BLOG)
    got = sorted((r["post_id"] or 0, r["line_no"]) for r in repeated_lines.repeated_lines(df).collect())
    assert got == brute(rows) and got
    cleaned = {(r["post_id"], r["site"]): r for r in repeated_lines.without_repeated_lines(df).collect()}
    assert "more" not in cleaned[4, "a"]["html"] and cleaned[4, "a"]["n_removed"] >= 1
    assert cleaned[50, "a"]["html"] is None and cleaned[52, "b"]["html"] == "read more times"
    assert any("<*>" in r["template"] for r in repeated_lines.repeated_templates(df).collect())
    empty = spark.createDataFrame([], BLOG)
    assert repeated_lines.repeated_lines(empty).count() == repeated_lines.without_repeated_lines(empty).count() == 0


def test_rows_that_share_a_post_id_keep_their_own_lines(spark):
    rows = [(n, "a", f"own {w}\nread more\nlast {w}", None, None) for n, w in enumerate("alpha beta gamma delta epsilon zeta".split())]
    rows += [(7, "a", "kept once\nkept twice\nread more", None, None), (7, "a", "read more\nkept thrice", None, None), (None, "a", "kept null\nread more", None, None), (None, "a", "read more\nkept void", None, None)]
    cleaned = repeated_lines.without_repeated_lines(spark.createDataFrame(rows, BLOG)).collect()
    assert sorted(r["html"] for r in cleaned) == sorted(h.replace("\nread more", "").replace("read more\n", "") for _, _, h, *_ in rows)


def test_templates_with_slots_of_several_trees():
    first, second = [], []
    for name in ("anna karl", "boris ash", "clara thor"):
        repeated_lines.grow(first, f"filed under news by {name} on monday last week".split())
    for name in ("dora fen", "emil gard"):
        repeated_lines.grow(second, f"filed under news by {name} on monday last week".split())
    repeated_lines.grow(second, "filed under quite other words than all these here do".split())
    merged = list(first)
    for template in second:
        repeated_lines.grow(merged, template)
    assert merged[0] == ("filed", "under", "news", "by", None, None, "on", "monday", "last", "week") and len(merged) == 2
    assert repeated_lines.matching(merged, "filed under news by any body on monday last week".split()) == 0
    assert repeated_lines.matching(merged, "filed under news by any body on friday last week".split()) == -1


def test_joins_beyond_the_broadcast_bound(spark, monkeypatch):
    rows = [(i, f"s{i % 2}", f"shared line of many\nshared line of {'xyz'[i % 3]}\nalone {chr(97 + i % 26)} {i}", None, None) for i in range(60)]
    df = spark.createDataFrame(rows, BLOG)
    want = sorted((r["post_id"], r["line_no"]) for r in repeated_lines.repeated_lines(df).collect())
    monkeypatch.setattr(repeated_lines, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(repeated_lines, "TREE_TEMPLATES", 2)
    monkeypatch.setattr(repeated_lines, "LEAF_LINES", 0)
    assert sorted((r["post_id"], r["line_no"]) for r in repeated_lines.repeated_lines(df.where("post_id < 0")).collect()) == []
    monkeypatch.setattr(repeated_lines, "LEAF_LINES", 1)
    assert sorted((r["post_id"], r["line_no"]) for r in repeated_lines.repeated_lines(df).collect()) == want == brute(rows)


def test_repeated_lines_on_the_tables(spark, base):
    blog = read_table(spark, base, "blog")
    rows = [(r["post_id"], r["site"], r["html"]) for r in blog.collect()]
    assert sorted((r["post_id"], r["line_no"]) for r in repeated_lines.repeated_lines(blog).collect()) == brute(rows)


def test_a_third_of_all_posts_in_one_site(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"s{i}", "same line\nown line " + "abcdefgh"[i % 8] * (i % 5 + 1), None, None) for i in range(900)]
    df = spark.createDataFrame(rows, BLOG).repartition(7)
    assert sorted((r["post_id"], r["line_no"]) for r in repeated_lines.repeated_lines(df).collect()) == brute(rows)


@pytest.mark.parametrize(
    ("markup", "text"),
    [("a<!-- x\ny -->b", "a b"), ("<script>1<2</script>x&amp;lt;", "x&lt;"), ("1 < 2 <b", "1 < 2 <b"), ("a&nbsp; b", "a b"), ("<p>x</p><p>y", "x y"), ("", "")],
)
def test_visible_text(markup, text):
    assert html_text.visible_text(markup) == html_text.visible_blocks(markup)[0] == text
    long = markup + " " * 200_000
    assert html_text.visible_text(long) == html_text.visible_text(markup)


def test_pieces(spark):
    rows = [(1, None), (2, ""), (3, "x" * 1000), (4, "y" * 2500), (5, "Sentence one here. " * 200), (None, "z" * 1001), (5, "Sentence one here. " * 200), (6, "\U0001f600" * 1001), (7, "word " * 400_000)]
    df = spark.createDataFrame(rows, "id bigint, body string").withColumns({"item_id": F.lit("clash"), "content": F.lit("clash")})
    pieces = defaultdict(list)
    for r in splitting.split_items(df, "t", "id", "body", 1000, 150).collect():
        pieces[r["item_id"]].append(r)
    assert set(pieces) == {4, 5, 6, 7, None}
    for key, own in pieces.items():
        text = dict(rows)[key]
        own = sorted(own, key=lambda r: (r["piece_no"], r["start"]))[:: 2 if key == 5 else 1]
        assert [p["piece_no"] for p in own] == list(range(1, len(own) + 1))
        assert own[0]["start"] == 0 and own[-1]["end"] == len(text)
        assert all(p["content"] == text[p["start"] : p["end"]] and 0 < len(p["content"]) <= 1000 for p in own)
        assert all(b["start"] == a["end"] - 150 and b["content"][:150] == a["content"][-150:] for a, b in zip(own, own[1:], strict=False))
        if key == 5:
            assert all(p["content"].endswith(". ") for p in own[:-1])
    with pytest.raises(ValueError):
        splitting.split_items(df, "t", "id", "body", 100, 100)
    assert splitting.split_items(df.where("false"), "t", "id", "body", 1000).count() == 0


def test_oversized_items_on_the_tables(spark, base):
    blog, chunks = read_table(spark, base, "blog"), read_table(spark, base, "evaluate_embeddings")
    want = {("blog", r["post_id"]) for r in blog.collect() if r["html"] and len(html_text.visible_text(r["html"])) > 4000}
    want |= {("evaluate_embeddings", r["chunk_id"]) for r in chunks.collect() if r["content"] and len(r["content"]) > 1000}
    assert {tuple(r) for r in splitting.oversized_items(blog, chunks).collect()} == want
