from __future__ import annotations

import random
import struct
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.functions import blocks as B
from corpusmill.functions import images, markup, text, urls
from corpusmill.functions.urls import canonical


def test_text_natively_as_in_python(spark):
    samples = ["  a \tb \r\n\r\n c​ ", "“q” ‘s’", "café", "\U0001f468‍\U0001f469 x‍y", "", None, " a b ", "plain"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, s string").select("i", "s", text.content_text(F.col("s")).alias("c"), text.hash_text(F.col("s")).alias("h"))
    for row in df.collect():
        assert row["c"] == (markup.tidy(row["s"]) if row["s"] is not None else None)
        assert row["h"] == (" ".join(markup.tidy(row["s"]).split()) if row["s"] is not None else None)


@pytest.mark.parametrize(
    ("given_text", "wanted"),
    [
        ("\u2764\u200dx", "\u2764\u200dx"), ("x\u200d\u2764", "x\u200d\u2764"), ("x\u200dy", "xy"), ("\u2764\ufe0f\u200d\U0001f525", "\u2764\ufe0f\u200d\U0001f525"),
        ("\U0001f469\U0001f3fd\u200d\U0001f680", "\U0001f469\U0001f3fd\u200d\U0001f680"), ("\u200d", ""), ("\u2764\u200d\u200dx", "\u2764\u200dx"), ("\u2192\u200d\u2200", "\u2192\u2200"),
        ("\U0001f1e9\u200d\U0001f1ea", "\U0001f1e9\U0001f1ea"), ("\U0001fc00\u200dx", "\U0001fc00\u200dx"), ("e\u0301", "\u00e9"),
    ],
)
def test_joiners(given_text, wanted):
    assert text.compose(given_text) == wanted


def test_joiners_in_linear_time():
    many = "\u0915\u094d\u200d" * 200_000
    start = time.process_time()
    assert "\u200d" not in text.compose(many)
    assert time.process_time() - start < 5


def test_labels_fold_by_case_folding(spark):
    rows = [("  Stra\u00dfe \u00a0 X ",), ("STRASSE x",), ("\u0130x",), (None,), (" A\x1cb\tC ",)]
    got = [r[0] for r in spark.createDataFrame(rows, "s string").select(text.folded_label(F.col("s"))).collect()]
    assert got == ["strasse x", "strasse x", "i\u0307x", None, "a b c"]


def test_document_hash_of_composed_and_decomposed_spellings(spark):
    cases = ['[{"type":"paragraph","text":"caf\u00e9","links":[]}]', '[{"type":"paragraph","text":"cafe\u0301","links":[]}]', '[{"type":"paragraph","text":"cafe\\u0301","links":[]}]']
    df = spark.createDataFrame([(t, c) for t in ("Pr\u00e9cis", "Pre\u0301cis") for c in cases], "t string, j string")
    assert df.select(B.document_hash(F.col("t"), B.parse_blocks("j", compose_unicode=True)["blocks"])).distinct().count() == 1


def test_a_list_without_depth_keeps_its_fields(spark):
    one = spark.range(1).select(F.from_json(F.lit('[{"type":"list","ordered":false,"items":["x"]}]'), B.BLOCKS).alias("b"))
    assert one.select(B.serialize(F.lit("T"), F.col("b"))).first()[0] == "DOC\x1fT\x1eLIST\x1f0\x1f\x1f\x1fx\x1e"


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_tidy_is_stable(value):
    assert markup.tidy(markup.tidy(value)) == markup.tidy(value)


@pytest.mark.parametrize(
    ("given_url", "base", "wanted"),
    [
        ("HTTP://Ex.com:80/a//b/../c/?utm_source=x&b=2&a=1#f", None, "http://ex.com/a/c?a=1&b=2#f"),
        ("../x", "https://e.com/a/b", "https://e.com/x"),
        ("#top", None, None), ("", None, None), (None, None, None), ("javascript:alert(1)", None, None), ("data:x", None, None), ("page", None, None),
        ("MAILTO:A@b.c", None, "mailto:A@b.c"), ("tel:+1", None, "tel:+1"),
        ("https://u:p@e.com:8443", None, "https://u:p@e.com:8443/"), ("https://[::1]:443/x", None, "https://[::1]/x"),
        ("https://bücher.de/%7e%2f", None, "https://xn--bcher-kva.de/~%2F"), ("https://e.com./a?k&b=", None, "https://e.com/a?b=&k"),
        ("https://e.com/%zz", None, "https://e.com/%zz"),
    ],
)
def test_canonical_url(given_url, base, wanted):
    assert canonical(given_url, base) == wanted


def test_native_url_as_exact(spark):
    rng = random.Random(4)
    parts = ["a", "B", "/", "//", ".", "..", "/x.y", "?", "&", "=", "utm_source=1", "GCLID", "#", "-", "%41", ";", ":", "~", "\u00e9", " ", "+", "1"]
    heads = ["http://Ex.com", "https://e.com:443", "HTTP://e.com:80/", "https://E.com.:443/x", "https://a-b.c:8443/p", "http://u@h/", "https://"]
    rows = [(rng.choice(heads) + "".join(rng.choice(parts) for _ in range(rng.randrange(9))),) for _ in range(3000)] + [(None,), ("",), (" https://e.com/a ",)]
    found = spark.createDataFrame(rows, "u string").select("u", urls.canonical_url(F.col("u")).alias("n"), F.col("u").rlike(urls._PLAIN_URL).alias("plain")).collect()
    assert [r["n"] for r in found] == [canonical(u) for u, in rows]
    assert sum(bool(r["plain"]) for r in found) > 500


def test_html_rules():
    found, counts = markup.convert(
        "<!-- c --><script>x</script><p onclick='a'>clo<span hidden>x</span>ud <a href='/r?utm_id=1'>link</a><img src='p.png' alt='pic'></p><ul><li>a<ul><li>b</li></ul></li></ul><hr>"
        "<div style='DISPLAY : none'>no</div><p> </p>bare<table><tr><th>h</th><th>i</th></tr><tr><td colspan=2>v</td></tr><tr><td>w</td></tr></table><h2>T<br>U</h2>",
        "https://e.com/x",
    )
    kinds = [(b["type"], b.get("text")) for b in found]
    assert kinds == [("paragraph", "cloud link"), ("image", None), ("list", None), ("list", None), ("paragraph", "bare"), ("table", None), ("heading", "T\nU")]
    assert found[0]["links"] == [{"text": "link", "href": "https://e.com/r"}]
    assert (found[2]["items"], found[3]["items"], found[3]["depth"]) == (["a"], ["b"], 1)
    assert found[5]["header"] == ["h", "i"] and found[5]["rows"] == [["v", "v"], ["w", ""]]
    assert counts == {"r1_comments": 1, "r2_scripting": 1, "r8_handlers": 1, "r5_hidden_attr": 1, "r10_presentational": 1, "r6_hidden_style": 1, "r11_empty": 1}


@pytest.mark.parametrize(
    ("html", "wanted"),
    [
        ("a <b>b</b> c", ["a", "b", "c"]), ("<p>one<p>two", ["one", "two"]), ("<div>x<p>y</p>z</div>", ["x", "y", "z"]), ("&amp;lt;b&gt;", ["&lt;b>"]),
        ("<li>x<li>y", ["x", "y"]), ("", []), ("<p>", []), ("<figure><img src=a alt=b><figcaption>c</figcaption></figure>", [None]),
    ],
)
def test_block_texts(html, wanted):
    assert [b.get("text") for b in markup.convert(html)[0]] == wanted


@pytest.mark.parametrize("start", ["<div>", "<b>", "<ul><li>", "<table><tr><td>", "<figure>", "<p><span>", "<section hidden>", "<a href='/x'>"])
def test_nesting_of_any_depth_takes_linear_time(start):
    begin = time.process_time()
    found, _ = markup.convert(start * 100_000 + "deep", "https://e.com/") if "href" not in start else markup.convert(start * 3_000 + "deep", "https://e.com/")
    assert time.process_time() - begin < 30
    assert len(found) == (0 if "hidden" in start else 1)


def test_unmarked_header():
    head = "<tr><td><b>a</b></td><td><p><strong>b</strong></p></td></tr>"
    assert markup.unmarked_headers(markup.parse(f"<table>{head}<tr><td>1</td><td>2</td></tr></table>")) == 1
    assert markup.unmarked_headers(markup.parse(f"<table>{head}</table>")) == 0
    assert markup.unmarked_headers(markup.parse(f"<table>{head.replace('</strong>', '</strong>x')}<tr><td>1</td></tr></table>")) == 0


def test_blocks_json_and_records(spark):
    good = '[{"type":"heading","level":2,"text":"H"},{"type":"paragraph","text":"a  b","links":[{"text":"l","href":"https://e.com/"}]},{"type":"list","ordered":true,"items":["x","y"],"depth":0,"start":null},{"type":"table","header":["h"],"rows":[["v"]],"caption":null},{"type":"image","src":"s","alt":"","caption":null,"role":"decorative"},{"type":"faq_pair","question":"q","answer":[{"type":"paragraph","text":"a","links":[]}]}]'
    bad = ['{"type":"heading"}', '[{"type":"heading","level":true,"text":"x"}]', '[{"type":"nope"}]', "x", None, '[{"type":"faq_pair","question":"q","answer":[{"type":"faq_pair","question":"q","answer":[]}]}]']
    df = spark.createDataFrame([(good,), *[(b,) for b in bad]], "j string").select("j", B.parse_blocks("j").alias("r"))
    rows = df.select("j", "r.problem", B.serialize(F.lit("T"), F.col("r.blocks")).alias("s"), F.transform("r.blocks", B.has_text).alias("h")).collect()
    assert [r["problem"] is None for r in rows] == [True] + [False] * len(bad)
    fields = "\x1f".join
    want = ["DOC\x1fT", fields(["H", "2", "H"]), fields(["P", "a b"]), fields(["LINK", "l", "https://e.com/"]), fields(["LIST", "1", "0", "", "x", "y"]), fields(["TABLE", "", "1"]), fields(["TH", "h"]), fields(["TR", "v"]), "ENDTABLE", fields(["FAQ", "q"]), fields(["P", "a"]), "ENDFAQ"]
    assert rows[0]["s"].split("\x1e") == [*want, ""]
    assert rows[0]["h"] == [True, True, True, True, False, True]


def png(pixels: np.ndarray, kind: int, method: int) -> bytes:
    height, width, samples = pixels.shape
    raw, above = b"", np.zeros(width * samples, np.int32)
    for line in pixels.reshape(height, -1).astype(np.int32):
        left = np.concatenate([np.zeros(samples, np.int32), line[:-samples]])
        raw += bytes([method]) + ((line - {0: 0, 1: left, 2: above, 3: (left + above) // 2}[method]) & 255).astype(np.uint8).tobytes()
        above = line
    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_png_comparison():
    rng = np.random.default_rng(1)
    rgba = rng.integers(0, 255, (5, 4, 4), dtype=np.uint8)
    rgba[0, 0, 3] = 0
    files = [png(rgba, 6, m) for m in range(4)]
    for f in files:
        assert images.png_size(f) == (4, 5) and (images.png_pixels(f) == rgba).all()
    other = rgba.copy()
    other[0, 0, :3] ^= 1
    seen = rgba.copy()
    seen[1, 1, 0] ^= 1
    seen[1, 1, 3] = 255
    assert images.compare(files[0], files[0]) == "confirmed_exact"
    assert images.compare(files[0], files[1]) == "confirmed_pixel_identical"
    assert images.compare(files[0], png(other, 6, 0)) == "confirmed_visual_equivalent"
    assert images.compare(files[0], png(seen, 6, 0)) == "needs_review"
    assert images.compare(files[0], png(rgba[:, :2], 6, 0)) == "different_image"
    assert images.compare(files[0], b"x") == "needs_review"
    grey = png(rgba[..., :1], 0, 2)
    assert (images.png_pixels(grey)[..., 0] == rgba[..., 0]).all()
