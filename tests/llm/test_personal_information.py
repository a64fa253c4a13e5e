from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from corpusmill.llm import personal_information as pii

FIRST, LAST = ["Anna", "Boris", "Clara", "Dmitri", "Elena"], ["Karlstein", "Morgenfeldt", "Tannbury", "Silverthwaite", "Holmfeldt", "Ashbury"]
FRAMES = [
    ("person_name", "Please call Ms {} on Monday.", lambda r: f"{r.choice(FIRST)} {r.choice(LAST)}"),
    ("person_name", "Interviewed: Dr. {} after the merger.", lambda r: f"{r.choice(FIRST)} {r.choice(LAST)}"),
    ("person_name", "Dear Mr {}, the plan is ready.", lambda r: r.choice(LAST)),
    ("email", "My mail is {}, thanks!", lambda r: f"{r.choice(FIRST).lower()}.{r.choice(LAST).lower()}@example.org"),
    ("email", "Write to {} please", lambda r: f"{r.choice(FIRST).lower()} [at] example [dot] org"),
    ("phone", "You can phone {} after lunch.", lambda r: f"+49 30 23125 {r.randrange(100, 999)}"),
    ("phone", "Callback wanted: {} (evenings).", lambda r: f"({r.randrange(200, 999)}) 555 01{r.randrange(10, 99)}"),
    ("id_number", "Enclosed find my SSN {}, valid until June.", lambda r: f"666-{r.randrange(10, 99)}-{r.randrange(1000, 9999)}"),
    ("id_number", "She registers with passport no. {}.", lambda r: f"X{r.randrange(1000000, 9999999)}"),
    ("street_address", "The new site is at {} please.", lambda r: f"{r.randrange(1, 300)} {r.choice(['Ashen', 'Millrace', 'Old'])} {r.choice(['Street', 'Road', 'Lane'])}, Tolvane"),
]
NOISE = ["Ticket 228-3796 was closed on 13.02.2024.", "The certificate carries the number CH-QMS-2021-626200.", "Batch 1516 9644 1462 left the Ashen plant late.", "At Kestrand Foods GmbH, the lead auditor samples the travel plan.", "Invoice total 4,286.10, room 330, lane 8.", "The offer is 90 days @ 1135 EUR, reference 964-34/2019."]


def make(seed, count):
    rng = random.Random(seed)
    texts, truth = [], []
    for _ in range(count):
        text, found = "", []
        for _ in range(rng.randrange(1, 6)):
            if rng.random() < 0.5:
                text += rng.choice(NOISE) + " "
            else:
                kind, frame, value = rng.choice(FRAMES)
                head, tail = frame.split("{}")
                found.append((kind, len(text) + len(head)))
                text += head + value(rng) + tail + " "
        texts.append(text)
        truth.append(found)
    return texts, truth


@pytest.fixture(scope="module")
def model():
    return pii.fit_model(make(1, 900)[0])


def test_held_out_accuracy(model):
    texts, truth = make(2, 400)
    got = pii.label_documents(texts, pii.Scorer(model))
    a = {(n, k, s) for n, own in enumerate(truth) for k, s in own}
    b = {(n, k, s) for n, own in enumerate(got) for k, s, _ in own}
    assert len(a & b) / len(a) > 0.97 and len(a & b) / len(b) > 0.97


def test_documents_do_not_influence_each_other(model):
    texts, _ = make(3, 60)
    whole = pii.label_documents(texts, pii.Scorer(model))
    scorer = pii.Scorer(model, most=5)
    assert [pii.label_documents([t], scorer)[0] for t in texts] == whole


def test_chain_sums_against_enumeration():
    rng = np.random.default_rng(0)
    emission, steps = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3))
    nodes, pairs = pii.marginals(emission, np.array([4]), steps)
    paths = list(itertools.product(range(3), repeat=4))
    weight = np.exp([sum(emission[0, i, p[i]] for i in range(4)) + sum(steps[p[i], p[i + 1]] for i in range(3)) for p in paths])
    weight /= weight.sum()
    want = np.zeros((4, 3))
    for p, w in zip(paths, weight, strict=True):
        for i in range(4):
            want[i, p[i]] += w
    assert np.allclose(nodes[0], want) and np.isclose(pairs.sum(), 3)
    padded = np.concatenate([emission, rng.normal(size=(1, 3, 3))], axis=1)
    assert np.allclose(pii.marginals(padded, np.array([4]), steps)[0][0, :4], want)


def test_skip_edges_join_equal_and_similar_words():
    kinds, words, _ = pii.tokenize("Mr Karlstein came with Ánna. Later the Karlsteins and ANNA wrote from anna.k@example.org .")
    names = pii.Gazetteer(frozenset({"anna"}), frozenset(), frozenset())
    found = {(kind, words[a], words[b]) for kind, a, b in pii.skip_links(kinds, words, frozenset({"later", "the", "and"}), names)}
    assert found == {(pii.SHOWN, "Karlstein", "Karlsteins"), (pii.EQUAL, "Ánna", "ANNA"), (pii.MAIL, "Ánna", "anna.k@example.org"), (pii.MAIL, "ANNA", "anna.k@example.org")}


def test_skip_edges_alone_find_an_item(model):
    """A surname never met in fitting, shown once by a form of address and repeated without one."""
    text = "Dear Mr Quibblesworth, the plan is ready. Ticket 228-3796 was closed. The old file lists Quibblesworth under travel."
    lone = text.rindex("Quibblesworth")
    with_edges = pii.label_documents([text], pii.Scorer(model))[0]
    without = pii.label_documents([text], pii.Scorer(model), turns=0)[0]
    assert ("person_name", lone, lone + 13) in with_edges
    assert lone not in {s for _, s, _ in without} and {s for k, s, _ in without if k == "person_name"} == {8}


def test_stretches_hold_all_that_can_be_an_item(model):
    texts, truth = make(5, 200)
    for text, own in zip(texts, truth, strict=True):
        spans = pii.live_stretches(text, model.ordinary)
        assert all(any(a <= s < b for a, b in spans) for _, s in own)
    assert pii.live_stretches("the lead auditor samples the travel plan. " * 50, frozenset("the lead auditor samples travel plan".split())) == []


DOCS = "doc_id bigint, text string, start_pos string, pii_type int"


def test_operator(spark):
    texts, truth = make(4, 500)
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(1000, None, "x", 1), (1001, "", "x", 1), (1002, " \n", "x", 1), (None, texts[0], "x", 1), (0, texts[0], "x", 1), (1003, "plain " * 40_000 + "Please call Ms Anna Karlstein on Monday.", "x", 1)]
    df = spark.createDataFrame(rows, DOCS)
    found = [tuple(r) for r in pii.find_personal_information(df).collect()]
    assert {r[0] for r in found} & {1000, 1001, 1002} == set()
    assert (1003, "person_name", 240_015) in {r[:3] for r in found}
    assert sum(r[0] is None for r in found) * 2 == sum(r[0] == 0 for r in found) == 2 * len(truth[0])
    masked = {r["doc_id"]: r for r in pii.mask_personal_information(df).collect()}
    assert masked[1000]["text"] is None and masked[1001]["text"] == ""
    assert "Karlstein" not in masked[1003]["text"] and masked[1003]["text"].endswith("Please call Ms [NAME] on Monday.")
    assert pii.find_personal_information(df.where("false")).count() == 0


@pytest.mark.parametrize("text", ["a-" * 20_000, "A-1" * 20_000, "1 " * 20_000, "a.b" * 20_000, "x" * 200_000, "@" * 9_000])
def test_long_runs_take_linear_time(text):
    assert sum(len(t) for t in pii.tokenize(text)[1]) <= len(text)
