"""An ending proves itself by different pairs, not by copies of one."""

from __future__ import annotations

from corpusmill.llm import broken_pairs
from tests.llm.test_pairs_and_lines import FAQ, SENTENCES, judged

CUT = "The client confirms the risk register at the closing meeting. The data steward samples the travel"


def test_copies_of_a_cut_answer_do_not_make_it_complete(spark):
    whole = [(100 + i, [(f"q {i}?", SENTENCES[i % 4] + " " + SENTENCES[(i + 1) % 4])] * 3, "x", "x") for i in range(60)]
    copies = [(i, [("Who samples the travel plan of the client?", CUT)], "x", "x") for i in range(1, 41)]
    got = judged(spark, [*copies, *whole])
    assert {k: d for k, d in got.items() if k[0] <= 40} == {(i, 1): "truncated" for i in range(1, 41)}


def test_endings_of_different_pairs_recur(spark):
    rows = [(i, [(f"What about topic {i}?", f"Topic {i} is reviewed in the meeting. First the plan, last the report")], "x", "x") for i in range(8)]
    rows += [(100 + i, [(f"What about topic {i}?", f"Topic {i} is due. It ends with word{i}")], "x", "x") for i in range(120)]
    rows += [(300 + i, [("Same question?", "The plan is due. The steward sees a copy"), ("3. Same question?", "The plan is due. The steward sees a copy")], "x", "x") for i in range(20)]
    pairs = spark.createDataFrame(rows, FAQ).selectExpr("inline(pairs)")
    assert broken_pairs.recurring_endings(pairs) == {"ending": frozenset({"last the report"}), "trailing": frozenset()}
    assert broken_pairs.recurring_endings(pairs.where("false")) == {"ending": frozenset(), "trailing": frozenset()}
