"""Pages that share large sections."""

from __future__ import annotations

import re

from corpusmill.plans.records import QUERIES


def test_no_python_runs_over_whole_pages_and_sections_are_made_once(spark, base):
    plan = QUERIES["composed_pages"](spark, base)._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Join")]
    # rows that wait for Python are spilled, here with all of a nation's suppliers in each
    assert "ArrowEvalPython" not in above and "EvalPython" not in above
    assert not re.search(r"transform\(", above), "blocks are serialized for every page"
