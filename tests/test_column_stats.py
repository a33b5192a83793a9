"""Column statistics over line items dealt by dataset."""

import re

from conftest import SMALL, rows

import __spark_entry__ as entry
from tablewarden.plans import quality_queries


def test_extremes_are_summed_where_the_files_are(spark, monkeypatch):
    """No exchange carries extremes of single files; with a hot dataset they are summed in parts, with the same rows."""
    found = entry.queries()["column_stats"](spark, SMALL)
    plan = found._jdf.queryExecution().toString().split("== Physical Plan ==")[1].splitlines()
    dealt = [i for i, x in enumerate(plan) if re.search(r"Exchange hashpartitioning", x)]
    below = [next((y for y in plan[i + 1 :] if "Aggregate(" in y), "") for i in dealt]
    assert dealt and not any("partial_min_by" in y or "partial_max_by" in y for y in below)
    want = rows(found)
    monkeypatch.setattr(quality_queries, "TASK_ROWS", 0)
    assert rows(entry.queries()["column_stats"](spark, SMALL)) == want != []
