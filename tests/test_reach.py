"""Shortest distances from labels, against plain Python."""

import random

import pytest
from conftest import rows

from tablewarden.operators import lineage


def plain(edges, roots):
    out = {}
    for label, *start in roots:
        seen, front, depth = {tuple(start): 0}, [tuple(start)], 0
        while front:
            depth += 1
            front = [(t, u) for s, c, t, u in edges if (s, c) in front and None not in (s, c, t, u)]
            front = [x for x in dict.fromkeys(front) if x not in seen and not seen.update({x: depth})]
        for at, d in seen.items():
            known = out.get((label, *at))
            out[label, *at] = d if known is None else min(d, known)
    return sorted(((*k, d) for k, d in out.items() if d), key=repr)


@pytest.mark.parametrize("many", [0, 5_000_000])
def test_reach_of_many_labels(spark, many, monkeypatch):
    """Over sixty labels and NULL, chains longer than a plan, cycles, NULL ends; one state row for a column, whatever the labels."""
    rnd = random.Random(5)
    edges = [(i, "c", i + 1, "c") for i in range(16)] + [(5, "c", 2, "c"), (3, "c", None, "x"), (None, "c", 4, "c"), (7, None, 8, "c")]
    edges += [(rnd.randrange(30), rnd.choice("cd"), rnd.randrange(30), rnd.choice("cd")) for _ in range(20)]
    roots = [(f"l{i}" if i else None, rnd.randrange(18), "c") for i in range(70)] + [(None, 0, "c")] * 2
    made = spark.createDataFrame([(*e, None, None) for e in edges], "source_dataset_id bigint, source_field_name string, target_dataset_id bigint, target_field_name string, transformation_type string, expression string")
    starts = spark.createDataFrame(roots, "label string, dataset_id bigint, column_name string")
    monkeypatch.setattr(lineage, "MANY_EDGES", many)
    counts, keep = [], lineage.settle_counted
    monkeypatch.setattr(lineage, "settle_counted", lambda df, label: (r := keep(df, label), counts.append(r[1]) if label == "reach" else None)[0])
    assert rows(lineage.first_reach(made, starts)) == plain(edges, list(dict.fromkeys(roots)))
    assert counts and max(counts) <= 2 * 60  # two groups of labels
    merged = plain(edges, [("", *r[1:]) for r in roots])
    assert rows(lineage.first_reach(made, starts.drop("label"))) == [r[1:] for r in merged]
    cut = [r for r in plain(edges, list(dict.fromkeys(roots))) if r[3] <= 3]
    assert rows(lineage.first_reach(made, starts, 3)) == cut
