"""Exact top-k search, hard negatives and the audit of filters, against plain Python."""

import itertools

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tablewarden.llm import cover_tree, filter_audit, negatives
from tablewarden.llm import vectors as V

SCHEMA = "vec_id long, embedding array<double>, label int, rank int, v string, score long"
ODD = [
    (10000, None, 1), (10100, [0.5, None], 1), (10200, [float("nan")], 1), (10300, [float("inf"), 0.0], 1), (None, [1.0, 1.0], 1), (10400, [], 1), (10500, [0.25], None), (10600, [0.0, 0.0], 2),
    (-100, [0.1, -0.2, 0.3], 3), (10700, [1e5, -1e5, 1.0], 3), (10800, [2.0**40, 2.0**41], 1), (10900, [1e30, -1e30], 2),
]


def frame(spark, items):
    return spark.createDataFrame([(i, None if e is None else [None if v is None else float(v) for v in e], lab, 7, "x", 1) for i, e, lab in items], SCHEMA)


def numbers(items, scale):
    """{id: list of whole numbers}, of the rows that take part."""
    out = {}
    for i, e, _ in items:
        if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e):
            out[i] = [min(max(int(np.floor(scale * float(x))), -(2**63)), 2**63 - 1) for x in e]
    return out


def dot(a, b):
    return min(max(sum(x * y for x, y in zip(a, b)), -(2**63)), 2**63 - 1)  # noqa: B905


def clustered(n, dim, centres, seed):
    rng = np.random.default_rng(seed)
    at = rng.normal(size=(centres, dim))
    return at[rng.integers(0, centres, n)] + rng.normal(size=(n, dim)) * 0.02


def plain_top(items, k, scale, asks):
    have = numbers(items, scale)
    out = []
    for q in have:
        if asks(q):
            best = sorted((-dot(have[q], have[i]), i) for i in have if i != q)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("kind", ["clustered", "random", "ties"])
def test_cover_tree_search_is_exact(spark, kind):
    rng = np.random.default_rng(3)
    x = {"clustered": clustered(1500, 3, 30, 1), "random": rng.normal(size=(1500, 24)), "ties": rng.integers(-1, 2, (1500, 3)) / 2}[kind]
    x[400:900] = x[400]  # a third are the same vector
    items = [(int(i) * 7 - 700, list(v), 0) for i, v in zip(rng.permutation(1500), x, strict=True)] + ODD
    df = frame(spark, items)
    got = cover_tree.search(df.unionByName(df.limit(200)), F.col("vec_id") % 100 == 0, k=10, scale=1024, groups=16, query_block=16, row_block=200)
    assert rows(got) == plain_top(items, 10, 1024, lambda i: i % 100 == 0)


def test_cover_tree_prunes_and_keeps_its_invariants():
    x = np.floor(1024 * clustered(6000, 3, 40, 2)).astype(np.int64)
    tree = cover_tree.build(x)
    seen = np.zeros(len(x), int)
    for n, kids in enumerate(tree.children):
        inside = tree.rows(n)
        far = np.sqrt(((x[inside] - x[tree.centre[n]]) ** 2).sum(axis=1))
        assert far.max() <= tree.radius[n] + 1e-6
        if len(kids):
            assert tree.centre[n] in tree.centre[kids]
            apart = cover_tree.distances(x[tree.centre[kids]].astype(float), x[tree.centre[kids]].astype(float))
            assert (apart[~np.eye(len(kids), dtype=bool)] > tree.radius[n] / 2).all()
            assert sorted(np.concatenate([tree.rows(k) for k in kids])) == sorted(inside)
        else:
            seen[inside] += 1
    assert (seen == 1).all() and len(tree.children) > 100
    ids = np.arange(len(x))
    done = cover_tree.Search(ids, x, ids[::5], x[::5], 10, np.full(1200, V.LEAST)).run()
    assert done.compared < 0.3 * 1200 * len(x)  # the bounds leave most pairs out


def test_searches_of_few_and_none(spark):
    df = frame(spark, [(0, [1.0], 0), (100, [1.0, 2.0], 0), (3, [0.5], 0)])
    got = rows(cover_tree.search(df, F.col("vec_id") % 100 == 0))
    assert got == [(0, 1, 100, 1024 * 1024), (0, 2, 3, 1024 * 512), (100, 1, 0, 1024 * 1024), (100, 2, 3, 1024 * 512)]
    for none in (df.where("false"), frame(spark, ODD[:5])):
        assert cover_tree.search(none, F.lit(True)).count() == 0
        assert negatives.mine(none, F.lit(True)).count() == 0
    assert cover_tree.search(df, F.lit(False)).count() == 0
    assert negatives.mine(df, F.lit(True)).count() == 0  # one label only


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 0, 2), (65, 64, 130), (100, 37, 41), (33, 200, 34)])
def test_strassen_is_exact(shape):
    m, k, n = shape
    rng = np.random.default_rng(4)
    for most in (5, 1 << 20, 1 << 28):
        a, b = rng.integers(-most, most, (m, k)), rng.integers(-most, most, (k, n))
        assert (negatives.strassen(a, b, 8) == a.astype(object) @ b.astype(object) if k else negatives.strassen(a, b, 8) == 0).all()
    wide = rng.integers(-(2**62), 2**62, (m, k)).astype(object)
    assert (negatives.strassen(wide, wide.T, 8) == (wide @ wide.T if k else 0)).all()


def plain_negatives(items, low=50, high=95):
    have = numbers([i for i in items if i[2] is not None], 256)
    label = {i: lab for i, _, lab in items}
    out = []
    for a in have:
        if a % 50 == 0:
            score = {i: dot(have[a], have[i]) for i in have if i != a}
            positives = sorted((i for i in score if label[i] == label[a]), key=lambda i: (-score[i], i))[:5]
            for p in positives:
                fit = [i for i in score if label[i] != label[a] and low * score[p] <= 100 * score[i] <= high * score[p]]
                out += [(a, p, r, i, score[p], score[i]) for r, i in enumerate(sorted(fit, key=lambda i: (-score[i], i))[:3], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("kind", ["clustered", "random", "ties"])
def test_hard_negatives_are_exact(spark, kind, monkeypatch):
    monkeypatch.setattr(negatives, "TILE", (48, 100))
    rng = np.random.default_rng(5)
    x = {"clustered": clustered(900, 4, 20, 6), "random": rng.normal(size=(900, 20)), "ties": rng.integers(-1, 2, (900, 3)) / 2}[kind]
    x[300:600] = x[300]
    labels = np.where(rng.random(900) < 0.4, 3, rng.integers(0, 6, 900))  # one hot label
    items = [(int(i) * 5 - 500, list(v), int(lab)) for i, v, lab in zip(rng.permutation(900), x, labels, strict=True)] + ODD
    df = frame(spark, items)
    got = negatives.mine(df.unionByName(df.limit(100)), F.col("vec_id") % 50 == 0, anchor_block=40, row_block=150)
    assert rows(got) == plain_negatives(items)


WORDS = [
    None, "", " \t\n", "one two", " ".join(f"w{i}" for i in range(60)), " ".join(["same word"] * 40), " ".join(f"W{i} X" for i in range(40)), "a#b " * 60,
    " ".join(f"é{i}" for i in range(49)), " ".join(f"é{i}" for i in range(50)), "AB " * 20 + "lower " * 80, "very long " * 20000, "SHORT & LOUD",
]


def plain_audit(docs, labels):
    import re

    def fails(i, text):
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        return (
            len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search(r"[#$%&*|]", text)),
            i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs),
        )

    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    held = {}
    for i, text, source in docs:
        held.setdefault(source or "", []).append((i, fails(i, text)))
    out = {}
    for part, own in held.items():
        for order in itertools.permutations(range(5)):
            left, gone = list(own), []
            for step, f in enumerate(order, 1):
                removed = [x for x in left if x[1][f]]
                left = [x for x in left if not x[1][f]]
                out[part, "".join("ABCDE"[o] for o in order), step] = [
                    len(left), len(removed), sum(x[1][f] for x in gone), sum(x[1][f] and sum(x[1]) == 1 for x in own),
                    sum(x[0] is not None and x[0] in good for x in removed), sum(x[0] is not None and x[0] in toxic for x in removed),
                ]
                gone += removed
    total = {}
    for (part, order, step), cells in out.items():
        total[part, order[step - 1]] = total.get((part, order[step - 1]), 0) + cells[1]
    return sorted(((part, order, step, *cells, total[part, order[step - 1]]) for (part, order, step), cells in out.items()), key=repr)


def test_audit_equals_a_walk_through_all_orders(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "CLASS_PART", 8)
    rng = np.random.default_rng(7)
    docs = [(int(i), WORDS[int(w)], [None, "", "src1", "src2"][int(s)]) for i, w, s in zip(rng.permutation(150), rng.integers(0, len(WORDS), 150), rng.integers(0, 4, 150), strict=True)]
    docs += [(None, WORDS[4], "src1"), (None, None, None)] + docs[:7] + [(docs[0][0], "another text of this id", "src3")] + [(i, WORDS[9], "hot") for i in range(1000, 1030)]
    labels = [(int(i), int(q), int(t)) for i, q, t in rng.integers(0, 2, (200, 3)) * [200, 1, 1] % [200, 2, 2]]
    labels = [(i, q, t) for i, (_, q, t) in enumerate(labels)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1), (5, None, None)]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, source string, row long, prefix string")
    of = spark.createDataFrame([(*x, "y") for x in labels], "doc_id long, quality int, toxic int, part string")
    got = filter_audit.audit(df, of)
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert rows(got, *names) == plain_audit(docs, labels)
    assert filter_audit.audit(df.where("false"), of).count() == 0
