"""The stored text index: changes by segments, searches and top-k against a plain dictionary of texts."""

import math
import random
import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tablewarden.operators import search, text_index

TEXTS = "doc bigint, part string, item string, text string"
VOCABULARY = ["alpha", "beta", "gamma", "delta", "rare", "un", "unit", "Ünder", "x1"]


def split(text):
    return [w for w in re.split(r"[^\w]|_", (text or "").lower()) if w]


def texts_of(spark, docs):
    return spark.createDataFrame([(d, p, "", t) for d, parts in docs.items() for p, t in parts.items()], TEXTS)


def some_docs(rnd, ids):
    make = lambda: " ".join(rnd.choices(VOCABULARY, [30, 20, 10, 5, 1, 5, 5, 3, 3], k=rnd.randrange(0, 40)))
    return {i: {"name": make(), "note": rnd.choice([None, "", make()])} for i in ids}


def flat_rows(docs):
    return sorted(((w, d, p, "", i) for d, parts in docs.items() for p, t in parts.items() for i, w in enumerate(split(t))), key=repr)


def plain_bm25(docs, terms):
    words = {d: [w for t in parts.values() for w in split(t)] for d, parts in docs.items()}
    words = {d: w for d, w in words.items() if w}
    mean = sum(map(len, words.values())) / len(words)
    out = {}
    for t in set(terms):
        df = sum(t in w for w in words.values())
        idf = max(math.log((len(words) - df + 0.5) / (df + 0.5)), search.MIN_IDF)
        for d, w in words.items():
            if t in w:
                tf = w.count(t)
                out[d] = out.get(d, 0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
    return sorted(((round(s, 9), d) for d, s in out.items()), key=lambda x: (-x[0], x[1]))


@pytest.fixture(scope="module")
def changed_index(spark):
    """An index after five rounds of edits, drops and additions, and the documents as they are then."""
    rnd = random.Random(5)
    docs = some_docs(rnd, [*range(0, 30000, 150), *range(500), -5, 2**40])
    index = text_index.build(texts_of(spark, docs))
    for n in range(5):
        edited = rnd.sample(sorted(docs), 4 if n % 2 else 12) + [100_001 + n]
        dropped = set(edited[:2])
        for d in edited:
            docs.pop(d, None)
        docs |= some_docs(rnd, [d for d in edited if d not in dropped])
        now = {d: docs[d] for d in edited if d in docs}
        index = text_index.refreshed(index, spark.createDataFrame([(d,) for d in edited], "doc bigint"), texts_of(spark, now))
    return index, docs


def test_changes_equal_a_rebuild(spark, changed_index):
    index, docs = changed_index
    names = ("term", "doc", "part", "item", "position")
    assert 1 < len(index.segments) < 6  # merged in part
    assert rows(index.flat(), *names) == flat_rows(docs)
    assert rows(text_index.merged(index, ratio=10**9).flat(), *names) == flat_rows(docs)
    assert rows(index.documents()) == sorted(((d, n) for d, parts in docs.items() if (n := sum(len(split(t)) for t in parts.values()))), key=repr)


def test_searches(spark, changed_index):
    index, docs = changed_index
    line = lambda d: [" " + " ".join(split(t)) + " " for t in docs[d].values()]
    cases = [
        (search.any_of(search.all_of(search.word("Alpha"), search.word("rare"))), lambda ls: any(" alpha " in x for x in ls) and any(" rare " in x for x in ls)),
        (search.any_of(search.phrase("beta gamma delta"), search.word("ünder")), lambda ls: any(" beta gamma delta " in x or " ünder " in x for x in ls)),
        (search.any_of(search.all_of(search.prefix("un"), search.phrase("alpha alpha"))), lambda ls: any(" un" in x for x in ls) and any(" alpha alpha " in x for x in ls)),
        (search.any_of(search.prefix("alpha un")), lambda ls: any(" alpha un" in x for x in ls)),
        (search.any_of(search.word("absent")), lambda ls: False),
    ]
    for query, holds in cases:
        assert rows(text_index.find(index, query)) == sorted(((d,) for d in docs if holds(line(d))), key=repr)


@pytest.mark.parametrize("terms", [["rare"], ["alpha", "rare", "x1"], ["absent"], ["alpha", "beta"]])
def test_ranking_and_top(spark, changed_index, terms):
    index, docs = changed_index
    want = plain_bm25(docs, terms)
    got = [(round(r["score"], 9), r["doc"]) for r in text_index.bm25(index, terms).collect()]
    assert sorted(got, key=lambda x: (-x[0], x[1])) == want
    top = [(round(r["score"], 9), r["doc"]) for r in text_index.top_bm25(index, terms, 7).collect()]
    assert sorted(top, key=lambda x: (-x[0], x[1])) == want[:7]


def test_top_reads_few_blocks(spark):
    docs = {d: {"name": "word " * (30 if d < 128 else 1) + "filler " * (30 if d >= 128 else 1)} for d in range(128 * 20)}
    docs |= {10_000 + d: {"name": "filler"} for d in range(3000)}
    index = text_index.build(texts_of(spark, docs))
    head = text_index.top_bm25(index, ["word"], 5)
    assert [r["doc"] for r in head.collect()] == [0, 1, 2, 3, 4]
    assert "LeftSemi" in head._jdf.queryExecution().optimizedPlan().toString()  # only blocks that may count are opened


def test_odd_texts(spark):
    df = spark.createDataFrame([(None, "a", "", "lost"), (1, None, None, "kept word"), (1, None, None, "kept word"), (2, "a", "", None), (3, "a", "", "...")], TEXTS)
    index = text_index.build(df)
    assert rows(index.flat(), "term", "doc", "position") == [("kept", 1, 0), ("kept", 1, 0), ("word", 1, 1), ("word", 1, 1)]
    empty = text_index.build(df.where("false"))
    assert empty.flat().count() == 0 and text_index.top_bm25(empty, ["kept"], 3).count() == 0 and text_index.find(empty, search.any_of(search.word("kept"))).count() == 0
    again = text_index.refreshed(empty, df.select("doc"), df)
    assert rows(again.flat(), "term", "doc") == [("kept", 1), ("kept", 1), ("word", 1), ("word", 1)]
    assert again.postings(["kept"]).select(F.col("bucket")).count() == 1
