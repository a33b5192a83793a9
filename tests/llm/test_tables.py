"""URL filters, vector search and the pipeline."""

import numpy as np
import pytest
from conftest import SMALL, rows
from pyspark.sql import functions as F

import corpus_pipeline
from tablewarden.llm import neighbours, url_filters
from tablewarden.llm.common import table
from tablewarden.llm.graph import components

URLS = [
    None, "", "no scheme", "http://", "http://A.Example.ORG/en/12?x#y", "https://example.org/es/", "https://notexample.org/es/", "x://a.com/de/1://b.org/", "http://a.com?q=/de/",
    "http://a.com/fr/?", "HTTP://ÄÖ.net/p", "http://spam.b.net/x", "http://net/", "http://example.org", "http://a.com/de/", "http://a.com/de/",
]


def test_url_rules(spark):
    from tablewarden.llm.queries import URL_RULES

    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumn("key", F.lit("clash"))
    got = url_filters.judge(df, URL_RULES, F.col("key").startswith("spam."))
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got.collect()}
    none = ("", "", None, "allow")
    assert found == {
        0: none, 1: none, 2: none, 3: none, 4: ("a.example.org", "/en/12", "example.org/en/1", "block"), 5: ("example.org", "/es/", "example.org/es/", "block"),
        6: ("notexample.org", "/es/", "org/", "allow"), 7: ("a.com", "/de/1://b.org/", "com/de/", "block"), 8: ("a.com", "", None, "allow"), 9: ("a.com", "/fr/", "com/fr/", "allow"),
        10: ("ÄÖ.net", "/p", None, "allow"), 11: ("spam.b.net", "/x", None, "block"), 12: ("net", "/", None, "allow"), 13: ("example.org", "", None, "allow"),
        14: ("a.com", "/de/", "com/de/", "block"), 15: ("a.com", "/de/", "com/de/", "block"),
    }
    assert url_filters.judge(df.where("false"), URL_RULES, F.lit(True)).count() == 0


@pytest.mark.parametrize("listed", ["id % 100 < 3", "id % 2 = 0", "false", "true", "id = 7"])
def test_cascade_is_exact(spark, listed):
    universe = spark.range(5000).selectExpr("concat('host', id) AS key", f"{listed} AS listed")
    cascade = url_filters.build_cascade(universe)
    assert universe.where(cascade.listed(F.col("key")) != F.col("listed")).count() == 0


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(5001, 5200)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = dict(rows(components(spark.createDataFrame(edges, "a long, b long"))))
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


VECTORS = "vec_id long, embedding array<float>, rank int"


def test_neighbours_reach_recall_and_order_ties(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 16)).astype("f4")
    x[200:900] = x[100]
    ids = rng.permutation(3000)
    odd = [(50000, None, 1), (50050, [], 1), (50100, [0.0] * 16, 1), (50150, [float("nan")] * 16, 1), (50200, [None] * 16, 1), (50250, [1.0, 2.0], 1), (None, [1.0] * 16, 1), (50300, [float("inf")] * 16, 1)]
    df = spark.createDataFrame([(int(i), v.tolist(), 0) for i, v in zip(ids, x, strict=True)] + odd, VECTORS)
    index = neighbours.build(df)
    got = neighbours.search(index, df.where("vec_id % 50 = 0")).toPandas()
    norm = np.linalg.norm(x.astype(float), axis=1)
    hits = wanted = 0
    asked = [i for i in range(3000) if ids[i] % 50 == 0]
    assert set(got["query_id"]) == {int(ids[i]) for i in asked}
    for i in asked:
        score = (x.astype(float) * x[i].astype(float)).sum(axis=1) / (norm * norm[i])
        order = [j for j in np.lexsort((ids, -score)) if j != i][:5]
        own = got[got["query_id"] == ids[i]].sort_values("rank")
        assert list(own["rank"]) == [1, 2, 3, 4, 5]
        hits += len(set(own["vec_id"]) & set(ids[order]))
        wanted += 5
        if 200 <= i < 900:
            assert list(own["vec_id"]) == sorted(j for j in [*ids[200:900], ids[100]] if j != ids[i])[:5]
        for v, s in zip(own["vec_id"], own["score"], strict=True):
            assert abs(s - score[np.flatnonzero(ids == v)[0]]) < 1e-12
    assert hits / wanted >= 0.9


def test_neighbours_of_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 0), (50, [1.0, 1.0], 0), (3, [0.0, 1.0], 0), (3, [0.0, 1.0], 0)], VECTORS)
    got = rows(neighbours.search(neighbours.build(df), df.where("vec_id % 50 = 0")), "query_id", "rank", "vec_id")
    assert got == [(0, 1, 50), (0, 2, 3), (50, 1, 0), (50, 2, 3)]
    none = df.where("false")
    assert neighbours.search(neighbours.build(none), none).count() == 0


def test_pipeline_stages_keep_columns(spark):
    docs = table(spark, SMALL, "documents")
    odd = spark.createDataFrame([(None, None, None, None, None), (10**7, "", "en", "src1", 0)], docs.schema)
    docs = docs.unionByName(odd).unionByName(docs.limit(1))
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        from tablewarden.llm.common import keep

        docs = keep(out, "test")
        assert 0 < docs.count() <= (before if name != "soft_mixing" else 2 * before), name
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert last.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert corpus_pipeline.STAGES[0][1](spark, docs.where("false"), SMALL).count() == 0


def test_pipeline_near_duplicates_have_five_word_similarity_of_080(spark):
    """Pairs just above 0.8 of five-word shingles and under 0.85 of four-word ones are one document; a pair just under 0.8 stays two."""
    base = [[f"{name}{i}" for i in range(500)] for name in "abc"]
    replaced = ["z" + w if i % 45 == 20 and i < 490 else w for i, w in enumerate(base[0])]  # 11 words
    longer = base[1] + [f"y{i}" for i in range(88)]
    apart = base[2] + [f"x{i}" for i in range(125)]
    texts = [base[0], replaced, base[1], longer, base[2], apart]

    def similarity(x, y, width):
        a, b = ({tuple(t[i : i + width]) for i in range(len(t) - width + 1)} for t in (x, y))
        return len(a & b) / len(a | b)

    assert 0.8 <= similarity(base[0], replaced, 5) < 0.81 and similarity(base[0], replaced, 4) < 0.85
    assert 0.8 <= similarity(base[1], longer, 5) < 0.85 and similarity(base[1], longer, 4) < 0.85
    assert 0.79 < similarity(base[2], apart, 5) < 0.8
    docs = spark.createDataFrame([(i, " ".join(t), "en", "src", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.ngram_jaccard_join(spark, docs, SMALL)
    assert sorted(r["doc_id"] for r in left.collect()) == [0, 2, 4, 5]
