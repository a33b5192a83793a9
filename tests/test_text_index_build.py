"""What building a text index leaves on disk."""

from conftest import rows

from tablewarden.operators import text_index


def test_words_are_not_kept_beside_the_postings(spark, monkeypatch):
    """Only postings, lengths and replaced ids are written; the lengths are of whole documents, whatever their parts."""
    kept = []
    monkeypatch.setattr(text_index, "settle", lambda df, label: kept.append(label) or df)
    texts = [(1, "a", "", "one two"), (1, "b", "x", "two"), (1, None, None, None), (2, "a", "", ""), (3, "a", "", "two two"), (None, "a", "", "one"), (3, "a", "", "two two")]
    index = text_index.build(spark.createDataFrame(texts, "doc bigint, part string, item string, text string"))
    assert kept == []
    assert rows(index.documents(), "doc", "length") == [(1, 3), (3, 4)]
    assert rows(index.entries(index.postings(["two"]), "tf", "length"), "doc", "tf", "length") == [(1, 2, 3), (3, 4, 4)]
