"""Search queries over the driver's documents and the derived catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewarden.operators import search as ops
from tablewarden.operators import text_index
from tablewarden.plans.registry import query

_built: dict[tuple, text_index.TextIndex] = {}


def _stored(v, name: str, texts) -> text_index.TextIndex:
    """The stored index of a folder's tables: built by the first search that needs it, read by all after it."""
    files = tuple(sorted(f for t in ("part", "lineitem", "documents") for f in v.table(t).inputFiles()))
    key = (v.spark.sparkContext.applicationId, name, files)
    if key not in _built:
        _built[key] = text_index.build(texts())
    return _built[key]


def catalog_index(v) -> text_index.TextIndex:
    return _stored(v, "catalog", lambda: text_index.catalog_texts(v.datasets, v.fields, v.tags))


def document_index(v) -> text_index.TextIndex:
    return _stored(v, "documents", lambda: text_index.text_rows(v.documents, "doc_id", ["text"]))

_W = "list_filter(regexp_split_to_array(lower({c}), '[^\\pL\\pN]+'), lambda x: x <> '')"


def _words(column: str) -> str:
    return _W.replace("{c}", f"coalesce({column}, '')")


_TEXTS = ("name", "path", "domain", "owner", "description")


def _postings(source: str, doc: str, column: str, part: str, item: str = "''") -> str:
    """Postings of one text column: every word with its place."""
    return f"""SELECT doc, '{part}' AS part, item, CAST(unnest(range(len(w))) AS INT) AS position, unnest(w) AS term
      FROM (SELECT {doc} AS doc, {item} AS item, {_words(column)} AS w FROM {source})"""


def _catalog_sql(datasets: str) -> str:
    return " UNION ALL ".join(
        [_postings(datasets, "id", c, c) for c in _TEXTS] + [_postings("{tags}", "dataset_id", "tag", "tags", "tag"), _postings("{fields}", "dataset_id", "name", "fields", "name")]
    )


@query("search_index", _catalog_sql("{datasets}"))
def search_index(v):
    return catalog_index(v).flat()


@query("search_index_documents", _postings("{documents}", "doc_id", "text", "text"))
def search_index_documents(v):
    return document_index(v).flat()


# three rounds of edits: datasets renamed; fields of some datasets renamed and others dropped; tags added, and some datasets dropped
_EDITED = """(SELECT * REPLACE (CASE WHEN domain IS NULL THEN 'renamed_' || id ELSE name END AS name) FROM {datasets} WHERE id % 7 <> 3)"""
_EDITED_FIELDS = """(SELECT * REPLACE (CASE WHEN dataset_id % 6 = 1 THEN name || '_old' ELSE name END AS name) FROM {fields}
  WHERE dataset_id % 7 <> 3 AND NOT (dataset_id % 6 = 2 AND name = 'amount'))"""
_EDITED_TAGS = """(SELECT dataset_id, tag FROM {tags} WHERE dataset_id % 7 <> 3 UNION ALL
  SELECT id AS dataset_id, 'fresh:added' AS tag FROM {datasets} WHERE id % 7 <> 3 AND id % 5 = 0)"""


@query(
    "search_index_refresh",
    " UNION ALL ".join(
        [_postings(_EDITED, "id", c, c) for c in _TEXTS] + [_postings(_EDITED_TAGS, "dataset_id", "tag", "tags", "tag"), _postings(_EDITED_FIELDS, "dataset_id", "name", "fields", "name")]
    ),
)
def search_index_refresh(v):
    """The stored index after three rounds of edits, each of which reads and writes the changed datasets only."""
    index = catalog_index(v)
    datasets, fields, tags = v.datasets, v.fields, v.tags

    def after(changed):
        ids = changed.select(F.col("id").alias("dataset_id")).distinct()
        of = lambda df, key: df.join(ids.withColumnRenamed("dataset_id", key), key, "left_semi")
        texts = text_index.catalog_texts(of(datasets, "id"), of(fields, "dataset_id"), of(tags, "dataset_id"))
        return text_index.refreshed(index, ids.withColumnRenamed("dataset_id", "doc"), texts)

    datasets = datasets.withColumn("name", F.when(F.col("domain").isNull(), F.concat(F.lit("renamed_"), F.col("id").cast("string"))).otherwise(F.col("name")))
    index = after(datasets.where("domain IS NULL"))
    fields = fields.where("NOT (dataset_id % 6 = 2 AND name = 'amount')")
    fields = fields.withColumn("name", F.when(F.expr("dataset_id % 6 = 1"), F.concat("name", F.lit("_old"))).otherwise(F.col("name")))
    index = after(datasets.where("id % 6 IN (1, 2)"))
    tags = tags.select("dataset_id", "tag").unionByName(datasets.where("id % 5 = 0").select(F.col("id").alias("dataset_id"), F.lit("fresh:added").alias("tag")))
    changed = datasets.where("id % 7 = 3 OR id % 5 = 0")
    datasets, fields, tags = (df.where(f"{k} % 7 <> 3") for df, k in ((datasets, "id"), (fields, "dataset_id"), (tags, "dataset_id")))
    return after(changed).flat()


_LINE = f"' ' || array_to_string({_words('text')}, ' ') || ' '"


def _doc_search(cond: str) -> str:
    return f"SELECT doc_id AS doc FROM (SELECT doc_id, {_LINE} AS t FROM {{documents}}) d WHERE {cond}"


@query(
    "search_boolean",
    _doc_search("(contains(t, ' the ') AND contains(t, ' of ')) OR contains(t, ' que la ') OR (contains(t, ' un') AND contains(t, ' les '))"),
)
def search_boolean(v):
    wanted = ops.any_of(
        ops.all_of(ops.word("The"), ops.word("of")), ops.phrase("que la"), ops.all_of(ops.prefix("un"), ops.word("les"))
    )
    return text_index.find(document_index(v), wanted)


@query("search_phrase", _doc_search("contains(t, ' of the ')"))
def search_phrase(v):
    return text_index.find(document_index(v), ops.any_of(ops.phrase("of the")))


_TERMS = ["the", "la", "und", "email"]


def _bm25_sql(terms: list[str], top: int | None = None) -> str:
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(sorted(terms)))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(terms)))
    part = " + ".join(
        f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * length / mean))"
        for i in range(len(terms))
    )
    some = " OR ".join(f"tf{i} > 0" for i in range(len(terms)))
    head = f" ORDER BY {part} DESC, doc_id LIMIT {top}" if top else ""
    return f"""
    WITH counted AS (SELECT doc_id, len(w) AS length, {tf} FROM (SELECT doc_id, {_words('text')} AS w FROM {{documents}}) d),
    corpus AS (SELECT count(*) AS n, avg(length) AS mean, {df} FROM counted)
    SELECT doc_id AS doc, CAST(round({part}, 6) AS DOUBLE) AS score FROM counted, corpus WHERE {some}{head}"""


@query("search_bm25", _bm25_sql(_TERMS))
def search_bm25(v):
    return text_index.bm25(document_index(v), _TERMS).withColumn("score", F.round("score", 6))


_RARE = ["email", "und", "password"]
_TOP = 25


@query("search_top", _bm25_sql(_RARE, _TOP))
def search_top(v):
    """The best documents for some words: most blocks of the index are left out by their bounds."""
    return text_index.top_bm25(document_index(v), _RARE, _TOP).withColumn("score", F.round("score", 6))


@query(
    "search_filtered",
    f"""SELECT * FROM {{datasets}} WHERE domain = 'Brand#3' AND id IN (
      SELECT doc FROM ({_catalog_sql('{datasets}')}) p WHERE term IN ('bolt', 'returned') OR starts_with(term, 'ssn'))""",
)
def search_filtered(v):
    found = text_index.find(catalog_index(v), ops.any_of(ops.word("bolt"), ops.word("returned"), ops.prefix("ssn")))
    return ops.filtered(found, v.datasets, "Brand#3")
