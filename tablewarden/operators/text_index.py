"""A stored text index: segments of postings in the shared folder, changed by small segments with tombstones, merged by size.

Layout. A posting row is one term in one block of documents (``BLOCK_DOCS`` neighbouring ids): how many documents hold it there,
the largest number of occurrences, the shortest of these documents, and an entry for each document (occurrences, length
and places). Rows lie in folders by a hash of the term and are sorted by term, so a search reads the folders of its words, of
their files the row groups with its words, and of those only the columns it needs. Besides, a segment has its documents with
their lengths, and the ids that it replaces in the segments before it (its tombstones).

Changes (``refreshed``) read only the texts of changed documents. A search sees an entry unless a later segment replaces its
document. Segments are merged when the newest ones have grown to a part of those before them, from postings, not from texts.

Top-k (``top_bm25``) never reads the entries of most blocks: the largest count and the shortest length of a block bound each
score in it. The blocks with the highest bounds are scored first; of the others only those whose bound reaches the kth score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.operators.search import BM25_B, BM25_K1, MIN_IDF, Atom, words
from tablewarden.session import release, scratch_path, settle

BLOCK_DOCS = 128
LEAST_BUCKETS = 16
BUCKET_WORDS = 20_000_000
SPREAD = 4
MERGE_RATIO = 4
_CHUNK_WORDS = 500_000
_PLACE = "struct<part:string, item:string, positions:array<int>>"
POSTINGS = f"term string, block bigint, n bigint, max_tf bigint, min_length bigint, entries array<struct<doc:bigint, tf:bigint, length:bigint, places:array<{_PLACE}>>>, bucket int"


def text_rows(docs: DataFrame, doc_id: str, columns: list[str]) -> DataFrame:
    """(doc, part, item, text): the text columns of a table, one row each."""
    parts = [F.struct(F.lit(c).alias("part"), F.lit("").alias("item"), F.col(c).alias("text")) for c in columns]
    return docs.select(F.col(doc_id).cast("bigint").alias("doc"), F.inline(F.array(*parts)))


def item_rows(items: DataFrame, doc_id: str, part: str, column: str) -> DataFrame:
    """(doc, part, item, text) of a child table, one item per row."""
    return items.select(F.col(doc_id).cast("bigint").alias("doc"), F.lit(part).alias("part"), F.col(column).alias("item"), F.col(column).alias("text"))


def catalog_texts(datasets: DataFrame, fields: DataFrame, tags: DataFrame) -> DataFrame:
    """What is indexed of each dataset: its own texts, tag names and field names."""
    own = text_rows(datasets, "id", ["name", "path", "domain", "owner", "description"])
    return own.unionByName(item_rows(tags, "dataset_id", "tags", "tag")).unionByName(item_rows(fields, "dataset_id", "fields", "name"))


@dataclass(frozen=True)
class Segment:
    """One part of an index: a folder with ``postings``, ``docs`` and ``replaced``."""

    number: int
    path: str
    rows: int
    buckets: int
    replaces: bool


@dataclass(frozen=True)
class TextIndex:
    """An index as it is after some changes; older states stay readable."""

    spark: SparkSession
    segments: tuple[Segment, ...]

    def _union(self, kind: str, schema: str | None = None) -> DataFrame:
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        parts = [reader.parquet(f"{s.path}/{kind}").withColumn("segment", F.lit(s.number)) for s in self.segments]
        return reduce(DataFrame.unionByName, parts)

    def _replaced(self) -> DataFrame | None:
        """(doc, since): the newest segment that replaces each changed document."""
        later = [s for s in self.segments if s.replaces]
        if not later:
            return None
        parts = [self.spark.read.schema("doc bigint").parquet(f"{s.path}/replaced").withColumn("since", F.lit(s.number)) for s in later]
        return reduce(DataFrame.unionByName, parts).groupBy(F.col("doc").alias("gone")).agg(F.max("since").alias("since"))

    def _live(self, rows: DataFrame) -> DataFrame:
        gone = self._replaced()
        if gone is not None:
            rows = rows.join(gone, (F.col("doc") == F.col("gone")) & (F.col("segment") < F.col("since")), "left_anti")
        return rows.drop("segment")

    def postings(self, tokens: list[str] | None = None, prefixes: list[str] = ()) -> DataFrame:
        """Posting rows of the given words and word beginnings, of all if neither is given; replaced documents are still in them."""
        rows = self._union("postings", POSTINGS)
        if tokens is None:
            return rows
        wanted = [F.col("term").isin(tokens)] if tokens else []
        wanted += [F.col("term").startswith(p) for p in prefixes]
        if not prefixes:  # the folders are known only for whole words
            asked = self.spark.createDataFrame([(t,) for t in tokens], "term string")
            kinds = sorted({s.buckets for s in self.segments})
            numbers = sorted({n for r in asked.select(F.array(*[_bucket(k) for k in kinds])).collect() for n in r[0]})
            rows = rows.where(F.col("bucket").isin(numbers))
        return rows.where(reduce(lambda a, b: a | b, wanted))

    def entries(self, postings: DataFrame, *names: str) -> DataFrame:
        """(term, doc, names ...) of the documents that are not replaced."""
        flat = postings.select("segment", "term", F.explode("entries").alias("e"))
        return self._live(flat.select("segment", "term", "e.doc", *[f"e.{n}" for n in names]))

    def flat(self) -> DataFrame:
        """(term, doc, part, item, position): the whole index, place by place."""
        return self.entries(self.postings(), "places").select("term", "doc", F.inline("places")).select("term", "doc", "part", "item", F.explode("positions").alias("position"))

    def documents(self) -> DataFrame:
        """(doc, length) of the documents with words."""
        return self._live(self._union("docs", "doc bigint, length bigint"))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


def _buckets(words: int) -> int:
    """Folders for that many words: their number doubles with the index, so each stays a few files."""
    return max(LEAST_BUCKETS, 1 << max(0, (words // BUCKET_WORDS).bit_length()))


def _by_word(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of each text with their positions, in chunks of whole texts."""
    for batch in batches:
        sizes = np.diff(np.asarray(batch.column("w").offsets)) if len(batch) else np.zeros(0, np.int64)
        chunk = np.cumsum(sizes) // _CHUNK_WORDS
        for a, z in zip(first := np.flatnonzero(np.diff(chunk, prepend=-1)), [*first[1:], len(sizes)], strict=True):
            part = batch.slice(a, z - a)
            own = sizes[a:z]
            codes = part.column("w").flatten().dictionary_encode()
            if not len(codes):
                continue
            row = np.repeat(np.arange(z - a), own)
            position = (np.arange(len(row)) - np.repeat(np.cumsum(own) - own, own)).astype(np.int32)
            code = codes.indices.to_numpy()
            order = np.lexsort((code, row))  # stable, so positions stay in order
            row, code = row[order], code[order]
            head = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (code[1:] != code[:-1])]))
            lists = pa.ListArray.from_arrays(pa.array(np.append(head, len(row)), pa.int32()), pa.array(position[order]))
            at = pa.array(row[head])
            columns = [codes.dictionary.take(pa.array(code[head])), *(part.column(c).take(at) for c in ("doc", "part", "item", "length")), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["term", "doc", "part", "item", "length", "positions"])


def _write_postings(entries: DataFrame, path: str, buckets: int, by_text: bool) -> int:
    """Entries of texts, or of whole documents, grouped by term and block and written; the number of posting rows.

    One shuffle deals them by folder, and by block too, as a frequent word has a row for every block; the groupings keep to it.
    """
    keys = ["bucket", "spread", "term", "block"]
    block = F.floor(F.col("doc") / BLOCK_DOCS).cast("bigint")
    placed = entries.withColumns({"bucket": _bucket(buckets), "block": block, "spread": F.pmod(block, F.lit(SPREAD))}).repartition(buckets * SPREAD, "bucket", "spread")
    if by_text:
        own = F.struct("part", "item", "positions")
        placed = placed.groupBy(*keys, "doc").agg(F.sum(F.size("positions")).alias("tf"), F.first("length").alias("length"), F.collect_list(own).alias("places"))
    grouped = placed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.max("tf").alias("max_tf"), F.min("length").alias("min_length"), F.sort_array(F.collect_list(F.struct("doc", "tf", "length", "places"))).alias("entries")
    )
    spark, sorting = entries.sparkSession, "spark.sql.execution.useObjectHashAggregateExec"
    before = spark.conf.get(sorting)
    spark.conf.set(sorting, "false")  # one sort serves both groupings and the files
    try:
        grouped.drop("spread").sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(f"{path}/postings")
    finally:
        spark.conf.set(sorting, before)
    return spark.read.schema(POSTINGS).parquet(f"{path}/postings").count()


def _write_segment(texts: DataFrame, number: int, replaced: DataFrame | None) -> Segment:
    spark = texts.sparkSession
    path = scratch_path(spark, f"segment-{number}")
    plain = [F.coalesce(c, F.lit("")).alias(c) for c in ("part", "item")]
    # texts are dealt evenly, however few files or documents they come from; words are split twice, so that only texts are dealt and none are kept
    known = texts.where("doc is not null").select("doc", *plain, F.coalesce("text", F.lit("")).alias("text"))
    dealt = known.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc", "part", "item")
    dealt.select("doc", F.size(words(F.col("text"))).alias("n")).groupBy("doc").agg(F.sum("n").alias("length")).where("length > 0").write.parquet(f"{path}/docs")
    release(spark)
    lengths = spark.read.schema("doc bigint, length bigint").parquet(f"{path}/docs")
    total = lengths.agg(F.sum("length")).first()[0] or 0
    split = known.join(lengths.hint("merge"), "doc").select("doc", "part", "item", "length", words(F.col("text")).alias("w"))
    by_text = split.mapInArrow(_by_word, "term string, doc bigint, part string, item string, length bigint, positions array<int>")
    rows = _write_postings(by_text, path, _buckets(total), True)
    release(spark)
    if replaced is not None:
        replaced.select(F.col("doc").cast("bigint").alias("doc")).where("doc is not null").distinct().write.parquet(f"{path}/replaced")
    return Segment(number, path, rows, _buckets(total), replaced is not None)


def build(texts: DataFrame) -> TextIndex:
    """The index of (doc, part, item, text); rows without a doc are left out, null texts have no words."""
    return TextIndex(texts.sparkSession, (_write_segment(texts, 0, None),))


def refreshed(index: TextIndex, changed: DataFrame, texts: DataFrame) -> TextIndex:
    """The index after the documents in ``changed`` (column doc) were edited, added or dropped; ``texts`` are what they hold now."""
    number = index.segments[-1].number + 1
    return merged(replace(index, segments=(*index.segments, _write_segment(texts, number, changed))))


def merged(index: TextIndex, ratio: int = MERGE_RATIO) -> TextIndex:
    """Merge the newest segments while the one before them has fewer than ``ratio`` times their rows, so there are few at any size."""
    first, rows = len(index.segments) - 1, index.segments[-1].rows
    while first and index.segments[first - 1].rows < ratio * rows:
        first -= 1
        rows += index.segments[first].rows
    if first == len(index.segments) - 1:
        return index
    part, spark = replace(index, segments=index.segments[first:]), index.spark
    number = part.segments[-1].number
    path = scratch_path(spark, f"segment-{number}-merged")
    part.documents().write.parquet(f"{path}/docs")
    buckets = max(s.buckets for s in part.segments)
    count = _write_postings(part.entries(part.postings(), "tf", "length", "places"), path, buckets, False)
    replaces = any(s.replaces for s in part.segments)
    if replaces and first:  # what they replaced may still be in the segments before them
        part._replaced().select(F.col("gone").alias("doc")).write.parquet(f"{path}/replaced")
    return replace(index, segments=(*index.segments[:first], Segment(number, path, count, buckets, bool(replaces and first))))


def _fits(token: str, is_prefix: bool) -> Column:
    return F.col("term").startswith(token) if is_prefix else F.col("term") == F.lit(token)


def _starts(offset: int) -> Column:
    """Where phrases begin whose word at ``offset`` stands at the places of an entry."""
    one = lambda p: F.transform(p["positions"], lambda x: F.struct(p["part"].alias("part"), p["item"].alias("item"), (x - offset).alias("start")))
    return F.flatten(F.transform("places", one))


def find(index: TextIndex, query: list[tuple[Atom, ...]]) -> DataFrame:
    """(doc) of the documents that satisfy a query: some branch whose atoms are all found.

    An entry is one document's, so words are flags of a grouping by document. For phrases the places of their words are shifted to
    a common start and intersected inside the document; single words read no places.
    """
    atoms = list(dict.fromkeys(a for branch in query for a in branch))
    uses = [(a, i, t, a.is_prefix and i == len(a.tokens) - 1) for a in atoms for i, t in enumerate(a.tokens)]
    postings = index.postings(sorted({t for _, _, t, p in uses if not p}), sorted({t for _, _, t, p in uses if p}))
    phrases = any(len(a.tokens) > 1 for a in atoms)
    entries = index.entries(postings, *(["places"] if phrases else []))
    found = []
    for n, a in enumerate(atoms):
        for i, t in enumerate(a.tokens):
            fits = _fits(t, a.is_prefix and i == len(a.tokens) - 1)
            if len(a.tokens) == 1:
                found.append(F.max(F.when(fits, True)).alias(f"a{n}"))
            else:
                found.append(F.flatten(F.collect_list(F.when(fits, _starts(i)))).alias(f"s{n}_{i}"))
    by_doc = entries.groupBy("doc").agg(*found)

    def flag(a: Atom) -> Column:
        n = atoms.index(a)
        if len(a.tokens) == 1:
            return F.coalesce(F.col(f"a{n}"), F.lit(False))
        return F.size(reduce(F.array_intersect, [F.col(f"s{n}_{i}") for i in range(len(a.tokens))])) > 0

    branches = [reduce(lambda x, y: x & y, [flag(a) for a in b]) for b in query]
    return by_doc.where(reduce(lambda x, y: x | y, branches)).select("doc")


def _corpus(index: TextIndex, terms: list[str]) -> tuple[int, float, dict[str, int]]:
    """(documents, mean length, documents with each term): some numbers, from lengths and block heads.

    Replaced documents are taken off by the blocks they may be in, whose entries alone are read.
    """
    n, mean = index.documents().agg(F.count(F.lit(1)), F.avg("length")).first()
    heads = index.postings(terms)
    held = {r["term"]: r["n"] for r in heads.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    gone = index._replaced()
    if gone is not None:
        blocks = gone.select(F.floor(F.col("gone") / BLOCK_DOCS).cast("bigint").alias("block")).distinct()
        touched = heads.join(blocks, "block", "left_semi").select("segment", "term", F.explode("entries.doc").alias("doc"))
        dead = touched.join(gone, (F.col("doc") == F.col("gone")) & (F.col("segment") < F.col("since")), "left_semi")
        for r in dead.groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect():
            held[r["term"]] -= r["n"]
    return n, mean or 1.0, {t: held.get(t, 0) for t in terms}


def _term_score(tf: Column, length: Column, idf: Column, mean: float) -> Column:
    return idf * tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * length / mean))


def _idf(n: int, df: dict[str, int]) -> Column:
    """The weight of each term, as a column of ``term``."""
    weight = lambda d: F.greatest(F.ln((F.lit(float(n)) - d + 0.5) / (F.lit(float(d)) + 0.5)), F.lit(MIN_IDF))
    return reduce(lambda c, t: c.when(F.col("term") == t, weight(df[t])), sorted(df), F.when(F.lit(False), F.lit(0.0)))


def _scores(index: TextIndex, postings: DataFrame, idf: Column, mean: float) -> DataFrame:
    entries = index.entries(postings, "tf", "length")
    return entries.groupBy("doc").agg(F.sum(_term_score(F.col("tf"), F.col("length"), idf, mean)).alias("score"))


def bm25(index: TextIndex, terms: list[str]) -> DataFrame:
    """(doc, score) of all documents that hold any of the words, best first."""
    terms = sorted(set(terms))
    n, mean, df = _corpus(index, terms)
    return _scores(index, index.postings(terms), _idf(n, df), mean).orderBy(F.desc("score"), "doc")


def top_bm25(index: TextIndex, terms: list[str], k: int) -> DataFrame:
    """(doc, score) of the ``k`` best documents, ties by smaller doc; the same as the head of ``bm25``."""
    terms = sorted(set(terms))
    n, mean, df = _corpus(index, terms)
    idf, postings = _idf(n, df), index.postings(terms)
    most = _term_score(F.col("max_tf"), F.col("min_length"), idf, mean)
    # of several segments a document is live in one only, so the highest of a term's bounds holds for a block
    heads = postings.groupBy("block", "term").agg(F.max(most).alias("most"), F.sum("n").alias("n"))
    blocks = settle(heads.groupBy("block").agg((F.sum("most") * (1 + 1e-9)).alias("most"), F.max("n").alias("n")), "block-bounds")
    first = blocks.orderBy(F.desc("most"), "block").limit(max(4, 4 * k // BLOCK_DOCS))
    head = _scores(index, postings.join(F.broadcast(first.select("block")), "block", "left_semi"), idf, mean).orderBy(F.desc("score"), "doc").limit(k).collect()
    least = head[-1]["score"] if len(head) == k else float("-inf")
    some = postings.join(blocks.where(F.col("most") >= F.lit(least)).select("block"), "block", "left_semi")
    return _scores(index, some, idf, mean).orderBy(F.desc("score"), "doc").limit(k)
