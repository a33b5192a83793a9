"""Full-text search: an inverted index, structured boolean queries and BM25 ranking.

Words are runs of letters and digits of any script, in lower case; there is no stemming. A query is
given as clauses, not as text: ``any_of(all_of(word("sales"), phrase("daily report")), prefix("rev"))``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.session import settle

_BREAK = r"[^\p{L}\p{N}]+"
BM25_K1, BM25_B = 1.2, 0.75
MIN_IDF = 1e-6


def words(text: Column) -> Column:
    """The words of a text, in order."""
    return F.filter(F.split(F.lower(text), _BREAK), lambda w: w != "")


@dataclass(frozen=True)
class Atom:
    """One thing to find: a word, consecutive words, or a word beginning."""

    tokens: tuple[str, ...]
    is_prefix: bool = False


def _split(text: str) -> tuple[str, ...]:
    spaced = "".join(c if c.isalnum() else " " for c in text.lower())
    if not spaced.split():
        raise ValueError("search text holds no word")
    return tuple(spaced.split())


def word(text: str) -> Atom:
    """A word; text that splits into several is a phrase."""
    return Atom(_split(text))


phrase = word


def prefix(text: str) -> Atom:
    return Atom(_split(text), True)


def all_of(*atoms: Atom) -> tuple[Atom, ...]:
    return atoms


def any_of(*branches: tuple[Atom, ...] | Atom) -> list[tuple[Atom, ...]]:
    return [b if isinstance(b, tuple) else (b,) for b in branches]


def postings(docs: DataFrame, doc_id: str, columns: list[str]) -> DataFrame:
    """(term, doc, part, item, position): every word of every text column."""
    parts = [
        F.struct(F.lit(c).alias("part"), F.lit("").alias("item"), words(F.coalesce(F.col(c), F.lit(""))).alias("w")) for c in columns
    ]
    flat = docs.select(F.col(doc_id).alias("doc"), F.inline(F.array(*parts)))
    return flat.select("doc", "part", "item", F.posexplode("w").alias("position", "term"))


def item_postings(items: DataFrame, doc_id: str, part: str, column: str) -> DataFrame:
    """Postings of a child table, one item per row: phrases match inside an item, not across items."""
    flat = items.select(F.col(doc_id).alias("doc"), F.lit(part).alias("part"), F.col(column).alias("item"), words(F.col(column)).alias("w"))
    return flat.select("doc", "part", "item", F.posexplode("w").alias("position", "term"))


def catalog_index(datasets: DataFrame, fields: DataFrame, tags: DataFrame) -> DataFrame:
    """Index of all datasets over their own texts, tag names and field names."""
    own = postings(datasets, "id", ["name", "path", "domain", "owner", "description"])
    return own.unionByName(item_postings(tags, "dataset_id", "tags", "tag")).unionByName(
        item_postings(fields, "dataset_id", "fields", "name")
    )


def refresh_index(index: DataFrame, changed: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Index after the documents in ``changed`` (column ``doc``) were edited or dropped."""
    return index.join(changed, "doc", "left_anti").select(*rebuilt.columns).unionByName(rebuilt)


def term_counts(index: DataFrame) -> DataFrame:
    per_doc = index.groupBy("term", "doc").agg(F.count(F.lit(1)).alias("n"))
    return per_doc.groupBy("term").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("occurrences"))


def _fits(term: Column, token: str, is_prefix: bool) -> Column:
    return term.startswith(token) if is_prefix else term == F.lit(token)


def boolean_search(index: DataFrame, query: list[tuple[Atom, ...]]) -> DataFrame:
    """Documents that satisfy a query: some branch whose atoms are all found.

    Only postings of wanted terms leave the scan. A phrase is found where all its words give the same
    start position, counted by grouping instead of joining positions, so frequent words make no pairs.
    """
    atoms = list(dict.fromkeys(a for branch in query for a in branch))
    term, uses = F.col("term"), []
    for number, atom in enumerate(atoms):
        for offset, token in enumerate(atom.tokens):
            last = offset == len(atom.tokens) - 1
            use = F.struct(F.lit(number).alias("atom"), F.lit(offset).alias("offset"))
            uses.append((_fits(term, token, atom.is_prefix and last), use))
    wanted = reduce(lambda a, b: a | b, [cond for cond, _ in uses])
    hits = index.where(wanted).withColumn("use", F.explode(F.array_compact(F.array(*[F.when(c, u) for c, u in uses]))))
    lengths = F.element_at(F.array(*[F.lit(len(a.tokens)) for a in atoms]), F.col("atom") + 1)
    placed = hits.select("doc", "part", "item", (F.col("position") - F.col("use.offset")).alias("start"), "use.*").distinct()
    found = (
        placed.groupBy("doc", "part", "item", "start", "atom").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == lengths)
    )
    flags = [F.max(F.when(F.col("atom") == i, True)).alias(f"a{i}") for i in range(len(atoms))]
    per_doc = found.groupBy("doc").agg(*flags)
    branch = lambda b: reduce(lambda x, y: x & y, [F.coalesce(F.col(f"a{atoms.index(a)}"), F.lit(False)) for a in b])
    return per_doc.where(reduce(lambda x, y: x | y, [branch(b) for b in query])).select("doc")


def bm25(docs: DataFrame, doc_id: str, column: str, terms: list[str]) -> DataFrame:
    """Documents holding any of the terms, best first, with their BM25 score.

    Term frequencies are counted inside each document's word list, so the text is never exploded or shuffled. Lengths and
    frequencies are written once; the corpus statistics and the scores both come from them, so each text is split once.
    """
    terms = sorted(set(terms))
    tokens = F.col("_w")
    count = lambda t: F.size(F.filter(tokens, lambda w: w == F.lit(t)))
    counted = docs.select(F.col(doc_id).alias("doc"), words(F.col(column)).alias("_w")).select(
        "doc", F.size(tokens).alias("length"), *[count(t).alias(f"tf{i}") for i, t in enumerate(terms)]
    )
    counted = settle(counted, "term-counts")
    corpus = counted.agg(
        F.struct(
            F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean_length"),
            *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))],
        ).alias("c")
    ).scalar()
    scored = counted.where(reduce(lambda a, b: a | b, [F.col(f"tf{i}") > 0 for i in range(len(terms))])).withColumn("c", corpus)
    norm = BM25_K1 * (1 - BM25_B + BM25_B * F.col("length") / F.col("c.mean_length"))

    def part(i):
        df, tf = F.col(f"c.df{i}"), F.col(f"tf{i}")
        idf = F.greatest(F.ln((F.col("c.n") - df + 0.5) / (df + 0.5)), F.lit(MIN_IDF))
        return idf * tf * (BM25_K1 + 1) / (tf + norm)

    score = reduce(lambda a, b: a + b, [part(i) for i in range(len(terms))])
    return scored.select("doc", score.alias("score")).orderBy(F.desc("score"), "doc")


def filtered(found: DataFrame, datasets: DataFrame, domain: str) -> DataFrame:
    """Found datasets of one domain."""
    return datasets.where(F.col("domain") == domain).join(found.withColumnRenamed("doc", "id"), "id", "left_semi")
