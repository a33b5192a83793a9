"""Mixing documents to target domain weights by soft membership.

A Bernoulli naive Bayes classifier learnt from a labelled table gives each document a posterior over the domains. Document i, of n_i
tokens and posterior p_i, is to be used r_i >= 0 times, and the expected tokens of domain k, T_k = sum n_i r_i p_ik, are
to meet targets t_k. Projected gradient on the rates, from 1 for each document, minimises the sum of (T_k - t_k)^2 / s_k, with
s_k = sum n_i p_ik: each step moves document i by - sum_k p_ik (T_k - t_k) / s_k, and rates below 0 are set to 0. Steps add up
before the projection (lazy projection), so the rates are always r_i = max(0, 1 - sum_k p_ik c_k), K numbers c_k say all of them, and a step
is one aggregation of K sums over the kept table of posteriors. Steps are accelerated by momentum and go on until the targets are
met, or the error stops falling, as it does where no rates meet the targets. A weak pull to c = 0 (``PULL``) keeps the numbers
finite there. The gap that remains is kept with the model, and a gap of more than ``TOLERANCE`` of all tokens is warned of.

Tokens are words (runs without white space). The classifier is learnt from at most about ``FIT_ROWS`` labelled documents,
chosen by a hash of their id, over lower-case words. Near duplicates among them (five-word shingles, Jaccard similarity
of 0.8 or more) count once, as the document with the smallest id, so the words of a group of copies tell no more than
those of one document. Words that tell little (log odds under ``LEAST_ODDS``, or shares of documents closer than
``LEAST_SPREADS`` standard errors, or likelihood ratios under those of that many, as standard errors are too small for rare words)
count nothing; as words go together, the lack of all of a domain's words counts ``ABSENT`` at most.

Null and empty texts have no tokens, prior posteriors, and rate like others; so do rows without an id, and repeated rows rate and are
copied alike. Columns of the input stay inside ``doc`` under their own names, so they clash with nothing; an empty table gives an
empty one. Without labels every document has rate 1. Everything is DataFrame functions.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewarden.llm.common import keep
from tablewarden.llm.graph import components

FIT_ROWS = 4000
LEAST_ODDS = 1.5
LEAST_SPREADS = 5.0
NEAR_PERCENT = 80
NEAR_WIDTH = 5
ABSENT = 4.0
STEPS = 400
PATIENCE = 60
LEAST_LIVE = 0.05
TOLERANCE = 1e-4
EXACT = 1e-6
PULL = 1e-8
SPACES = r"[\x20\x09-\x0D]+"


def words(text: str) -> Column:
    """The words of a column, in lower case; none for null."""
    # space at an end of the text leaves an empty part there
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(f"`{text}`"), F.lit(""))), SPACES), "")


def distinct_hashes(found: Column) -> Column:
    """Hashes of the distinct words of an array."""
    return F.array_distinct(F.transform(found, lambda w: F.xxhash64(w)))


def _literal(values: list, kind: str) -> Column:
    """An array that the optimizer folds to one literal; empty strings are null."""
    return F.split(F.lit(",".join(map(str, values))), ",").try_cast(f"array<{kind}>")


@dataclass
class Classifier:
    """Domains with log priors (and what no word at all tells), and the words that tell: their hashes ordered by slot (the hash
    modulo the number of slots), where each slot's words begin (one entry more than slots), and for each domain but the first
    the words' log odds. ``gaps``: how far the mixture solved with it is over or under its targets, in shares of all tokens."""

    domains: list[str]
    priors: list[float]
    words: list[int]
    begins: list[int]
    odds: list[list[float]]
    gaps: dict[str, float] = field(default_factory=dict)

    def places(self, hashed: Column) -> Column:
        """Where in ``words`` the distinct ones of an array of word hashes stand that tell."""
        if not self.words:
            return F.array().cast("array<int>")
        slots = F.lit(len(self.begins) - 1)
        alone = [a if z - a == 1 else "" for a, z in zip(self.begins, self.begins[1:])]  # so most words need one look
        own, only, begins = _literal(self.words, "bigint"), _literal(alone, "int"), _literal(self.begins, "int")
        slot = lambda h: F.pmod(h, slots).cast("int")
        begin, end = lambda h: F.get(begins, slot(h)), lambda h: F.get(begins, slot(h) + 1)
        among = lambda h: begin(h) + F.array_position(F.slice(own, begin(h) + 1, end(h) - begin(h)), h) - 1
        return F.transform(F.array_intersect(own, hashed), lambda h: F.coalesce(F.get(only, slot(h)), among(h)).cast("int"))

    def logs_at(self, places: Column) -> Column:
        """Log posteriors, but for a common term, of the domains for an array of places; each domain reads it, so it should be a column."""
        logs = [F.lit(self.priors[0])]
        for k, prior in enumerate(self.priors[1:]):
            logs.append(F.lit(prior) + _sum_of(_literal([f"{x:.6g}" for x in self.odds[k]], "double"), places) if self.words else F.lit(prior))
        return F.array(*logs)

    def logs(self, hashed: Column) -> Column:
        """As ``logs_at``, for an array of word hashes."""
        return self.logs_at(self.places(hashed))


def _sum_of(table: Column, slots: Column) -> Column:
    return F.aggregate(slots, F.lit(0.0), lambda s, b: s + F.get(table, b))


def shingles(found: Column, width: int = NEAR_WIDTH) -> Column:
    """Hashes of the distinct runs of ``width`` words of an array; the words of a shorter one are together its one run."""
    last = F.greatest(F.size(found) - width, F.lit(0))
    runs = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.slice(found, i + 1, width)))
    return F.when(F.size(found) > 0, F.array_distinct(runs)).otherwise(F.array().cast("array<bigint>"))


def near_classes(sets: DataFrame, percent: int = NEAR_PERCENT) -> DataFrame:
    """(node, component) of the nodes that are linked with another one, for (node, set) with one row a node.

    Of two linked sets, each one's rarest shingles but ``percent`` of its size hold one of the other's. Sets are first compared
    with the smallest node at each of those shingles, and then with all others there that these links leave apart.
    """
    single = sets.select("node", F.size("set").alias("n"), F.explode("set").alias("item"))
    often = single.groupBy("item").agg(F.count("*").alias("times")).where("times > 1")
    # a shingle of one set alone meets nothing, but comes first in its set
    ranked = single.join(often, "item", "left").withColumn("times", F.coalesce("times", F.lit(1)))
    ranked = ranked.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy("times", "item")))
    rare = keep(ranked.where(F.expr(f"times > 1 and place <= n - ({percent} * n + 99) div 100 + 1")).select("item", "node"), "rare-shingles")

    def linked(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
        common = F.size(F.array_intersect("x", "y"))
        return keep(both.where(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b"), "near")

    heads = rare.groupBy("item").agg(F.min("node").alias("a"))
    first = linked(rare.join(heads, "item").where("node > a").select("a", F.col("node").alias("b")).distinct())
    found = keep(components(first), "near-classes")
    pairs = rare.select("item", F.col("node").alias("a")).join(rare.select("item", F.col("node").alias("b")), "item").where("a < b").select("a", "b").distinct()
    for side in ("a", "b"):
        pairs = pairs.join(found.select(F.col("node").alias(side), F.col("component").alias(f"c{side}")), side, "left")
    rest = linked(pairs.where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b"))
    return found if rest.isEmpty() else components(first.unionByName(rest))


def one_of_each_class(labelled: DataFrame) -> DataFrame:
    """(domain, words) for (doc_id, domain, text): of near duplicates the document with the smallest id, and one without words."""
    split = labelled.withColumn("__w", words("text")).select("doc_id", "domain", distinct_hashes(F.col("__w")).alias("words"), shingles(F.col("__w")).alias("set"))
    split = split.withColumn("node", F.xxhash64(F.array_sort("set")))
    rows = keep(split.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min_by(F.struct("domain", "words", "set"), "doc_id").alias("row")), "labelled")
    classes = near_classes(rows.select("node", "row.set").where("size(set) > 0"))
    of_node = rows.select("node", "doc_id").join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = of_node.groupBy("component").agg(F.min_by("node", "doc_id").alias("node")).select("node")
    return rows.join(least, "node", "left_semi").select("row.domain", "row.words")


def fit(labelled: DataFrame, docs: DataFrame, fit_rows: int = FIT_ROWS, text: str = "text") -> Classifier:
    """``labelled``: (doc_id, domain). The sample of labels is small by its bound, so it is broadcast to ``docs``."""
    known = labelled.where(F.col("domain").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "domain")
    total = known.count()
    if not total:
        return Classifier(["all"], [0.0], [], [0], [])
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = keep(known.where(chance < fit_rows / total).dropDuplicates(["doc_id"]), "labels")
    labelled_docs = docs.select("doc_id", F.col(f"`{text}`").alias("text")).join(F.broadcast(sample), "doc_id")
    seen = keep(one_of_each_class(labelled_docs), "seen")
    shares = {r["domain"]: r["n"] for r in seen.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    if not shares:
        return Classifier(["all"], [0.0], [], [0], [])
    domains = sorted(shares, key=lambda d: (-shares[d], d))
    rows = sum(shares.values())
    priors = [math.log(shares[d] / rows) for d in domains]
    present = seen.select("domain", F.explode("words").alias("word"))
    counts = present.groupBy("word").agg(*[F.sum((F.col("domain") == d).cast("long")).alias(f"n_{k}") for k, d in enumerate(domains)])
    fields, size_0 = [], shares[domains[0]]
    for k in range(1, len(domains)):
        size = shares[domains[k]]
        own, first = (F.col(f"n_{k}") + 0.5) / (size + 1.0), (F.col("n_0") + 0.5) / (size_0 + 1.0)
        pooled = (F.col(f"n_{k}") + F.col("n_0") + 0.5) / (size + size_0 + 1.0)
        spread = F.sqrt(pooled * (1 - pooled) * (1 / size + 1 / size_0))
        ratio = _likelihood_ratio(F.col(f"n_{k}"), size, F.col("n_0"), size_0)
        told = (F.abs(F.log(own / first)) >= LEAST_ODDS) & (F.abs(own - first) >= LEAST_SPREADS * spread) & (ratio >= LEAST_SPREADS**2)
        gone = F.log((1 - own) / (1 - first))
        fields.append(F.when(told, F.log(own / first) - gone).otherwise(0.0).alias(f"odds_{k}"))
        # the lack of the first domain's words says little
        fields.append(F.when(told & (own > first), gone).otherwise(0.0).alias(f"absent_{k}"))
    odds = [f"odds_{k}" for k in range(1, len(domains))]
    if not odds:
        return Classifier(domains, priors, [], [0], [])
    table = counts.select("word", *fields).where(F.greatest(F.lit(0.0), *[F.abs(o) for o in odds]) > 0).toPandas()  # words of several documents of the sample
    priors[1:] = [p + max(-ABSENT, float(table[f"absent_{k}"].sum())) for k, p in enumerate(priors[1:], 1)]
    slots = max(1024, 1 << (16 * len(table)).bit_length())
    ordered = table.assign(slot=table["word"] % slots).sort_values(["slot", "word"])
    begins = np.searchsorted(ordered["slot"].to_numpy(), np.arange(slots + 1)).tolist()
    return Classifier(domains, priors, ordered["word"].tolist(), begins, [ordered[o].tolist() for o in odds])


def _likelihood_ratio(n: Column, size: int, n_0: Column, size_0: int) -> Column:
    """Twice the log likelihood ratio of two shares of documents against one common share."""
    def part(seen: Column, of: Column | int, whole: Column | int) -> Column:
        return F.when(seen > 0, seen * F.log(seen * (size + size_0) / (of * whole))).otherwise(0.0)

    both, neither = n + n_0, size + size_0 - n - n_0
    return 2 * (part(n, both, size) + part(n_0, both, size_0) + part(size - n, neither, size) + part(size_0 - n_0, neither, size_0))


def score(docs: DataFrame, model: Classifier, text: str = "text") -> DataFrame:
    """``docs`` with ``__n`` (tokens) and ``__p`` (posteriors in the order of the model's domains)."""
    out = docs.withColumn("__w", words(text))  # used twice, so a column of its own: it is split once
    hashed = F.transform(F.col("__w"), lambda w: F.xxhash64(w))
    out = out.withColumn("__n", F.size("__w").cast("double")).withColumn("__t", model.places(hashed)).drop("__w")
    out = out.withColumn("__l", model.logs_at(F.col("__t"))).drop("__t")
    out = out.withColumn("__l", F.expr("transform(__l, x -> exp(x - array_max(__l)))"))
    return out.withColumn("__p", F.expr("transform(__l, x -> x / aggregate(__l, 0D, (s, y) -> s + y))")).drop("__l")


def rate(c: list[float]) -> Column:
    """The rate that the domains' numbers give a document."""
    move = F.lit(0.0)
    for k, value in enumerate(c):
        move = move + F.get("__p", F.lit(k)) * F.lit(float(value))
    return F.greatest(F.lit(0.0), 1 - move)


def solve(scored: DataFrame, model: Classifier, weights: dict[str, float], whole: str | None = None) -> tuple[list[float], dict[str, float]]:
    """(the domains' numbers, by domain the tokens over or under its target as a share of all tokens).

    Targets are ``weights`` (domains without one: 0) of all tokens, or of so many that the domain ``whole`` keeps its own.
    Projected gradient on the rates, from 1, for half the sum over the domains of (total - target) ** 2 / tokens: a document
    moves by its posteriors times the domains' relative errors, and what falls below 0 is projected to 0. The projection is the lazy
    one: steps add up before it, so all rates follow from one number a domain and a pass needs two sums a domain. A domain's tokens
    are those of documents with a rate over 0, ``LEAST_LIVE`` of all its tokens at least; as posteriors add up to 1, a step of length
    1 does not overshoot on these. Steps are accelerated, and begin anew when the momentum leads away; the best ones found count.
    """
    size = len(model.domains)
    numbers = range(size)

    def totals(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        used = scored.select("__n", "__p").withColumn("__r", rate(c.tolist()))
        live = F.when(F.col("__r") > 0, F.col("__n")).otherwise(0.0)
        found = used.agg(*[F.sum(w * F.get("__p", F.lit(k))) for w in (F.col("__n") * F.col("__r"), live) for k in numbers]).first()
        values = np.array([float(x or 0.0) for x in found])
        return values[:size], values[size:]

    c = np.zeros(size)
    base, _ = totals(c)
    mass, weight = base.sum(), sum(weights.get(d, 0.0) for d in model.domains)
    if not mass or not weight:
        return c.tolist(), {}
    target = np.array([weights.get(d, 0.0) for d in model.domains]) / weight
    if whole in model.domains and weights.get(whole) and base[model.domains.index(whole)]:
        at = model.domains.index(whole)
        target = target * base[at] / mass / target[at]
    least = np.maximum(LEAST_LIVE * base / mass, 1e-12)
    scale = np.maximum(base / mass, least)
    best, best_gap, still, momentum = c, base / mass - target, 0, 1.0
    ahead, gap = c, best_gap
    for _ in range(STEPS):
        if np.abs(best_gap).max() <= EXACT or still >= PATIENCE:
            break
        slope = PULL * ahead - gap / scale
        after = ahead - slope / (1 + PULL)
        if (scale * slope) @ (after - c) > 0:  # the momentum leads uphill
            momentum, ahead = 1.0, after
        else:
            longer = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
            ahead, momentum = after + (momentum - 1) / longer * (after - c), longer
        now, live = totals(ahead)
        c, gap, scale = after, now / mass - target, np.maximum(live / mass, least)
        still = 0 if np.abs(gap).max() < (1 - 1e-6) * np.abs(best_gap).max() else still + 1
        if not still:
            best, best_gap = ahead, gap
    gaps = dict(zip(model.domains, best_gap.tolist(), strict=True))
    if max(map(abs, gaps.values())) > TOLERANCE:
        warnings.warn(f"the mixture misses its targets by these shares of all tokens: {gaps}", stacklevel=2)
    return best.tolist(), gaps


def least_rate(c: list[float], model: Classifier, whole: str) -> float:
    """The smaller rate of a document that is surely of the domain ``whole`` and, if likeliest of it, of one without a telling word."""
    at = model.domains.index(whole)
    plain = np.exp(np.array(model.priors) - max(model.priors))
    plain /= plain.sum()
    return min(1 - c[at], float(1 - plain @ np.array(c))) if plain.argmax() == at else 1 - c[at]


def with_rates(
    docs: DataFrame, labelled: DataFrame, weights: dict[str, float], doc_id: str = "doc_id", text: str = "text", keep_text: bool = True,
    whole: str | None = None,
) -> tuple[DataFrame, Classifier]:
    """(doc, doc_id, __n, __p, __rate, __copies), ``doc`` with all columns of ``docs`` (but the text without ``keep_text``).

    Copies are the rate rounded up or down by a hash of the id, right on average. The documents with their posteriors are
    kept in the shared folder, so each text is read once for them. With ``whole`` no
    document that is surely of that domain, or without a telling word if that is likeliest of it, has a rate under 1, whatever
    the composition: the domain keeps its tokens, and all rates are raised together by what is still lacking.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns if keep_text or c != text]
    read = docs.select(F.struct(*columns).alias("doc"), F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    model = fit(labelled, read)
    scored = keep(score(read, model).drop("text"), "posteriors")
    numbers, model.gaps = solve(scored, model, weights, whole)
    least = least_rate(numbers, model, whole) if whole in model.domains and weights.get(whole) else 1.0
    raised = F.lit((1 + 1e-9) / least if 0 < least < 1 else 1.0)
    chance = F.pmod(F.xxhash64("doc_id", F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    more = (chance < F.col("__rate") - F.floor("__rate")).cast("int")
    return scored.withColumn("__rate", rate(numbers) * raised).withColumn("__copies", F.floor("__rate").cast("int") + more), model


def mix(
    docs: DataFrame, labelled: DataFrame, weights: dict[str, float], doc_id: str = "doc_id", text: str = "text", whole: str | None = None
) -> DataFrame:
    """Each document as often as its copies say, with its columns as they are."""
    rated, _ = with_rates(docs, labelled, weights, doc_id, text, whole=whole)
    times = F.expr("if(__copies > 0, sequence(1, __copies), array())")
    return rated.select("doc", F.explode(times).alias("copy")).select("doc.*")
