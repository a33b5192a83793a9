"""The registered queries of this subpackage, over whole tables with production parameters, and their DuckDB texts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.llm import cover_tree, filter_audit, jaccard, language, mixing, negatives, neighbours, packing, pii, quality, repeats, token_counts, url_filters
from tablewarden.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return wrap


END_OF_TEXT = 49407  # <|endoftext|> of the word tokenizer


@query("op1_language_id")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").withColumn("held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1)
    docs = docs.withColumn("held_out", F.coalesce("held_out", F.lit(False)))
    model = language.fit(docs.where(~F.col("held_out")).select("lang", "text"))
    return language.predict(docs.select("doc_id", "held_out", "text"), model)


@query("op8_token_counts")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.document_counts(table(spark, folder, "documents"), WORD_TOKENIZER, END_OF_TEXT)


@query("op2_best_fit_packing")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), WORD_TOKENIZER)


URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
LISTED_TERMS = ["ads", "adult", "bets", "casino", "pills", "spam"]

_URL_SQL = r"""
WITH rest AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), cut AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM rest
), split AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM cut
), rules(action, rule, domain, prefix) AS (
  VALUES ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'), ('block', 'example.org/en/1', 'example.org', '/en/1'),
    ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')
), fitting AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action
  FROM split JOIN rules ON (host = domain OR ends_with(host, '.' || domain)) AND starts_with(path, prefix) GROUP BY page_id
)
SELECT s.page_id, host, path, rule,
  coalesce(action, CASE WHEN list_has_any(regexp_split_to_array(host, '[.-]'), ['ads', 'adult', 'bets', 'casino', 'pills', 'spam']) THEN 'block' ELSE 'allow' END) AS verdict
FROM split s LEFT JOIN fitting f ON s.page_id = f.page_id
"""


@query("op5_bloom_cascade", _URL_SQL)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    listed = F.arrays_overlap(F.split("key", "[.-]"), F.array(*[F.lit(t) for t in LISTED_TERMS]))
    judged = url_filters.judge(table(spark, folder, "pages").select("page_id", "url"), URL_RULES, listed)
    return judged.select("page_id", "host", "path", "rule", "verdict")


MIX_WEIGHTS = {"good": 0.93, "poor": 0.05, "toxic": 0.02}


def domains(labels: DataFrame) -> DataFrame:
    """The labelled table as (doc_id, domain)."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    return labels.select("doc_id", domain.alias("domain"))


@query("op7_soft_mixing")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels")
    rated, model = mixing.with_rates(docs, domains(labels), MIX_WEIGHTS, keep_text=False)
    shares = [F.get("__p", F.lit(k)).alias(f"p_{d}") for k, d in enumerate(model.domains)]
    return rated.select("doc_id", F.col("__n").cast("long").alias("n_tokens"), *shares, F.col("__rate").alias("rate"), F.col("__copies").alias("copies"))


_HOST_SQL = r"""
WITH base AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), counted AS (
  SELECT doc_id, source, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
      - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
    words
  FROM base
), windows AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM counted WHERE len(words) >= 3
), repeated AS (
  SELECT doc_id, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w, list(i) AS places FROM windows GROUP BY ALL HAVING count(*) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, unnest(places) AS i FROM repeated), (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id
), judged AS (
  SELECT c.doc_id, source, n_words, word_chars, n_symbols, n_dup_lines, coalesce(v.n, 0) AS n_repeat_words,
    n_words < 50 OR 100 * coalesce(v.n, 0) > 50 * n_words AS base_failed
  FROM counted c LEFT JOIN covered v ON c.doc_id = v.doc_id
), hosts AS (
  SELECT source AS host, count(*) AS n, sum(base_failed::INT) AS failed FROM judged WHERE source IS NOT NULL GROUP BY source
), whole AS (
  SELECT sum(failed) / sum(n) AS m, var_pop(failed / n) AS v, avg(1 / n) AS chance FROM hosts
), prior AS (
  SELECT m, least(1000.0, greatest(1.0, m * (1 - m) / greatest(v - m * (1 - m) * chance, 1e-12) - 1)) AS s FROM whole
), rates AS (
  SELECT host, (failed + m * s) / (n + s) AS rate FROM hosts, prior
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(rate > 0.8, false) AS kept
FROM judged LEFT JOIN rates ON source = host
"""


PII_KEY = "an example key; give your own"


@query("op3_feistel_pseudonyms")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return pii.pseudonymize(docs, PII_KEY, changed="n_replaced")


@query("op6_host_rules", _HOST_SQL)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.judge(table(spark, folder, "documents").select("doc_id", "source", "text"))
    counts = [F.col(f"__{c}").alias(c) for c in quality.COUNTS]
    return judged.select("doc_id", *counts, F.col("__base_failed").alias("base_failed"), F.col("__kept").alias("kept"))


@query("op9_kmeans_tree_search")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    index = neighbours.build(vectors)
    return neighbours.search(index, vectors.where(F.col("vec_id") % 50 == 0))


_JACCARD_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), cut AS (
  SELECT doc_id, w, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [1] ELSE range(1, len(w) - 2) END) AS i FROM words
), items AS (
  SELECT DISTINCT doc_id, hash(CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] END) AS s FROM cut
), sizes AS (
  SELECT doc_id, count(*) AS n FROM items GROUP BY doc_id
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM items x JOIN items y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes p ON a = p.doc_id JOIN sizes q ON b = q.doc_id WHERE 100 * i >= 85 * (p.n + q.n - i)
), sides AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT DISTINCT a AS node, a AS other FROM sides UNION SELECT node, b FROM reach JOIN sides ON other = a
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes z ON d.doc_id = z.doc_id LEFT JOIN (SELECT node, min(other) AS c FROM reach GROUP BY node) r ON d.doc_id = node
"""


@query("op10_universe_partition_join", _JACCARD_SQL)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.join_documents(table(spark, folder, "documents"))


_REPEATS_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (
  SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM words WHERE len(w) >= 35
), windows AS (
  SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM starts
), repeated AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS n FROM windows) WHERE n > 1
), gone AS (
  SELECT DISTINCT r, unnest(range(i, i + 35)) AS i FROM repeated
), removed AS (
  SELECT r, list(i) AS places FROM gone GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(places), 0)::BIGINT AS n_removed,
  sha256(array_to_string([x.x FOR x IN list_filter(list_transform(w, lambda x, i: {'x': x, 'i': i}), lambda y: NOT coalesce(list_contains(places, y.i), false))], ' ')) AS kept_sha256
FROM words LEFT JOIN removed ON words.r = removed.r
"""


@query("op4_seed_and_extend", _REPEATS_SQL)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    kept = repeats.remove_repeats(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


_AUDIT_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT doc_id, part, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS first FROM texts
), failures AS (
  SELECT part, coalesce(g.doc_id IS NOT NULL, false) AS good, coalesce(t.doc_id IS NOT NULL, false) AS toxic,
    [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text),
     regexp_matches(text, '[#$%&*|]'), coalesce(first < d.doc_id, false)] AS fails
  FROM words d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) g ON d.doc_id = g.doc_id
    LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) t ON d.doc_id = t.doc_id
), kinds AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS n_good, count(*) FILTER (WHERE toxic) AS n_toxic FROM failures GROUP BY ALL
), five AS (
  SELECT unnest(range(1, 6)) AS f
), orders AS (
  SELECT [a.f, b.f, c.f, d.f, e.f] AS o FROM five a, five b, five c, five d, five e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps AS (
  SELECT o, array_to_string(list_transform(o, lambda i: substr('ABCDE', i, 1)), '') AS filter_order, unnest(range(1, 6)) AS step FROM orders
), cells AS (
  SELECT part, filter_order, step, o[step] AS f,
    sum(n) FILTER (WHERE NOT list_bool_or(list_transform(o[1:step], lambda i: fails[i]))) AS kept,
    sum(n) FILTER (WHERE fails[o[step]] AND NOT coalesce(list_bool_or(list_transform(o[1:step - 1], lambda i: fails[i])), false)) AS removed,
    sum(n) FILTER (WHERE fails[o[step]] AND coalesce(list_bool_or(list_transform(o[1:step - 1], lambda i: fails[i])), false)) AS redundant,
    sum(n) FILTER (WHERE fails[o[step]] AND len(list_filter(fails, lambda x: x)) = 1) AS unique_fails,
    sum(n_good) FILTER (WHERE fails[o[step]] AND NOT coalesce(list_bool_or(list_transform(o[1:step - 1], lambda i: fails[i])), false)) AS good_lost,
    sum(n_toxic) FILTER (WHERE fails[o[step]] AND NOT coalesce(list_bool_or(list_transform(o[1:step - 1], lambda i: fails[i])), false)) AS toxic_lost
  FROM kinds, steps GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  sum(coalesce(removed, 0)) OVER (PARTITION BY part, f)::BIGINT AS shapley
FROM cells
"""


@query("op11_failing_id_audit", _AUDIT_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


_TOP_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


@query("op12_cover_tree_top_k", _TOP_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return cover_tree.search(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


_NEGATIVES_SQL = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_sum(list_transform(list_zip(a.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), ranked AS (
  SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank
  FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 3
"""


@query("op13_strassen_negatives", _NEGATIVES_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, folder, "embeddings").withColumn("label", moved)
    return negatives.mine(vectors, F.col("vec_id") % 50 == 0)
