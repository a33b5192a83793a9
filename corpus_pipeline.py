"""From raw documents to packed training sequences: the stages, one after the other, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablewarden.llm import jaccard, mixing, packing, pii, quality
from tablewarden.llm.common import keep, table
from tablewarden.llm.queries import MIX_WEIGHTS, PII_KEY, WORD_TOKENIZER, domains

NEAR_PERCENT = 80
NEAR_WIDTH = 5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and whose host does."""
    return quality.filter_documents(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (Jaccard similarity of five-word shingles of 0.8 or more), that with the smallest id."""
    return jaccard.one_of_each(docs, NEAR_PERCENT, NEAR_WIDTH)


def feistel_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by pseudonyms."""
    return pii.pseudonymize(docs, PII_KEY)


def soft_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture wants them; good ones at least once."""
    return mixing.mix(docs, domains(table(spark, sf_dir, "labels")), MIX_WEIGHTS, whole="good")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in sequences of 2,048 tokens."""
    return packing.pack(docs, WORD_TOKENIZER)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("feistel_pseudonyms", feistel_pseudonyms),
    ("soft_mixing", soft_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: Tokens and the solver's rates are beyond SQL; the rows of run() as a whole are compared with nothing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
