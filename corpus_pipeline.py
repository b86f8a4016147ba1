"""From documents to token ids: quality, rules, near-duplicates, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a frame that ``run`` writes to the
shared folder and reads again as the next one's docs.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe_tree, poisson_mix, quality_fm, rules, sketch_dedup
from tidemark.llm.common import held_out, release, stored, table

RANKS = "byte_bpe_multi_50k.tiktoken"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier scores at its threshold or above."""
    model = quality_fm.fit(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id"), 4))
    return docs.where(quality_fm.score(docs, model) >= quality_fm.THRESHOLD)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within all thresholds of the rule table."""
    return rules.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: 0.8 or more of their five-word shingles in common."""
    return sketch_dedup.keep(docs, words=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents replicated towards the square roots of the sources' sizes, shuffled."""
    return poisson_mix.mix(docs, poisson_mix.tempered_weights(docs))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with their digests."""
    return bpe_tree.round_trip(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality),
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("mixing", mixing),
    ("encoding", encoding),
]

# The classifier is learned, the sketches and token ids have no SQL: tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
