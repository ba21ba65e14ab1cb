"""A corpus pipeline of five operators; each stage is written and read again as the next one's documents.

What a stage has staged for itself is removed when the next one begins, so each
stage's result has to be written before that.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corridor_spark.llm import bpe, line_dedup, mixing, ngram_join, quality
from corridor_spark.llm.common import discard, leave, load, scope, stage_root


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    with scope("pipeline"):
        return quality.keep_good(docs)


def line_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of 8 words or more that an earlier document holds are cut out; documents left without a word go."""
    with scope("pipeline"):
        return line_dedup.without_repeats(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each component of near duplicates stays: five-word shingles, similarity 0.8 or more."""
    with scope("pipeline"):
        return ngram_join.first_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source gives its target's words: a document comes once per round that takes it, cut where its source's last round ends."""
    with scope("pipeline"):
        return mixing.mix_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document of the mix, with digests of the ids and of the decoded text."""
    with scope("pipeline"):
        return bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True, more=("source",))


STAGES = [("quality rules", quality_rules), ("line dedup", line_repeats), ("n-gram Jaccard join", near_duplicates),
          ("source mix", source_mix), ("BPE", token_ids)]

#: SQL cannot express byte-pair encoding; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    docs, folder = load(spark, sf_dir, "documents"), f"{stage_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, step) in enumerate(STAGES):
        out = step(spark, docs, sf_dir)
        if number == len(STAGES) - 1:
            leave("pipeline")  # another run must not remove what this result still reads
            return out
        out.write.parquet(f"{folder}/{number}")
        if number:
            discard(docs)  # nothing reads the stage before any more
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
