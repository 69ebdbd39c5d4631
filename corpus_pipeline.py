"""Documents to training tokens: quality rules, near-duplicates, decontamination, secrets, encoding."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lectern.llm import decontamination, pieces, quality, secret_scan, simhash
from lectern.llm.common import table, written

MODEL = public_tokenizers.path("piece_bpe_32k.model")
# Half of what a worker knows by default: executors still hold the stages before.
KNOWN_CHUNKS = 200_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base counts or a band of the tokeniser's fertility go."""
    return quality.filtered(docs, MODEL)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id."""
    return simhash.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten words in a row of a benchmark item, or with a whole shorter one, go."""
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets_redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets and linked parts of credentials are replaced by a mark in the text."""
    return secret_scan.redacted(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of the best segmentation of each text, with the scores of the N best."""
    return pieces.encoded(docs, MODEL, known_chunks=KNOWN_CHUNKS).select("doc_id", "n_pieces", "score", "best_scores", "ids", "round_trip")


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("decontamination", decontaminated), ("secret scan", secrets_redacted), ("encoding", encoded)]

# Tokenisers, hashes and automata aren't SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
