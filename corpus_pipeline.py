"""The corpus pipeline: quality, exact copies, near copies, benchmark passages, tokens.

Every stage takes (spark, docs, sf_dir), works on all documents that the stage before has kept, and returns them with
their columns, the last one its result. A decision on a doc_id holds for all rows with it; rows without doc_id can't be
named and stay. `run` writes each stage's documents to the shared folder and reads them again.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm import decontaminate, exact_dedup, near_dedup, piece_codec, quality
from ledgerline.llm.common import keep_ids, table
from ledgerline.session import materialize

#: Scores of a model are floating point sums, so SQL can't give the same rows. Tests hold each stage's operator,
#: not the whole pipeline, against a plain version.
ORACLE_SQL = None


def _without(docs: DataFrame, rejected: DataFrame, name: str) -> DataFrame:
    ids = materialize(rejected.where("doc_id IS NOT NULL").select("doc_id").distinct(), name)
    return keep_ids(docs, ids, "doc_id", anti=True)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return _without(docs, quality.quality(docs, table(spark, sf_dir, "labels")).where("NOT kept"), "rejected")


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row that stays."""
    return _without(docs, exact_dedup.exact_dedup(docs).where("NOT kept"), "copies")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of similar texts (five-word shingles, 0.8 or more), the one with the smallest doc_id."""
    return _without(docs, near_dedup.near_duplicates(docs, shingle=5, percent=80).where("NOT kept"), "near-copies")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark passages."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, found.where("contaminated"), "contaminated")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the SentencePiece ids and decoded text of each document."""
    return piece_codec.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"), digest=True)


STAGES = [
    ("quality", good_quality),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("decontamination", without_benchmark),
    ("sentencepiece", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
