"""A corpus pipeline of the training-data operators. STAGES lists its stages; each takes (spark, docs, sf_dir) and returns a DataFrame, which
run() writes as Parquet and reads again as the next stage's docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cloakstone.llm import decontaminate, jaccard_join, piece_transducer, quality_rules, secret_scan
from cloakstone.llm.common import written
from cloakstone.llm.queries import piece_model, table, trusted


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_clean(docs, trusted(spark, sf_dir))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of the least doc_id."""
    return jaccard_join.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark."""
    return secret_scan.redact(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' piece ids: doc_id, n_ids, ids, round_trip."""
    return piece_transducer.encode(docs, piece_model())


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_copies),
    ("benchmark_decontamination", benchmark),
    ("secret_scans", secrets),
    ("sentencepiece", pieces),
]

#: SQL can't express the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
