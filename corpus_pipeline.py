"""The corpus pipeline: five stages over the table ``documents``, each written as Parquet and read again.

1. toxicity: documents that the classifier chain rejects go;
2. exact dedup: of equal texts the largest id stays;
3. MinHash near-dedup: the smallest id of each class of near copies stays;
4. mixing: sources are drawn to their target weights (a document appears once per draw);
5. byte-level BPE: whole texts become token ids, which are decoded again for the digest.

All stages but the last return the columns of their input.  SQL can express
neither the fitted chain nor the sampling, so there is no ``ORACLE_SQL``; the
tests compare each stage with a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attrition.llm import bpe, exact_dedup, mixing, near_dedup, queries, toxicity
from attrition.llm.storage import scratch_path, ship_package, stage_at
from attrition.session import ensure_checkpoint_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, queries.toxicity_chain(spark, docs, sf_dir))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocabularies

    # a small memo and few arcs, not kept: the workers of all stages are the same ones
    return bpe.round_trip(docs, vocabularies.path(queries.RANK_FILE), vocabularies.PATTERN, capacity=50_000, release=True,
                          max_arcs=300_000)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, from the table ``documents`` of ``sf_dir``."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage_at(stage(spark, docs, sf_dir), scratch_path(spark, f"pipeline-{name}"))
    return docs
