"""The corpus pipeline: ``documents`` through five stages, each written before the next reads it.

1. quality classifier: documents that the model rejects go;
2. exact dedup: of equal texts the largest doc_id stays;
3. SimHash near-dedup: of each group of near copies the least doc_id stays. Texts whose fingerprints,
   as operator 6 has them, differ in 2 or fewer bits are near copies, and so are texts whose five-word
   shingles have a Jaccard similarity of 0.8, of which fingerprints alone would miss most;
4. benchmark decontamination: documents that overlap with a benchmark item go;
5. byte-level BPE: the documents left, as token ids and their digests.

Null and empty texts pass through every stage as empty documents (equal ones are duplicates of each
other); an empty table passes through as an empty table; columns beside doc_id and text are kept
untouched by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kairoflow.llm import bpe, decontamination, exact_dedup, near_dups, quality
from kairoflow.session import materialize

#: Differing bits up to which two fingerprints are near copies; operator 6 has the same limit.
SIMHASH_BITS = 2


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_quality(docs, quality.train(docs, labels))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dups.drop_near_duplicates(docs, bits=SIMHASH_BITS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.token_digests(docs)


STAGES = [
    ("quality_classifier", quality_stage),
    ("exact_dedup", exact_stage),
    ("simhash_near_dedup", near_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("byte_bpe", bpe_stage),
]

#: Trained models, fingerprints and tokenizers have no SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written as Parquet and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
