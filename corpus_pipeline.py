"""A corpus from documents in five stages: quality, exact dedup, near-dedup, mixing and packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last return the
columns of documents; run() writes each stage's result to the shared folder, reads it again, and removes what the
stage before wrote. Arrow batches are bounded by bytes in all of them.

Null texts count as empty in every stage: they are scored like any, one of them stays (exact_dedup), they are near
nothing, have no words to mix and are packed as their end token alone. Null ids come last where the smallest id
stays; null sources are a source. Rows that repeat whole are exact copies, of which one stays. Columns of documents may
have any names. Empty tables give empty tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.base import bounded_batches, remove, shared_dir, table
from millrace.llm.exact_dedup import drop_exact_duplicates
from millrace.llm.minhash import drop_near_duplicates
from millrace.llm.mixing import mix_documents
from millrace.llm.packing import pack_documents
from millrace.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go: those with a score under 0.3."""
    return keep_good(docs, table(spark, sf_dir, "labels"), cut=0.3)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space the one with the smallest id stays; of ties one."""
    return drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates, on shingles of five words at 80 %, the one with the smallest id stays; texts without words stay."""
    return drop_near_duplicates(docs, k=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, at most three times."""
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 2048 tokens. A document that is there twice is packed twice.

    The encoder remembers fewer words than by default: this stage follows others in workers that live on.
    """
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=0, cache_words=100_000)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixing), ("packing", packing)]

#: Learned scores, MinHash, random rounding and tokenizers aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    home, before = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    bounded_batches(spark)
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{name}")
        docs = spark.read.parquet(f"{home}/{name}")
        if before:
            remove(spark, before)
        before = f"{home}/{name}"
    return docs
