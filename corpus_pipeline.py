"""The corpus pipeline: quality rules, near-dedup, suffix dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. Stages are
written as Parquet and read again between them; all but the last return the
columns of documents. A stage's table is deleted when the next one's is written.

Defined results: null, empty and blank texts, and those of fewer words than the
quality rules ask for, go in the first stage; very long texts are texts like any
other; of texts that are alike the one with the least doc_id stays, of repeated
rows of a doc_id one; a null doc_id is an id like any other, less than none; a
text that suffix dedup empties stays as an empty row until the mix, which never
takes it; a null source is a source like any other; an empty table gives an empty
result; further columns, whatever their names, are handed on up to the last stage,
which gives its own columns only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperloom.llm import minhash, mixing, quality_rules, sentencepiece_lattice, suffix_dedup
from hyperloom.llm.common import delete, shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.passing(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, at similarity 0.8."""
    return minhash.survivors(docs, 80)


#: Passages of more than 50 words go: of runs of 51 words, 99 in 100 have so many bytes (a quarter has fewer than op8's 400).
PASSAGE_BYTES = 250


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of passages that also stand elsewhere; n_chars follows the text."""
    out = suffix_dedup.clean(docs, PASSAGE_BYTES)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: taken / size, to the nearest whole number."""
    return mixing.repeat(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's pieces: counts, a hash of the ids, and whether they decode to the text."""
    return sentencepiece_lattice.summary(docs)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup_stage),
    ("mix", mix),
    ("encode", encode),
]

#: Near-dedup is iterative: no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
        if before is not None:
            delete(spark, before)
        before = f"{folder}/{k}-{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
