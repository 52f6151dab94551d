"""A training-corpus pipeline: quality, exact copies, near copies, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's documents; all but the last return the columns of documents, whatever
others there are besides those used.  Null texts and ids, repeated rows and empty tables pass as each
stage's operator says; an empty table gives an empty result.

A stage first deletes the scratch tables of the one before it on the same data, whose result has been
written by then.  :func:`run` keeps the scratch of its own run apart from that of any other.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lumenqa.llm import exact_dedup, mixing, packing, quality, simhash
from lumenqa.llm.catalogue import tokenizer_path
from lumenqa.llm.common import read, release, written

#: SQL can't express the classifier, the draw or the packing; tests hold each stage against brute force.
ORACLE_SQL = None

def _begin(spark: SparkSession, number: int, run_id: str) -> str:
    release(spark, f"{run_id}/{number - 1 or len(STAGES)}")
    return f"{run_id}/{number}"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, run_id: str = "") -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"), label=_begin(spark, 1, run_id or sf_dir))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, run_id: str = "") -> DataFrame:
    """Of equal texts the one with the smallest id stays."""
    return exact_dedup.keep_first(docs, label=_begin(spark, 2, run_id or sf_dir))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, run_id: str = "") -> DataFrame:
    """One document of each near-duplicate group stays."""
    return simhash.keep_representatives(docs, label=_begin(spark, 3, run_id or sf_dir))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, run_id: str = "") -> DataFrame:
    """Documents are repeated or left out so that sources have their target weights."""
    return mixing.apply_mix(docs, label=_begin(spark, 4, run_id or sf_dir))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, run_id: str = "") -> DataFrame:
    """Pieces with their places in sequences of 4096 tokens."""
    return packing.pack(docs, tokenizer_path(), label=_begin(spark, 5, run_id or sf_dir))


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("simhash near-dedup", near_stage),
    ("source mixing", mix_stage),
    ("best-fit packing", pack_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is written to the shared folder and read again.

    The result of a stage is deleted when the next one's has been written, the last one when the
    driver ends.
    """
    docs, run_id = read(spark, sf_dir, "documents"), uuid.uuid4().hex
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = written(stage(spark, docs, sf_dir, run_id), f"{run_id}/result-{number}")
        release(spark, f"{run_id}/result-{number - 1}")
    release(spark, f"{run_id}/{len(STAGES)}")
    return docs
