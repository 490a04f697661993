"""Corpus cleaning: language ID, near-duplicates, secrets, mixture and packing, each stage on all that the last one kept.

Every stage takes an empty table and gives an empty one, reads texts whole whatever their length, and passes columns of
any other name through (packing excepted, which gives its own). What each does with nulls, empty texts, ties and
repeated rows is said below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleanery.llm import langid, mixing, packing, secrets, simhash
from gleanery.scratch import drop_shared, write_shared


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no known language go: null, empty and letterless texts, those far from every language, and those between
    two. The detected language is written in ``lang``; ties go to the lesser name. Null ids and repeated rows stay."""
    return langid.keep_identified(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one of the least id, nulls last. Repeated rows are copies; rows
    without any word, null and empty texts among them, all stay."""
    return simhash.deduplicate(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Confirmed secrets are replaced in the text; every document stays, null and empty texts and repeated rows as well."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many documents as came in, drawn to the sources' target weights; a row for each copy. A null source is a source of
    its own, null and empty texts are never drawn, ties go by id with nulls first, repeated rows are drawn one by one."""
    return mixing.mix(docs)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every document's pieces go in the training sequences. A null or empty text is one end mark; repeated rows and
    null ids have places of their own; equal lengths go by a hash of the row."""
    return packing.pack(docs)


STAGES = [
    ("language", identify_language),
    ("near-duplicates", drop_copies),
    ("secrets", redact_secrets),
    ("mixture", mix_sources),
    ("packing", pack_bins),
]

#: n-gram ranks, covering LSH, key parsing and first-fit packing aren't expressible in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from ``documents`` of ``sf_dir``."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs, path = write_shared(stage(spark, docs, sf_dir), name)
        if before:
            drop_shared(spark, before)
        before = path
    return docs
