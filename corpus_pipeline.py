"""From raw documents to packed training sequences: quality, exact and near duplicates, personal data, packing.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that its
predecessor kept; all but the last return the columns of ``documents``. Rows
are told apart by their place, not by doc_id, so a doc_id that repeats neither
loses a text nor keeps a copy. Empty tables give empty ones; columns that
``documents`` does not have are dropped.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import cotraining, exact_dedup, jaccard, packing, pii
from corvane.llm.arrow import bound_batches
from corvane.operators.skew import checked_broadcast
from corvane.storage import drop, finished, materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` written once, each row with a ``_key`` of its own that orders by doc_id, rows without one last."""
    bound_batches(docs.sparkSession)
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.monotonically_increasing_id().alias("row"))
    return materialize(docs.select(*COLUMNS).withColumn("_key", row), "numbered")


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``_key`` is not in ``gone``; texts move only where that is too large to broadcast."""
    rows = checked_broadcast(materialize(gone.select(F.col("_key.row").alias("_row")), "gone"))
    return docs.join(rows, F.col("_key.row") == F.col("_row"), "left_anti").select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier scores at least one half.

    Null and empty texts are scored like others by what features they have;
    repeated rows fare alike; without labels of both kinds all stay.
    """
    rows = _numbered(docs)
    labels, pages = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("labels", "pages"))
    return _without(rows, cotraining.classify(rows, labels, pages, key="_key").where("score < 0.5"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows whose texts are equal but for A-Z case, the one with the smallest doc_id.

    One row of each group stays, also where doc_ids repeat; a row without a
    doc_id stays only where no other has its text. Null and empty texts are
    equal to each other.
    """
    rows = _numbered(docs)
    return _without(rows, exact_dedup.exact_groups(rows, key="_key", keep="min").where("not kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of rows that links of Jaccard 0.8 on five-word shingles connect, the one with the smallest doc_id.

    Rows are told apart as in :func:`exact`. Null and wordless texts link with
    nothing, so all of them stay.
    """
    rows = _numbered(docs)
    return _without(rows, jaccard.near_duplicates(rows, key="_key", words=5, percent=80).where("_key != component_id"))


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by the name of its kind; n_chars follows the text. Null texts stay null; every row stays."""
    bound_batches(spark)
    return pii.mask_documents(docs.select(*COLUMNS), length="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens; a null or empty text is the end id alone, repeated rows have pieces of their own."""
    bound_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("pii", personal), ("pack", pack)]

#: The first stage's classifier and the tokenizer of the last have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, finished(functools.partial(stage, spark, docs, sf_dir), name)
        drop(before)
    _, stage = STAGES[-1]
    return stage(spark, docs, sf_dir)


__all__ = ["COLUMNS", "ORACLE_SQL", "STAGES", "run"]
