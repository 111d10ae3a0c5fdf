"""Exact deduplication by 128-bit content hash with byte comparison inside groups.

One pass over the texts gives the 128-bit hash and the SHA-256 of the
normalised bytes (A-Z lower-cased, null as empty), all in the JVM; only these
digests are grouped by hash. The bytes of groups of two rows and more then meet
in a second pass: copies collapse before they move, and should two different
texts ever agree in both digests, the job fails rather than merge them. Groups
go back to their rows by digests alone, those of hot texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.skew import checked_broadcast, join_hot
from corvane.storage import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASHES = ["content_hash", "digest"]


def normalised(text: Column) -> Column:
    """A-Z lower-cased, null as empty; pure ASCII takes the faster way."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def md5(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "min", hash128: Callable[[Column], Column] = md5) -> DataFrame:
    """One row per row of ``docs``: ``key, keep_id, group_size, kept, text_sha256``.

    ``keep`` says which id of equal texts stays: ``min`` (the smallest stable
    id) or ``max``. Texts are equal when identical after lower-casing A-Z only;
    a null text counts as empty. Exactly one row of each group is kept: a row
    whose key is null never stays in place of one with a key (a group of null
    keys only has a null ``keep_id``), and of rows that repeat key and text one
    stays. Other columns of ``docs`` are not read; an empty table gives an
    empty one.
    """
    t = normalised(F.col(text))
    rows = docs.select(F.col(key).alias("key"), hash128(t).alias("content_hash"), F.unhex(F.sha2(t, 256)).alias("digest"))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "digests")
    if keep == "min":
        first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "row"))
    elif keep == "max":
        first = F.max(F.struct(F.col("key").isNotNull().alias("known"), "key", "row"))
    else:
        raise ValueError(f"keep is min or max, not {keep!r}")
    groups = rows.groupBy(*HASHES).agg(F.count(F.lit(1)).alias("group_size"), first.alias("first"))
    groups = materialize(groups.select(*HASHES, "group_size", F.col("first.key").alias("keep_id"), F.col("first.row").alias("keep_row")), "groups")
    total = groups.agg(F.sum("group_size").alias("n")).first()["n"] or 0
    several = checked_broadcast(groups.where("group_size > 1").select(*HASHES))
    texts = docs.select(hash128(t).alias("content_hash"), F.unhex(F.sha2(t, 256)).alias("digest"), t.alias("content")).join(several, HASHES)  # not a semi join, which would hash in its condition and again after
    unlike = texts.groupBy(*HASHES, "content").agg(F.count(F.lit(1)).alias("n")).groupBy(*HASHES).agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")
    if unlike.limit(1).count():
        raise ValueError("two texts share their 128-bit hash and SHA-256")
    found = join_hot(rows, groups, HASHES, "group_size", total)
    return found.select(F.col("key").alias(key), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


__all__ = ["exact_groups", "md5", "normalised"]
