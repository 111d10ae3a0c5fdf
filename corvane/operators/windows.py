"""Sliding windows over token sequences, special tokens and word ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def offline_starts(n: Column, width: int = 510, stride: int = 256, least: int = 10) -> Column:
    """Every stride's start that leaves ``least`` tokens; suffixes of the last full window are windows too."""
    del width
    return F.when(n >= least, F.sequence(F.lit(0), n - least, F.lit(stride))).otherwise(F.array().cast("array<int>"))


def online_starts(n: Column, width: int = 510, stride: int = 128, least: int = 50) -> Column:
    """Starts up to the first window that reaches the end."""
    last = F.ceil(F.greatest(n - width, F.lit(0)) / F.lit(float(stride))).cast("int")
    return F.when(n >= least, F.filter(F.transform(F.sequence(F.lit(0), last), lambda i: i * stride), lambda s: F.least(F.lit(width), n - s) >= least)).otherwise(F.array().cast("array<int>"))


def windows(counts: DataFrame, starts: Column, width: int = 510) -> DataFrame:
    """A row per window of ``counts(…, n)``: chunk number, start and length."""
    keys = [c for c in counts.columns if c != "n"]
    rows = counts.select(*keys, "n", F.posexplode(starts).alias("chunk", "start"))
    return rows.select(*keys, "chunk", "start", F.least(F.lit(width), F.col("n") - F.col("start")).alias("size"))


def add_specials(ids: Column, first: int = 0, last: int = 2) -> Column:
    return F.concat(F.array(F.lit(first)), ids, F.array(F.lit(last)))


def fill_word_ids(df: DataFrame, key: str, order: str, word: str) -> DataFrame:
    """Missing word ids from the row before, 0 where there is none."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn(word, F.greatest(F.lit(0), F.coalesce(F.last(word, ignorenulls=True).over(w), F.lit(-1))))


def fallback_word_ids(n: Column) -> Column:
    """Positions, null at both ends."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when((i > 0) & (i < n - 1), i))
