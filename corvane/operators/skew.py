"""Joins that no hot key can slow: keys that hold a large share of the rows are few, so they are broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_HOT = 4096
MOST_BROADCAST = 2_000_000  # rows of a broadcast that grows with the data; beyond it the join shuffles


def join_hot(rows: DataFrame, groups: DataFrame, on: list[str], size: str, total: int) -> DataFrame:
    """``rows`` joined with ``groups``, which has each key once and in ``size`` how many of ``total`` rows hold it.

    Keys with more than 1 / MOST_HOT of the rows number less than MOST_HOT; they
    are broadcast, so their rows stay where they are. The rest meet by shuffle,
    where no key has more than that share. Both tables are read twice and
    should be materialised. Rows without a group are dropped.
    """
    hot = F.col(size) * MOST_HOT > total
    few = F.broadcast(groups.where(hot))
    cold = rows.join(few.select(*on), on, "left_anti").join(groups.where(~hot), on)
    return rows.join(few, on).unionByName(cold)


def checked_broadcast(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """``df``, a narrow table, marked for a broadcast where it has at most ``most`` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
