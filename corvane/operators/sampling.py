"""Shuffles, splits, shards, batches and allocations, all by keyed hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions.keyed import uniform
from corvane.storage import materialize


def with_position(df: DataFrame, order: list, name: str = "position") -> DataFrame:
    """Row numbers from 0 in a global order, without bringing the rows to one task: range partitions are sorted and offset by the sizes of those before."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
    held = materialize(dealt, "ordered")
    sizes = held.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return held.join(F.broadcast(before), "_part").select(*df.columns, (F.col("_before") + F.col("_row") - F.col("_first")).alias(name))  # a row per partition


def shuffle_order(df: DataFrame, key: str, seed: str = "order") -> DataFrame:
    return with_position(df.withColumn("_u", uniform(seed, key)), ["_u", key]).drop("_u")


def block_shuffle(df: DataFrame, order: str, block: int = 10_000, seed: str = "order") -> DataFrame:
    """Shuffled within blocks of consecutive rows, as a bounded buffer would."""
    placed = with_position(df, [order], "_at").withColumn("block", F.floor(F.col("_at") / block).cast("long"))
    w = Window.partitionBy("block").orderBy(uniform(seed, order), order)
    return placed.withColumn("place", F.row_number().over(w) - 1).drop("_at")


def split(df: DataFrame, key: str, validation: float = 0.1, seed: str = "split") -> DataFrame:
    """``part`` train or validation: the first floor(n * (1 - validation)) rows of a keyed order train."""
    n = df.count()
    cut = int(n * (1 - validation))
    placed = with_position(df.withColumn("_u", uniform(seed, key)), ["_u", key]).drop("_u")
    return placed.withColumn("part", F.when(F.col("position") < cut, "train").otherwise("validation")).drop("position")


def shard(index: Column, files: Column, workers: int) -> Column:
    """The worker of a file: contiguous ranges, the rest to the last worker."""
    per = F.floor(files / workers)
    return F.when(per == 0, workers - 1).otherwise(F.least(F.floor(index / F.greatest(per, F.lit(1))), F.lit(workers - 1))).cast("int")


def batches(df: DataFrame, position: str, size: int, drop_last: bool) -> DataFrame:
    """``batch_id`` of consecutive positions; incomplete last batches go where asked."""
    rows = df.withColumn("batch_id", F.floor(F.col(position) / size).cast("long"))
    if not drop_last:
        return rows
    return rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("batch_id"))).where(F.col("_n") == size).drop("_n")


def allocation(weight: Column, queries: Column) -> Column:
    """Rows each query of a group may take."""
    return F.greatest(F.lit(1), F.floor(weight / F.size(queries)).cast("int"))


def first_per_group(df: DataFrame, group: list[str], order: list, limit) -> DataFrame:
    rows = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return rows.where(F.col("_rn") <= limit).drop("_rn")
