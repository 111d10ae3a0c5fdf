"""Sinks: JSON Lines by group, merged JSON Lines, term files, one-row reports, checkpoint retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def append_json(df: DataFrame, path: str, by: str) -> None:
    df.write.partitionBy(by).mode("append").json(path)


def merged_json(df: DataFrame, path: str, one_file: bool = False) -> None:
    (df.coalesce(1) if one_file else df).write.mode("overwrite").json(path)


def term_file(terms: DataFrame, path: str) -> None:
    """One term a line, longest first."""
    terms.orderBy(F.desc(F.length("term")), "term").select("term").write.mode("overwrite").text(path)


def report(totals: DataFrame, model: str, config: dict) -> DataFrame:
    """A one-row table as JSON with its time, model and settings."""
    return totals.select(F.to_json(F.struct(F.current_timestamp().alias("timestamp"), F.lit(model).alias("model"), F.create_map(*[F.lit(str(x)) for kv in config.items() for x in kv]).alias("config"), F.struct("*").alias("totals"))).alias("value"))


def newest(checkpoints: DataFrame, keep: int, step: str = "step", by: str = "run") -> DataFrame:
    return checkpoints.withColumn("_rn", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(step)))).where(F.col("_rn") <= keep).drop("_rn")
