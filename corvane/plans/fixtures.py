"""Inline tables for queries whose rules the driver's tables do not trigger, and their SQL form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def literal(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(literal, v)) + "]"
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)


def values(rows: list[tuple], *names: str) -> str:
    """The rows as a SQL relation."""
    return "(select * from (values " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + f") v({', '.join(names)}))"


def frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)
