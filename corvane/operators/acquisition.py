"""Planning and filtering of fetched records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T

# Marks of a server error in place of a text.
CORRUPT = ("ADALET_RUNTIME_EXCEPTION", 'FMTY":"ERROR', 'FMC":"ADALET_RUNTIME_EXCEPTION')


def expand(catalog: DataFrame) -> DataFrame:
    """A row per query of ``catalog(chamber, queries, weight)``, with its allocation; groups without queries have none."""
    rows = catalog.where("size(queries) > 0").select("chamber", "weight", F.size("queries").alias("n"), F.posexplode("queries").alias("query_idx", "query"))
    return rows.select("chamber", "query_idx", "query", F.greatest(F.lit(1), F.floor(F.col("weight") / F.col("n")).cast("int")).alias("allowed"))


def is_corrupt(text, marks: tuple[str, ...] = CORRUPT):
    hit = F.lit(False)
    for m in marks:
        hit = hit | F.coalesce(F.contains(text, F.lit(m)), F.lit(False))
    return hit


def unseen(hits: DataFrame, seen: DataFrame, key: str = "id") -> DataFrame:
    return hits.join(seen.select(key), key, "left_anti")


def first_wins(hits: DataFrame, order: list, key: str = "id") -> DataFrame:
    """The first hit of each id."""
    first = hits.groupBy(key).agg(F.min_by(F.struct(*hits.columns), F.struct(*order)).alias("first"))  # shrinks before it moves, unlike a window
    return first.select("first.*")


def enrich(hits: DataFrame, court: str, fetched_at) -> DataFrame:
    """Hits with a ``meta`` struct and the slug of their group."""
    return hits.withColumn("meta", F.struct(F.col(court).alias("court"), F.col("query"), fetched_at.alias("fetched_at"), F.col("filename").alias("original_filename"))).withColumn("chamber_slug", T.slug(F.col(court)))


def quarantine(hits: DataFrame, fetched_at) -> DataFrame:
    """Corrupt hits with the start of their text."""
    return hits.where(is_corrupt(F.col("text"))).select("id", "filename", "chamber", "query", fetched_at.alias("fetched_at"), T.snippet(F.col("text")).alias("error_snippet"))
