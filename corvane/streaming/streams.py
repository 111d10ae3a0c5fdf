"""Streaming forms: file datasets, first-wins deduplication, event-time windows, buffered shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import strip
from corvane.sources import readers
from corvane.storage import new_path


def read_table(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """A Parquet file or folder as a stream, with the table's schema."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name}*" if name.endswith(".parquet") else path)


def text_files(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """Documents as whole files, a few at a time."""
    return spark.readStream.option("pathGlobFilter", glob).option("maxFilesPerTrigger", 16).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), strip(F.col("value")).alias("text"))


def dataset(spark: SparkSession, path: str, streaming: bool = False, glob: str = "*.txt", least: int = 0) -> DataFrame:
    """Documents of a folder, ``path, text``, as a table or as a stream: the same rows either way."""
    rows = text_files(spark, path, glob) if streaming else readers.text_files(spark, path, glob)
    return rows.where(F.length("text") >= least)


def first_wins(stream: DataFrame, key: str = "id", time: str | None = None) -> DataFrame:
    """The first row of each key; with a watermarked ``time`` column keys are forgotten after it."""
    return stream.dropDuplicatesWithinWatermark([key]) if time else stream.dropDuplicates([key])


def event_windows(stream: DataFrame, time: str, width: str, late: str = "1 hour") -> DataFrame:
    """Counts and sums of ``value`` by event type in tumbling windows."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and return what it wrote, from the shared folder."""
    spark = stream.sparkSession
    out = new_path(spark, "stream")
    if mode == "append":
        stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).outputMode("append").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{out}/rows")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/{number:09d}")
        latest.append(number)

    latest: list[int] = []
    stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).outputMode("complete").start().awaitTermination()
    return spark.read.parquet(f"{out}/rows/{latest[-1]:09d}") if latest else spark.createDataFrame([], stream.schema)
