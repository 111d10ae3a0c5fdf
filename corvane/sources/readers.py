"""Readers: JSON Lines with isolated errors, whole text files, term lists, catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corvane.functions.text import strip
from corvane.functions.keyed import uniform

CATALOG = "chamber string, queries array<string>, weight int"
RECORD = "id string, text string, filename string"
SAMPLE = "input_ids array<int>, labels array<int>"


def json_lines(spark: SparkSession, path: str, schema: str = RECORD, glob: str = "*.jsonl", corrupt: bool = True) -> DataFrame:
    """Lines of JSON, blank ones skipped; a malformed line has nulls and its text in ``_corrupt_record``."""
    lines = spark.read.option("pathGlobFilter", glob).text(path).select(strip(F.col("value")).alias("line"), F.col("_metadata.file_path").alias("source_file")).where("line != ''")
    wanted = StructType.fromDDL(schema).add("_corrupt_record", "string")
    rows = lines.select("source_file", F.from_json("line", wanted, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")).select("source_file", "r.*")
    return rows if corrupt else rows.where("_corrupt_record is null").drop("_corrupt_record")


def json_file(spark: SparkSession, path: str, schema: str = CATALOG) -> DataFrame:
    """A whole JSON file; an empty table where it is missing."""
    try:
        return spark.read.schema(schema).json(path, multiLine=True)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def text_files(spark: SparkSession, path: str, glob: str = "*.txt", least: int = 0) -> DataFrame:
    """One row per file: ``path, text`` stripped; files that cannot be read are skipped."""
    rows = spark.read.option("pathGlobFilter", glob).option("ignoreCorruptFiles", "true").text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), strip(F.col("value")).alias("text")).where(F.length("text") >= least)


def term_file(spark: SparkSession, path: str, least: int = 2) -> DataFrame:
    return spark.read.text(path).select(strip(F.col("value")).alias("value")).where(F.length("value") >= least)


def with_text(records: DataFrame, null_policy: str = "skip", least: int = 0) -> DataFrame:
    """Records of :func:`json_lines` whose text has at least ``least`` characters, unstripped; bad lines go.

    A text that is missing or null counts as empty under ``empty`` and goes
    under ``skip``.
    """
    rows = records.where("_corrupt_record is null").drop("_corrupt_record") if "_corrupt_record" in records.columns else records
    if null_policy == "empty":
        rows = rows.withColumn("text", F.coalesce("text", F.lit("")))
    elif null_policy != "skip":
        raise ValueError(f"null_policy is skip or empty, not {null_policy!r}")
    return rows.where(F.length("text") >= least)


def _in_file_order(spark: SparkSession, path: str, schema: str, keep: int) -> DataFrame:
    """The first ``keep`` good lines by file name and place in the file, all where it is 0; ``file, line`` tell the place."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    rows = spark.read.text(path).select(strip(F.col("value")).alias("value"), place.alias("at")).where("value != ''")
    rows = rows.select(F.from_json("value", schema).alias("r"), "at").where("r.input_ids is not null").select("r.*", "at")
    return rows.orderBy("at").limit(keep) if keep else rows


def pretokenized(spark: SparkSession, path: str, max_samples: int = 0, seed: str = "order") -> DataFrame:
    """``input_ids, attention_mask, labels, position`` of samples as JSON Lines, in an order drawn by ``seed``.

    The first ``max_samples`` of the files are taken, all where it is 0. A
    missing mask is all ones, missing labels are all -100.
    """
    from corvane.operators.sampling import with_position

    rows = _in_file_order(spark, path, "input_ids array<int>, attention_mask array<int>, labels array<int>", max_samples)
    ones, none = F.transform("input_ids", lambda _: F.lit(1)), F.transform("input_ids", lambda _: F.lit(-100))
    rows = rows.select("input_ids", F.coalesce("attention_mask", ones).alias("attention_mask"), F.coalesce("labels", none).alias("labels"), uniform(seed, F.to_json("at")).alias("_u"), F.to_json("at").alias("_at"))
    return with_position(rows, ["_u", "_at"]).drop("_u", "_at")


def masked_samples(spark: SparkSession, path: str, cap: int = 1000) -> DataFrame:
    """``sample_id, input_ids, labels`` of the first ``cap`` good lines, all where it is 0: what the analyzer reads."""
    from corvane.operators.sampling import with_position

    rows = _in_file_order(spark, path, "input_ids array<int>, labels array<int>", cap).where("size(input_ids) = size(labels)")
    return with_position(rows, ["at"], "sample_id").select("sample_id", "input_ids", "labels")


def file_stats(records: DataFrame, by: str = "source_file") -> DataFrame:
    """Counts of read, saved, skipped and malformed lines for each file and in all."""
    bad = F.col("_corrupt_record").isNotNull()
    return records.rollup(by).agg(F.count(F.lit(1)).alias("read"), F.count_if(~bad & F.col("text").isNotNull()).alias("saved"), F.count_if(~bad & F.col("text").isNull()).alias("skipped"), F.count_if(bad).alias("errors"))
