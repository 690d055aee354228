"""Readers and writers of documents, results, labels and logs kept as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions.text import result_id


def result_files(spark: SparkSession, path: str) -> DataFrame:
    """JSON results with what the file system knows of them: rid, file_name, stage, modified, size, data."""
    raw = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True)
    stem = F.regexp_replace("_metadata.file_name", r"[.]json$", "")
    return raw.select(result_id(stem).alias("rid"), F.col("_metadata.file_name").alias("file_name"), F.nullif(F.regexp_extract(stem, r"[.](0[0-9][a-z]?_[a-z_]+)", 1), F.lit("")).alias("stage"), F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_size").alias("size"), F.col("value").alias("data"))


def label_exports(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Exports that hold one task or a list of tasks; unreadable ones keep their text in _corrupt_record."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").option("recursiveFileLookup", True).json(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def inbox(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """A stream of new files of a folder (path, modificationTime, length, content)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).load(path)


def correction_files(spark: SparkSession, path: str) -> DataFrame:
    """Correction logs at any depth below a folder: their text and file name."""
    raw = spark.read.option("pathGlobFilter", "*.txt").option("recursiveFileLookup", True).text(path, wholetext=True)
    return raw.select(F.col("_metadata.file_name").alias("file_name"), F.trim("value").alias("content"))


def golden_records(spark: SparkSession, path: str) -> DataFrame:
    """Promoted records, a JSON line each: rid, promoted_at, and for a broken line its text as ``error``."""
    raw = spark.read.schema("rid string, promoted_at string, error string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "error").json(path)
    return raw.select("rid", "promoted_at", "error")


def aged(files: DataFrame, now, days: int = 1) -> DataFrame:
    """Files (modified) that are due for the archive: older than so many days at a time."""
    return files.where(F.col("modified") < F.lit(now) - F.make_dt_interval(F.lit(days)))


def write_stages(stages: dict[str, DataFrame], path: str) -> None:
    """Each stage of a run as a table of its own below a folder."""
    for name, df in stages.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def write_training_set(rows: DataFrame, path: str) -> None:
    """The same rows as JSON lines and as CSV with a header."""
    rows.write.mode("overwrite").json(f"{path}/jsonl")
    rows.write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def write_reports(reports: DataFrame, path: str) -> None:
    """A JSON line a document; nulls are left out."""
    reports.write.mode("overwrite").option("ignoreNullFields", True).json(path)


def append_log(items: DataFrame, path: str) -> None:
    """Adds to an append-only correction log."""
    items.write.mode("append").parquet(path)


def tagged_lines(spark: SparkSession, path: str, defaults: dict[str, str]) -> DataFrame:
    """Training lines from CSV or JSON files: camelCase names become snake_case, label becomes role, missing fields their default."""
    import re

    # what the files are shows in their first character, not in their name
    start = spark.read.text(path, wholetext=True).select(F.substring(F.ltrim("value"), 1, 1).alias("c")).where("c <> ''").head()
    is_json = start is not None and start.c in "[{"
    df = spark.read.option("multiLine", start.c == "[").json(path) if is_json else spark.read.option("header", True).csv(path)

    names = {c: re.sub(r"(?<=[a-z])(?=[A-Z])", "_", c).lower() for c in df.columns}
    df = df.withColumnsRenamed({c: "role" if n == "label" else n for c, n in names.items()})
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit(d)).alias(c) if c in df.columns else F.lit(d).alias(c) for c, d in defaults.items()])
