"""Log files as rows, in batch or as a stream, of whole new files or of the lines appended to growing ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions.text import log_fields


def log_rows(lines: DataFrame, column: str = "value") -> DataFrame:
    """ts, level, message, detail_json of log lines; a line of another form keeps its text as message, with null ts and level."""
    ts, level, message, detail = log_fields(F.col(column))
    formed = level.isNotNull()
    return lines.withColumns({"ts": ts, "level": level, "message": F.when(formed, message).otherwise(F.regexp_replace(column, r"^\x{FEFF}", "")), "detail_json": F.when(formed, detail)}).drop(column)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return log_rows(spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).where("trim(value) <> ''"))


def stream_log(spark: SparkSession, path: str) -> DataFrame:
    """Rows of rolled logs: each file is read once, when it appears."""
    return log_rows(spark.readStream.text(path).where("trim(value) <> ''"))


def tail_log(spark: SparkSession, path: str, from_end: bool = False, **options: str) -> DataFrame:
    """Rows of logs that grow: what is appended to any file below a path, from its first line or (from_end) from now on; a file cut short begins again."""
    from folio.sources.tail import TailSource

    spark.dataSource.register(TailSource)
    lines = spark.readStream.format("appended_lines").option("startingPosition", "end" if from_end else "begin").options(**options).load(path)
    return log_rows(lines.where("trim(value) <> ''"))
