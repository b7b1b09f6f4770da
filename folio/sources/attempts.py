"""Per-attempt artifacts: runs/<run>/pages/<page>/attempt-<n>/result.json and overlay-items.json."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

RESULT_SCHEMA = "createdAt string, outputText string, errorMessage string, settings struct<model:string,promptVariant:string,maxTokens:int,temperature:double>"
ITEMS_SCHEMA = "items array<struct<id:int,type:string,bbox:struct<x:double,y:double,w:double,h:double>,jp:string,ko:string>>"
_PATH = r"/runs/([^/]+)/pages/([^/]+)/attempt-([0-9]+)/"


def _placed(rows: DataFrame) -> DataFrame:
    p = F.col("_metadata.file_path")
    part = lambda k: F.try_url_decode(F.regexp_extract(p, _PATH, k))
    return rows.select(part(1).alias("run_id"), part(2).alias("page_id"), F.regexp_extract(p, _PATH, 3).try_cast("int").alias("attempt"), "*")


def scan_attempts(spark: SparkSession, root: str) -> DataFrame:
    """run_id, page_id, attempt, ok, output_text, error_message, created_at, settings, items of every attempt."""
    read = lambda schema, name: _placed(spark.read.schema(schema).option("multiLine", True).json(f"{root}/runs/*/pages/*/attempt-*/{name}"))
    results = read(RESULT_SCHEMA, "result.json")
    try:
        items = read(ITEMS_SCHEMA, "overlay-items.json")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise  # else no attempt has got as far as items
        items = spark.createDataFrame([], f"run_id string, page_id string, attempt int, {ITEMS_SCHEMA}")
    rows = results.join(items, ["run_id", "page_id", "attempt"], "left")
    return rows.select("run_id", "page_id", "attempt", F.col("items").isNotNull().alias("ok"), F.col("outputText").alias("output_text"), F.col("errorMessage").alias("error_message"), F.try_to_timestamp("createdAt").alias("created_at"), "settings", "items")


def write_attempts(attempts: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Attempts (run_id, page_id, attempt, output_text, error_message, created_at, settings, items) as JSON lines, a folder per run."""
    attempts.write.partitionBy("run_id").mode(mode).json(path)


def read_attempts(spark: SparkSession, path: str) -> DataFrame:
    """What write_attempts wrote, as scan_attempts gives it."""
    parts = {f.name: f.dataType.simpleString() for f in StructType.fromDDL(f"{RESULT_SCHEMA}, {ITEMS_SCHEMA}")}
    schema = f"run_id string, page_id string, attempt int, output_text string, error_message string, created_at timestamp, settings {parts['settings']}, items {parts['items']}"
    return spark.read.schema(schema).json(path).select("run_id", "page_id", "attempt", F.col("items").isNotNull().alias("ok"), "output_text", "error_message", "created_at", "settings", "items")


def overlay_documents(items: DataFrame, key: str = "page_id", order: str = "id") -> DataFrame:
    """(key, json) with {"items": [...]} in order (items of one number by their contents), one per page attempt."""
    item = F.struct(F.col(order).alias("id"), "type", "bbox", "jp", "ko")
    return items.groupBy(key).agg(F.to_json(F.struct(F.sort_array(F.collect_list(item)).alias("items"))).alias("json"))


def write_overlay_items(items: DataFrame, path: str, key: str = "page_id", order: str = "id") -> None:
    overlay_documents(items, key, order).write.json(path)


def write_requests(requests: DataFrame, path: str) -> None:
    """JSON lines of request bodies (column body), in as many files as partitions; nothing is sent."""
    requests.select(F.col("body").alias("value")).write.text(path)
