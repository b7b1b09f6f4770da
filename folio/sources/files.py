"""Image files, nested folders and archives as manifests; file bytes are not read unless asked for."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions.text import basename, extension, is_image, natural_key, slash_norm
from folio.operators.imports import import_ordinals
from folio.sources.storage import opened


def scan_images(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """path, rel_path, name, ext, size, mtime of images; only listing metadata is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    base = root.rstrip("/").removeprefix("file://").removeprefix("file:")
    rel = F.regexp_replace(F.expr(f"substr(path, instr(path, '{base}') + {len(base)})"), "^/+", "")
    decoded = F.try_url_decode(F.regexp_replace("path", r"\+", "%2B"))
    rows = files.withColumn("path", F.coalesce(decoded, "path")).withColumn("rel_path", rel)
    return rows.where(is_image(F.col("path"))).withColumns({"name": basename(F.col("path")), "ext": extension(F.col("path"))})


def nested_folders(files: DataFrame) -> DataFrame:
    """(rel_path, name) of image files -> (title, page_count, pages) of every folder that holds one itself, pages in natural order."""
    rows = files.withColumn("title", F.regexp_extract("rel_path", r"^(.*)/[^/]+$", 1)).where("title <> ''")
    page = F.struct(natural_key(F.col("name")).alias("k"), F.col("name").alias("n"))
    return rows.groupBy("title").agg(F.count("*").alias("page_count"), F.transform(F.array_sort(F.collect_list(page)), lambda x: x["n"]).alias("pages"))


def scan_nested_folders(spark: SparkSession, root: str) -> DataFrame:
    """nested_folders of the images below root, in natural order of titles."""
    return nested_folders(scan_images(spark, root)).orderBy(natural_key(F.col("title")), "title")


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        out = []
        for path in rows["path"]:
            try:
                with opened(unquote(path)) as f, zipfile.ZipFile(f) as z:
                    out += [(path, e.filename, e.file_size, None) for e in z.infolist() if not e.is_dir()]
            except (zipfile.BadZipFile, OSError, pa.ArrowException, NotImplementedError) as e:
                out.append((path, None, None, str(e)))
        yield pd.DataFrame(out, columns=["path", "zip_entry_name", "size", "error"])


def archive_pages(entries: DataFrame) -> DataFrame:
    """(path, zip_entry_name, size, error) -> the images of each archive with page_ord in natural order; a broken archive stays one error row."""
    good = entries.where("error IS NULL").withColumn("zip_entry_name", slash_norm(F.col("zip_entry_name"))).where(is_image(F.col("zip_entry_name")))
    good = import_ordinals(good.withColumnsRenamed({"path": "archive", "zip_entry_name": "path"}), "archive", "path").withColumnsRenamed({"path": "zip_entry_name", "archive": "path"})
    return good.unionByName(entries.where("error IS NOT NULL").withColumn("page_ord", F.lit(None).cast("int")))


def scan_zip_entries(spark: SparkSession, paths: str) -> DataFrame:
    """archive_pages of the archives below a path.

    Spark lists the archives; a task opens each and reads its end record and its directory alone, by seeking, so an archive may be of any size
    (beyond 4 GB by its Zip64 records).  One that cannot be opened or is no archive is an error row.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", True).load(paths).select("path")
    spread = listed.repartition(spark.sparkContext.defaultParallelism, "path")
    return archive_pages(spread.mapInPandas(_entries, "path string, zip_entry_name string, size long, error string"))
