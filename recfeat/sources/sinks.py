"""Writers: JSON lines by rows a file, by file count or by split and category, and prediction tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

META_ROWS, REVIEW_ROWS, PATCH_FILES = 100_000, 300_000, 30


def write_json_rows(df: DataFrame, path: str, rows_per_file: int = META_ROWS) -> None:
    """Gzip JSON lines with at most so many rows a file; nulls are written, other scripts stay readable."""
    (df.write.option("maxRecordsPerFile", rows_per_file).option("compression", "gzip").option("ignoreNullFields", "false").json(path))


def write_json_files(df: DataFrame, path: str, files: int = PATCH_FILES) -> None:
    """Gzip JSON lines in so many files."""
    df.repartition(files).write.option("compression", "gzip").option("ignoreNullFields", "false").json(path)


def write_by_split(df: DataFrame, path: str, category: str = "main_category", rows_per_file: int = REVIEW_ROWS, again: bool = False) -> None:
    """JSON lines under ``split=.../main_category=...``; a null category is routed to UNK.

    ``again``: the folders of the splits and categories that ``df`` has are replaced, all others stay as they are; else the path must be new.
    """
    routed = df.withColumn(category, F.coalesce(F.col(category), F.lit("UNK")))
    out = routed.write.partitionBy("split", category).option("maxRecordsPerFile", rows_per_file).option("ignoreNullFields", "false")
    (out.mode("overwrite").option("partitionOverwriteMode", "dynamic") if again else out).json(path)


def read_split(spark: SparkSession, path: str, schema: str, split: str, category: str = "main_category") -> DataFrame:
    """Rows of one split, from its folders alone. ``schema``: of the columns in the files."""
    return spark.read.schema(f"{schema}, split string, `{category}` string").json(path).where(F.col("split") == split)


def write_predictions(df: DataFrame, path: str) -> None:
    """CSV with a header: probability and label of both tasks."""
    df.select("prob_good", "label_good", "prob_best", "label_best").write.option("header", True).csv(path)


def image_urls(meta: DataFrame, image) -> DataFrame:
    """One row for each metadata row (not deduplicated): key, address (may be empty), category."""
    return meta.select("parent_asin", image.alias("url"), "main_category")
