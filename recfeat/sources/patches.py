"""Image patches: from landed image files, and to and from JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.image import SHAPE, image_patches
from .ingest import parse_lines, read_lines

_LINE = T.StructType([T.StructField("parent_asin", T.StringType()), T.StructField("patch_b64", T.StringType()), T.StructField("shape", T.ArrayType(T.IntegerType()))])


def landed_patches(spark: SparkSession, path: str) -> DataFrame:
    """``(parent_asin, patch, shape)`` of image files named by their item, decoded by Spark; bad files have no row."""
    rows = spark.read.format("image").option("dropInvalid", True).load(path)
    key = F.regexp_extract("image.origin", r"([^/]+?)(?:\.[^./]*)?$", 1)
    made = rows.select(key.alias("parent_asin"), image_patches("image.data", "image.height", "image.width").alias("patch"))
    return made.where("patch is not null").withColumn("shape", F.array(*map(F.lit, SHAPE)))


def to_lines(patches: DataFrame) -> DataFrame:
    """Patches as the rows of JSON lines, their bytes in base64."""
    return patches.select("parent_asin", F.base64("patch").alias("patch_b64"), "shape")


def from_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Patches and rejects of raw JSON lines; rows without an item, or whose bytes are no base64, are left out."""
    rows, rejects = parse_lines(lines, _LINE)
    made = rows.where(F.trim("parent_asin") != "").select("parent_asin", F.expr("try_to_binary(patch_b64, 'base64')").alias("patch"), "shape")
    return made.where("patch is not null"), rejects


def read_patches(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    return from_lines(read_lines(spark, paths))
