"""Helpers that every operator of this subpackage shares: tables, text columns and free names."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import as_table, own_folder, shared_folder

__all__ = ["ASCII_SPACE", "as_table", "fresh_path", "shared_folder", "table", "unused_name", "utf8"]

ASCII_SPACE = b" \t\n\x0b\x0c\r"
"""The white space of every text contract here: U+0020 and U+0009 to U+000D."""


def utf8(column: str | Column) -> Column:
    """A text column as its UTF-8 bytes; null counts as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("binary")


def unused_name(df: DataFrame, wish: str) -> str:
    """``wish``, or ``wish`` with underscores, so that it clashes with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish = f"_{wish}"
    return wish


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path that does not exist yet, in the application's part of the shared folder."""
    return f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"
