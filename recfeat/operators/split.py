"""Union of positives and negatives, split by date without leakage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAIN_END, VALID_END = "2023-06-30", "2023-09-30"


def split_of(date: Column, train_end: str = TRAIN_END, valid_end: str = VALID_END) -> Column:
    """train up to its last day, then valid, then test; a row without a date is test."""
    return F.when(date <= train_end, "train").when(date <= valid_end, "valid").otherwise("test")


def category_of(category: Column) -> Column:
    return F.coalesce(category, F.lit("UNK"))


def split_rows(positives: DataFrame, negatives: DataFrame, train_end: str = TRAIN_END, valid_end: str = VALID_END, drop_null_category: bool = False) -> DataFrame:
    """All rows with ``split``; null categories become UNK, or are left out on demand."""
    both = positives.unionByName(negatives, allowMissingColumns=True)
    both = both.where("main_category is not null") if drop_null_category else both
    return both.withColumn("main_category", category_of(F.col("main_category"))).withColumn("split", split_of(F.col("event_date"), train_end, valid_end))


def parts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Positives and negatives of one plan, without the flag."""
    return rows.where("is_neg = 0").drop("is_neg"), rows.where("is_neg = 1").drop("is_neg")
