"""Reviews joined with product metadata, labelled and dated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STAR_RATE, TOP_RATING, GOOD_RATING = 0.2, 5, 4


def least_row(df: DataFrame, key: str) -> DataFrame:
    """One row for each key, the least by all columns in turn; combines before it shuffles, so hot keys do no harm."""
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.min(F.struct(*rest)).alias("_row"))
    return best.select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def unit_hash(*parts: str | Column, seed: int) -> Column:
    """A number from 0 up to 1 that depends on the parts and the seed alone, so retries and reruns agree."""
    text = F.concat_ws("|", *[F.col(p) if isinstance(p, str) else p for p in parts], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") / float(1 << 32)


def thin_top_ratings(reviews: DataFrame, key: str, rate: float = STAR_RATE, seed: int = 0, top: float = TOP_RATING) -> DataFrame:
    """Keeps about ``rate`` of the rows with the top rating, by the hash of their key, and all others with a rating."""
    return reviews.where("rating is not null").where((F.col("rating") != top) | (unit_hash(key, seed=seed) < rate))


def event_date(ms: Column) -> Column:
    """Epoch milliseconds as a UTC date string, in any session time zone; null and 0 give null."""
    days = F.floor(ms.cast("long") / 86_400_000).cast("int")
    return F.when(ms != 0, F.date_add(F.lit("1970-01-01").cast("date"), days).cast("string"))


def enrich(reviews: DataFrame, meta: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Inner join on the item: all reviews of an item with its one metadata row, dated and labelled.

    ``meta`` must have one row an item (``least_row``). Rows without a rating are left out. Spark picks
    the join; a hot item is split by adaptive execution.
    """
    rated = reviews.where("rating is not null and parent_asin is not null")
    return rated.join(meta, "parent_asin").select(
        *[c for c in rated.columns], *[c for c in meta.columns if c not in rated.columns],
        event_date(F.col("sort_timestamp")).alias("event_date"),
        (F.col("rating") >= GOOD_RATING).cast("int").alias("label_good"), (F.col("rating") == TOP_RATING).cast("int").alias("label_best"),
        F.lit(0).alias("is_neg"),
    )
