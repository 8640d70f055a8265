"""The test tables as metadata, reviews and patches: once as DataFrames, once as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import enrich, profile
from ..sources.ingest import main_image
from ..tables import as_bucketed

TRAIN_END, VALID_END = "2000-04-11", "2000-12-01"
ITEMS_SENT = 1_000_000
"""Up to so many items meet the sales as a broadcast of the columns in use; more are shuffled with them."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products from ``part``."""
    return table(spark, sf_dir, "part").selectExpr(
        "cast(p_partkey as string) parent_asin",
        "case when p_partkey % 97 = 0 then null else p_type end main_category",
        "p_name product_title",
        "case when p_partkey % 53 = 0 then null else cast(round(p_retailprice * 100) as bigint) end price_cents",
        "array(p_brand, concat('size ', p_size)) features",
        "array(p_name) description",
        "array(named_struct('hi_res', case when p_partkey % 7 = 0 then '' else concat('img://', p_partkey) end, "
        "'large', cast(null as string), 'thumb', '')) images",
    ).withColumn("price", F.col("price_cents") / 100)


def _sold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` and ``orders`` as they are, with item, rating and time: what is shuffled before ``_named`` makes texts of the numbers."""
    ms = F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', cast(o_orderdate as timestamp_ntz))")
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        F.col("l_partkey").cast("string").alias("parent_asin"),
        F.expr("case when l_partkey % 211 = 0 then null else cast(l_quantity as int) % 5 + 1 end").cast("double").alias("rating"),
        F.when(F.col("l_orderkey") % 301 != 0, ms).alias("sort_timestamp"),
        "o_custkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus", "o_orderpriority",
    )


def _named(sold: DataFrame) -> DataFrame:
    whole = lambda c: F.col(c).cast("int").cast("string")
    key = F.concat_ws(
        "|", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("parent_asin"), F.col("l_suppkey").cast("string"),
        whole("l_quantity"), F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"),
    )
    mine = ("parent_asin", "rating", "sort_timestamp", "o_custkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus", "o_orderpriority")
    return sold.select(
        F.col("o_custkey").cast("string").alias("user_id"), "parent_asin", "rating", "sort_timestamp", key.alias("row_key"),
        F.col("l_returnflag").alias("review_title"), F.concat("o_orderpriority", F.lit(" "), "l_linestatus").alias("review_text"),
        *[c for c in sold.columns if c not in mine],
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews from ``lineitem`` and ``orders``; ``row_key`` is unique. Times are read as UTC."""
    return _named(_sold(spark, sf_dir))


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").where("p_partkey % 3 = 0")
    return rows.select(F.col("p_partkey").cast("string").alias("parent_asin"), F.md5(F.col("p_partkey").cast("string").cast("binary")).cast("binary").alias("patch"))


def positives(spark: SparkSession, sf_dir: str, *used: str, items: DataFrame | None = None) -> DataFrame:
    """Enriched reviews: rated, joined, labelled and dated.

    ``used``: the only columns wanted. The items' part of them is narrow, so it is broadcast while items are at most ``ITEMS_SENT``, and the sales are not shuffled by item.
    ``items``: other metadata, one row an item, of any width, which Spark joins as it sees fit.
    """
    if items is not None:
        facts = items.select("parent_asin", *[c for c in items.columns if c in used and c != "parent_asin"])
        return _named(enrich.enrich(_sold(spark, sf_dir), facts)).select(*used or "*")
    made = meta(spark, sf_dir)
    items = enrich.least_row(made, "parent_asin")
    if used:
        facts = items.select("parent_asin", *[c for c in made.columns if c in used and c != "parent_asin"])
        items = F.broadcast(facts) if made.count() <= ITEMS_SENT else facts
    return _named(enrich.enrich(_sold(spark, sf_dir), items)).select(*used or "*")


def ordered(spark: SparkSession, sf_dir: str, *columns: str, items: DataFrame | None = None) -> DataFrame:
    """Positives in the order of their users, as a table dealt by user: profile and negatives read it without a shuffle.

    ``columns`` beside user, position and chunk: each goes through shuffles, so only those that are used. ``items``: as in ``positives``.
    """
    return dealt(spark, sf_dir, *columns, items=items)[0]


def dealt(spark: SparkSession, sf_dir: str, *columns: str, items: DataFrame | None = None) -> tuple[DataFrame, list[str], int]:
    """``ordered``, the keys of its buckets, and their number."""
    needed = dict.fromkeys(("user_id", "row_key", "sort_timestamp", *columns))
    rows, keys, n = profile.dealt(positives(spark, sf_dir, *needed, items=items))
    rows = rows.select(*keys, "pos", "chunk", *columns)
    return as_bucketed(rows, "ordered", *keys, n=n, dealt=True), keys, n


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meta(spark, sf_dir).select("parent_asin", main_image("images").alias("url"), "main_category")


META_SQL = """meta as (
    select cast(p_partkey as varchar) parent_asin, case when p_partkey % 97 = 0 then null else p_type end main_category, p_name product_title,
           case when p_partkey % 53 = 0 then null else cast(round(p_retailprice * 100) as bigint) end price_cents, p_brand, p_size,
           case when p_partkey % 7 = 0 then '' else concat('img://', p_partkey) end url
    from part)"""

REVIEWS_SQL = """reviews as (
    select cast(o.o_custkey as varchar) user_id, cast(l.l_partkey as varchar) parent_asin,
           case when l.l_partkey % 211 = 0 then null else cast(cast(l.l_quantity as int) % 5 + 1 as double) end rating,
           case when l.l_orderkey % 301 = 0 then null else epoch_ms(o.o_orderdate) end sort_timestamp,
           concat_ws('|', cast(l.l_orderkey as varchar), cast(l.l_linenumber as varchar), cast(l.l_partkey as varchar), cast(l.l_suppkey as varchar),
                     cast(cast(l.l_quantity as int) as varchar), cast(cast(round(l.l_extendedprice * 100) as bigint) as varchar)) row_key,
           l.l_returnflag review_title, concat(o.o_orderpriority, ' ', l.l_linestatus) review_text
    from lineitem l join orders o on l.l_orderkey = o.o_orderkey)"""

POSITIVES_SQL = f"""{META_SQL}, {REVIEWS_SQL}, positives as (
    select r.*, m.main_category, m.product_title, m.price_cents, m.p_brand, m.p_size, m.url,
           case when sort_timestamp <> 0 then strftime(make_timestamp(sort_timestamp * 1000), '%Y-%m-%d') end event_date,
           cast(rating >= 4 as int) label_good, cast(rating = 5 as int) label_best
    from reviews r join meta m using (parent_asin) where rating is not null)"""

ORDERED_SQL = f"""{POSITIVES_SQL}, ordered as (
    select *, row_number() over (partition by user_id order by coalesce(sort_timestamp, -1), row_key) pos from positives)"""

SPLIT_SQL = f"case when event_date <= '{TRAIN_END}' then 'train' when event_date <= '{VALID_END}' then 'valid' else 'test' end"
