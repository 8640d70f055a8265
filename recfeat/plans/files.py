"""Queries that write files with the sinks and read them again with the scans."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import split
from ..schemas import META
from ..sources import images, ingest, patches, sinks
from ..tables import own_folder
from . import adapters as a

ROWS_A_FILE = 500


def _folder(spark: SparkSession, name: str) -> str:
    return f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _gzip_lines(lines: DataFrame, path: str) -> None:
    lines.write.option("compression", "gzip").text(path)


def scan_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw metadata lines landed in two folders, scanned by two globs, cleaned, written by rows a file, and read again.

    Blank lines and broken ones lie between; each row says whether its file keeps the bound on rows.
    """
    part, landed, clean = a.table(spark, sf_dir, "part"), _folder(spark, "landed"), _folder(spark, "clean")
    name = F.col("p_partkey").cast("string")
    record = F.to_json(F.struct(
        name.alias("parent_asin"), F.col("p_name").alias("title"), F.col("p_type").alias("main_category"), F.col("p_retailprice").cast("decimal(12,2)").cast("string").alias("price"),
        F.array("p_brand").alias("features"), F.to_json(F.array(F.struct(F.concat(F.lit("img://"), name).alias("large")))).alias("images"),
    ))
    line = F.when(F.col("p_partkey") % 17 == 0, "").when(F.col("p_partkey") % 17 == 1, F.concat(F.lit("x"), record)).otherwise(record)
    for k in range(2):
        _gzip_lines(part.where(F.col("p_partkey") % 2 == k).select(line), f"{landed}/{k}")
    rows, _ = ingest.read_meta(spark, [f"{landed}/0/*.gz", f"{landed}/1/*.gz"])
    sinks.write_json_rows(ingest.with_key(rows), clean, ROWS_A_FILE)
    back = spark.read.schema(META).json(clean).withColumn("file", F.input_file_name())
    sizes = back.groupBy("file").agg((F.count("*") <= ROWS_A_FILE).alias("fits"))
    return back.join(sizes, "file").select("parent_asin", "title", "main_category", "price", F.array_join("features", ";").alias("features"), ingest.main_image("images").alias("url"), "fits")


SCAN_META_SQL = """select cast(p_partkey as varchar) parent_asin, p_name title, p_type main_category, cast(cast(p_retailprice as decimal(12,2)) as double) price, p_brand features,
    'img://' || p_partkey url, true fits from part where p_partkey % 17 > 1"""


def scan_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw review lines landed as gzip files and scanned by an explicit list of these: rows, rejects and times by user."""
    e, landed = a.table(spark, sf_dir, "events"), _folder(spark, "reviews")
    record = F.to_json(F.struct(
        F.col("user_id").cast("string").alias("user_id"), F.concat(F.lit("A"), F.col("event_id").cast("string")).alias("asin"), F.col("event_type").alias("title"),
        (F.col("event_id") % 5 + 1).alias("rating"), F.col("event_id").alias("timestamp"),
    ))
    _gzip_lines(e.select(F.when(F.col("event_id") % 13 == 0, F.substring(record, 1, 9)).otherwise(record)), landed)
    rows, rejects = ingest.read_reviews(spark, sorted(spark.read.text(landed).inputFiles()))
    good = rows.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("sort_timestamp").alias("times"), F.sum("rating").alias("stars"))
    bad = rejects.groupBy(F.lit("").alias("user_id")).agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("times"), F.lit(0.0).alias("stars"))
    return good.unionByName(bad)


SCAN_REVIEWS_SQL = """select cast(user_id as varchar) user_id, count(*) n, cast(sum(event_id) as bigint) times, cast(sum(event_id % 5 + 1) as double) stars from events where event_id % 13 <> 0 group by 1
union all select '', count(*), 0, 0.0 from events where event_id % 13 = 0 having count(*) > 0"""


def scan_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches written in a fixed number of gzip files and scanned by a glob."""
    path = _folder(spark, "patches")
    sinks.write_json_files(patches.to_lines(a.patches(spark, sf_dir).withColumn("shape", F.array(F.lit(32)))), path)
    files = len(spark.read.text(f"{path}/*.gz").inputFiles())
    back, _ = patches.read_patches(spark, f"{path}/*.gz")
    return back.select("parent_asin", F.col("patch").cast("string").alias("patch"), F.base64("patch").alias("patch_b64"), F.lit(files).cast("long").alias("n_files"))


SCAN_PATCHES_SQL = """select cast(p_partkey as varchar) parent_asin, md5(cast(p_partkey as varchar)) patch, to_base64(encode(md5(cast(p_partkey as varchar)))) patch_b64, cast(30 as bigint) n_files
from part where p_partkey % 3 = 0"""


def image_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The address dump, one line for each metadata row, written and read again."""
    path = _folder(spark, "image_urls")
    made = sinks.image_urls(a.meta(spark, sf_dir), ingest.main_image("images"))
    sinks.write_json_rows(made, path)
    return spark.read.schema(made.schema).json(path)


IMAGE_URLS_SQL = f"with {a.META_SQL} select parent_asin, url, main_category from meta"


def split_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positives written by split and category and read again by these folders."""
    path, rows = _folder(spark, "splits"), a.positives(spark, sf_dir)
    rows = rows.select("user_id", "row_key", "main_category", "label_good", "label_best", split.split_of(F.col("event_date"), a.TRAIN_END, a.VALID_END).alias("split"))
    sinks.write_by_split(rows, path)
    back = spark.read.schema("user_id string, row_key string, label_good int, label_best int, split string, main_category string").json(path)
    return back.groupBy("split", "main_category").agg(
        F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.min("row_key").alias("first_key"), F.sum("label_good").alias("good"), F.sum("label_best").alias("best")
    )


SPLIT_FILES_SQL = f"""with {a.POSITIVES_SQL}
select {a.SPLIT_SQL} split, coalesce(main_category, 'UNK') main_category, count(*) n, count(distinct user_id) users, min(row_key) first_key, cast(sum(label_good) as bigint) good, cast(sum(label_best) as bigint) best
from positives group by 1, 2"""


def split_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positives written by split and category; then the valid split once more, with good rows only: its folders change, the others do not."""
    path, rows = _folder(spark, "splits"), a.positives(spark, sf_dir)
    rows = rows.select("user_id", "main_category", "label_good", split.split_of(F.col("event_date"), a.TRAIN_END, a.VALID_END).alias("split"))
    sinks.write_by_split(rows, path)
    sinks.write_by_split(rows.where("split = 'valid' and label_good = 1"), path, again=True)
    read = [sinks.read_split(spark, path, "user_id string, label_good int", s) for s in ("train", "valid", "test")]
    return read[0].union(read[1]).union(read[2]).groupBy("split", "main_category").agg(F.count("*").alias("n"), F.sum("label_good").alias("good"))


SPLIT_RERUN_SQL = f"""with {a.POSITIVES_SQL}, p as (select {a.SPLIT_SQL} split, coalesce(main_category, 'UNK') main_category, label_good from positives),
kept as (select *, split <> 'valid' or label_good = 1 or main_category not in (select main_category from p where split = 'valid' and label_good = 1) as stays from p)
select split, main_category, count(*) n, cast(sum(label_good) as bigint) good from kept where stays group by 1, 2"""


def fetched_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every address of the metadata fetched by tasks' own threads in batches; addresses that fail have no row."""

    def read(url: str) -> bytes:
        if url.endswith("3"):
            raise OSError("not there")
        return url[::-1].encode()

    got = images.fetch(a.urls(spark, sf_dir), read, batch=16)
    return got.select("parent_asin", "url", F.reverse(F.col("content").cast("string")).alias("content"))


FETCHED_SQL = f"with {a.META_SQL} select parent_asin, url, url as content from meta where url <> '' and url not like '%3'"

QUERIES = {
    "scan_meta": (scan_meta, SCAN_META_SQL), "scan_reviews": (scan_reviews, SCAN_REVIEWS_SQL), "scan_patches": (scan_patches, SCAN_PATCHES_SQL),
    "image_urls": (image_urls, IMAGE_URLS_SQL), "split_files": (split_files, SPLIT_FILES_SQL), "split_rerun": (split_rerun, SPLIT_RERUN_SQL), "fetched_images": (fetched_images, FETCHED_SQL),
}
