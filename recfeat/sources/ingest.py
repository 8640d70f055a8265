"""Landed JSON lines to clean metadata and reviews; what does not parse is set aside, never lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import IMAGE, RAW_META, RAW_REVIEW
from ..tables import as_table

RAW_LINE = "raw"
_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines of all files under the paths or globs (gzip by extension), blank ones dropped. A path without files is an error."""
    return spark.read.text(paths).select(F.col("value").alias(RAW_LINE)).where(F.trim(RAW_LINE) != "")


def parse_lines(lines: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Rows of JSON object lines, and rejects ``(reason, raw)``: each line is in exactly one of them."""
    parsed, bad, reason = _parsed(lines, schema)
    return parsed.where(~bad).select(*[F.col(f"row.{f.name}") for f in schema.fields]), parsed.where(bad).select(reason.alias("reason"), RAW_LINE)


def _parsed(lines: DataFrame, schema: T.StructType) -> tuple[DataFrame, Column, Column]:
    """The lines with their rows, whether one is bad, and why."""
    marked = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    parsed = lines.select(
        RAW_LINE,
        F.from_json(RAW_LINE, marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("row"),
        F.col(RAW_LINE).rlike(r"^\s*\{").alias("object"),
    )
    bad = ~F.col("object") | F.col("row").isNull() | F.col("row._bad").isNotNull()
    return parsed, bad, F.when(~F.col("object"), "not an object").otherwise("malformed")


def parse_counted(lines: DataFrame, schema: T.StructType, counts: Observation) -> DataFrame:
    """The rows of ``parse_lines`` alone; ``counts`` gets ``lines``, ``rows``, ``malformed`` and ``not_object`` in the pass that reads them.

    So an ingest that keeps no rejects learns their number without a second scan, once its first action has run. Give it ``lines`` of a session of
    their own (``newSession``) where Spark ML's models are fitted too: a session's observations do not go to tasks, and some models take the session along.
    """
    parsed, bad, reason = _parsed(lines, schema)
    number = lambda c, name: F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(name)
    seen = parsed.observe(counts, F.count("*").alias("lines"), number(~bad, "rows"), number(bad & (reason == "malformed"), "malformed"), number(bad & (reason != "malformed"), "not_object"))
    return seen.where(~bad).select(*[F.col(f"row.{f.name}") for f in schema.fields])


def item_key(parent: str | Column = "parent_asin", own: str | Column = "asin") -> Column:
    """The item's key: the parent's id, else its own; null if both are blank."""
    parent, own = (F.col(c) if isinstance(c, str) else c for c in (parent, own))
    return F.coalesce(F.nullif(F.trim(parent), F.lit("")), F.nullif(F.trim(own), F.lit("")))


def with_key(rows: DataFrame) -> DataFrame:
    """Rows that have an item key, which replaces ``parent_asin``."""
    return rows.withColumn("parent_asin", item_key()).where("parent_asin is not null")


def price(text: Column) -> Column:
    """A plain decimal number, trimmed and unquoted; anything else (empty, words, nan, inf) is null."""
    bare = F.regexp_replace(text, F.lit('^"|"$'), F.lit(""))
    return F.when(bare.rlike(_NUMBER), F.trim(bare).try_cast("double"))


def details(text: Column) -> Column:
    """A JSON object, or a JSON string that holds one, as a map; else empty."""
    as_map = lambda c: F.from_json(c, T.MapType(T.StringType(), T.StringType()))
    inner = F.get_json_object(F.concat(F.lit('{"v":'), text, F.lit("}")), "$.v")
    return F.coalesce(as_map(F.when(text.rlike(r"^\s*\{"), text)), as_map(F.when(inner.rlike(r"^\s*\{"), inner)), F.create_map().cast("map<string,string>"))


def images(text: Column) -> Column:
    """Images from a list of objects, or from an object of lists, which are zipped to the shortest list."""
    names = ("variant", "hi_res", "large", "thumb")
    listed = F.from_json(F.when(text.rlike(r"^\s*\["), text), T.ArrayType(IMAGE))
    lists = F.from_json(F.when(text.rlike(r"^\s*\{"), text), T.StructType([T.StructField(n, T.ArrayType(T.StringType())) for n in names]))
    present = lambda n: F.coalesce(lists[n], F.array().cast("array<string>"))
    zipped = F.transform(
        F.slice(F.arrays_zip(*[present(n).alias(n) for n in names]), F.lit(1), F.least(*[F.size(present(n)) for n in names])),
        lambda s: F.struct(*[s[n].alias(n) for n in names]),
    )
    return F.coalesce(listed, F.when(lists.isNotNull(), zipped), F.array().cast(T.ArrayType(IMAGE)))


def main_image(column: str | Column = "images") -> Column:
    """The address of the first image, the largest version there is; empty without one."""
    first = F.get(F.col(column) if isinstance(column, str) else column, F.lit(0))
    return F.coalesce(*[F.nullif(first[n], F.lit("")) for n in ("hi_res", "large", "thumb")], F.lit(""))


def description(text: Column) -> Column:
    """A JSON list of strings, or one text as a list of itself; null stays null."""
    listed = F.from_json(F.when(text.rlike(r"^\s*\["), text), "array<string>")
    return F.coalesce(listed, F.when(text.isNotNull(), F.array(text)))


def clean_meta(raw: DataFrame) -> DataFrame:
    """The fields of a product with their types."""
    return raw.select(
        "parent_asin", "asin", "main_category", "title", "average_rating", "rating_number", price(F.col("price")).alias("price"), "store",
        "features", description(F.col("description")).alias("description"), details(F.col("details")).alias("details"),
        images(F.col("images")).alias("images"), "bought_together", "categories",
    )


def parse_variants(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JSON object lines as a VARIANT column ``v``, each parsed once, and rejects ``(reason, raw)``. Text after an object is ignored; doubled keys are malformed."""
    parsed = lines.select(RAW_LINE, F.try_parse_json(RAW_LINE).alias("v"), F.col(RAW_LINE).rlike(r"^\s*\{").alias("object"))
    good = F.col("object") & F.col("v").isNotNull()
    reason = F.when(~F.col("object"), "not an object").otherwise("malformed")
    return parsed.where(good).select("v"), parsed.where(~good).select(reason.alias("reason"), RAW_LINE)


def shredded(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` as a table whose VARIANT columns are shredded: fields of one type lie in columns of their own, and reading one leaves the others alone."""
    for key in ("writeShredding.enabled", "inferShreddingSchema", "pushVariantIntoScan"):
        rows.sparkSession.conf.set(f"spark.sql.variant.{key}", "true")
    return as_table(rows, name)


def clean_variants(rows: DataFrame) -> DataFrame:
    """``clean_meta`` from the VARIANT column ``v``: fields that come in several types are read as each of them, without parsing text again.

    Only details that are themselves a text of JSON are parsed.
    """
    get = lambda path, kind: F.try_variant_get("v", f"$.{path}", kind)
    names = ("variant", "hi_res", "large", "thumb")
    lists = get("images", "struct<" + ",".join(f"{n} array<string>" for n in names) + ">")
    present = lambda n: F.coalesce(lists[n], F.array().cast("array<string>"))
    zipped = F.transform(
        F.slice(F.arrays_zip(*[present(n).alias(n) for n in names]), F.lit(1), F.least(*[F.size(present(n)) for n in names])),
        lambda s: F.struct(*[s[n].alias(n) for n in names]),
    )
    pictures = F.coalesce(get("images", "array<struct<" + ",".join(f"{n} string" for n in names) + ">>"), F.when(lists.isNotNull(), zipped)).cast(T.ArrayType(IMAGE))
    as_map = "map<string,string>"
    inner = F.try_variant_get(F.try_parse_json(get("details", "string")), "$", as_map)
    text = get("description", "string")
    fields = {f.name: f.dataType.simpleString() for f in RAW_META.fields}
    plain = lambda name: get(name, fields[name]).alias(name)
    return rows.select(
        *map(plain, ("parent_asin", "asin", "main_category", "title", "average_rating", "rating_number")), price(get("price", "string")).alias("price"), plain("store"), plain("features"),
        F.coalesce(get("description", "array<string>"), F.when(text.isNotNull(), F.array(text))).alias("description"),
        F.coalesce(get("details", as_map), inner, F.create_map().cast(as_map)).alias("details"),
        F.coalesce(pictures, F.array().cast(T.ArrayType(IMAGE))).alias("images"), plain("bought_together"), plain("categories"),
    )


def clean_reviews(raw: DataFrame) -> DataFrame:
    """The fields of a review, renamed and with defaults."""
    return raw.select(
        "user_id", "asin", F.coalesce("parent_asin", "asin").alias("parent_asin"), "rating", F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("text", F.lit("")).alias("text"), F.col("timestamp").alias("sort_timestamp"),
        F.coalesce("verified_purchase", F.lit(False)).alias("verified_purchase"), F.coalesce("helpful_vote", F.lit(0)).cast("long").alias("helpful_votes"),
    )


def read_meta(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    rows, rejects = parse_lines(read_lines(spark, paths), RAW_META)
    return clean_meta(rows), rejects


def read_reviews(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    rows, rejects = parse_lines(read_lines(spark, paths), RAW_REVIEW)
    return clean_reviews(rows), rejects
