"""What a user's past says at each of the user's rows: counts, shares, prices, last reviews.

A row sees the rows of its user before it, in the order of timestamp (missing ones first), then row key.
A user may hold a large part of all rows, so no window spans a whole user of very many rows. Such users' positions are numbered within
blocks of time, with the counts of earlier blocks carried in. With positions known, a user's rows are cut
into chunks of equal length; one shuffle by (user, lot) serves positions and all parts of the profile, and what earlier
chunks sum up to comes from a table that only users of more than one chunk are in. A lot is a whole user, or one chunk of a user of very many rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import half_even
from ..tables import as_table

HISTORY = 3
BLOCK_MS = 90 * 24 * 3600 * 1000
ROWS_PER_BLOCK, SAMPLED = 100_000, 32
CHUNK = 128
"""Rows of a user that are windowed together; at least ``HISTORY``."""
UNKNOWN = "UNK"

_PAST = (Window.unboundedPreceding, -1)
_BIG = "decimal(38,0)"
DEALT = ["user_id", "lot"]
_CELL = [*DEALT, "chunk"]
HASHES, ROWS_PER_PART = 1 << 16, 500_000


def _cuts(keyed: DataFrame, heavy: DataFrame, most: int) -> DataFrame:
    """``(user_id, _block, cuts)``: keys that cut each heavy block into parts of about ``most`` rows, from a sample by hash.

    A block of n rows gives about ``SAMPLED`` n / ``most`` keys, so what is collected follows the number of its parts.
    """
    wanted = heavy.select("user_id", "_block", (F.lit(SAMPLED) / most).alias("rate"))
    drawn = keyed.join(wanted, ["user_id", "_block"]).where(F.pmod(F.xxhash64("row_key"), F.lit(1 << 30)) < F.col("rate") * (1 << 30))
    keys = F.sort_array(F.collect_list(F.struct("ts_key", "row_key")))
    some = drawn.groupBy("user_id", "_block").agg(keys.alias("keys"))
    return some.select("user_id", "_block", F.filter("keys", lambda x, i: i % SAMPLED == SAMPLED - 1).alias("cuts"))


def _crowded(keyed: DataFrame, most: int) -> DataFrame:
    """``(_user, _crowded)``: users of more than ``most`` rows.

    Rows are counted by a hash of the user first, which partial aggregates make small whatever the order of the rows; users are counted only where a hash has more.
    """
    hashed = keyed.select("user_id", F.pmod(F.hash("user_id"), F.lit(HASHES)).alias("_hash"))
    full = as_table(hashed.groupBy("_hash").agg(F.count("*").alias("n")).where(F.col("n") > most).select("_hash"), "full_hashes")
    users = hashed.join(F.broadcast(full), "_hash", "left_semi").groupBy("user_id").agg(F.count("*").alias("n")).where(F.col("n") > most)
    return as_table(users.select(F.col("user_id").alias("_user"), F.lit(True).alias("_crowded")), "crowded")


def _time() -> Column:
    return F.coalesce(F.col("sort_timestamp").cast("long"), F.lit(-1))


def dealt(
    rows: DataFrame, block_ms: int = BLOCK_MS, most: int = ROWS_PER_BLOCK, chunk: int = CHUNK, rows_per_part: int = ROWS_PER_PART
) -> tuple[DataFrame, list[str], int]:
    """``ordered`` and ``chunked`` rows in partitions by the user, the keys of these partitions, and their number, which follows the rows.

    ``rows`` is written once. A user of up to ``most`` rows is numbered where it is dealt, so that one shuffle is all. Where users have more, the keys are
    user and ``lot``: 0 for all others, and for them each chunk, from 1 up, after ``ordered``.
    """
    spark, keyed = rows.sparkSession, as_table(rows, "to_order")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-keyed.count() // rows_per_part))
    crowded, same = _crowded(keyed, most), F.col("user_id").eqNullSafe(F.col("_user"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts_key", "row_key")).cast("long")
    nth = F.floor((F.col("pos") - 1) / chunk)
    heavy = keyed.join(crowded, same, "left_semi")
    if as_table(heavy.groupBy("user_id").agg(F.count("*").alias("n")), "blocks").isEmpty():
        return keyed.withColumn("ts_key", _time()).repartition(n, "user_id").withColumn("pos", place).withColumn("chunk", nth), ["user_id"], n
    light = keyed.join(crowded, same, "left_anti").withColumn("ts_key", _time()).withColumn("lot", F.lit(0).cast("long")).repartition(n, *DEALT)
    heavy = ordered(heavy, block_ms, most).withColumn("chunk", nth).withColumn("lot", F.col("chunk") + 1).repartition(n, *DEALT)
    return light.withColumn("pos", place).withColumn("chunk", nth).unionByName(heavy), DEALT, n


def ordered(rows: DataFrame, block_ms: int = BLOCK_MS, most: int = ROWS_PER_BLOCK) -> DataFrame:
    """``rows`` with ``ts_key`` and the user's running position ``pos`` from 1 up.

    ``rows`` is written once, so give only the columns that are needed. Users of up to ``most`` rows are numbered in one window each. Of others,
    rows without a timestamp, which stand in the order of their keys, are cut into blocks by the key's first characters, the rest by time. A block of more
    than ``most`` rows (one user, 90 days) is cut further, by keys from a sample of it, so that no window holds many more. Tables of blocks and cuts
    follow the number of rows of such users over ``most``, and Spark sends them to the rows where they are small.
    """
    keyed = as_table(rows, "to_order").withColumn("ts_key", _time())
    crowded = _crowded(keyed, most)
    start = F.when(F.col("ts_key") == -1, F.coalesce(F.substring("row_key", 1, 4), F.lit(""))).otherwise("")
    block = F.when(F.col("_crowded"), F.struct(F.floor(F.col("ts_key") / block_ms).alias("time"), start.alias("start"), F.lit(0).alias("part")))
    keyed = keyed.join(crowded, F.col("user_id").eqNullSafe(F.col("_user")), "left").withColumn("_block", block).drop("_user")
    counted = lambda: as_table(keyed.where("_crowded").groupBy("user_id", "_block").agg(F.count("*").alias("n")), "blocks")
    same = lambda other: F.col("user_id").eqNullSafe(other["_user"]) & F.col("_block").eqNullSafe(other["_of"])
    totals = counted()
    heavy = totals.where(F.col("n") > most)
    if not heavy.isEmpty():
        key = F.struct("ts_key", "row_key")
        part = F.coalesce(F.size(F.filter("cuts", lambda c: c < key)), F.lit(0))
        cuts = as_table(_cuts(keyed.where("_crowded"), heavy, most), "cuts").withColumnsRenamed({"user_id": "_user", "_block": "_of"})
        cut = keyed.join(cuts, same(cuts), "left")
        keyed = cut.withColumn("_block", F.when(F.col("_crowded"), F.struct("_block.time", "_block.start", part.alias("part")))).drop("cuts", "_user", "_of")
        totals = counted()
    earlier = Window.partitionBy("user_id").orderBy("_block").rowsBetween(*_PAST)
    before = as_table(totals.select(F.col("user_id").alias("_user"), F.col("_block").alias("_of"), F.sum("n").over(earlier).alias("_before")), "before")
    local = Window.partitionBy("user_id", "_block").orderBy("ts_key", "row_key")
    numbered = keyed.withColumn("_here", F.row_number().over(local)).join(before, same(before), "left")
    return numbered.withColumn("pos", F.col("_here") + F.coalesce("_before", F.lit(0))).select(*rows.columns, "ts_key", "pos")


def own_category() -> Column:
    return F.coalesce(F.nullif(F.col("main_category"), F.lit("")), F.lit(UNKNOWN))


def chunked(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``ordered`` rows with ``chunk``, from 0 up, and ``lot``; rows that have them (of the same length) keep them, and with them their partitioning.

    Rows with a chunk and no lot are of users that lie whole (``dealt``).
    """
    if "chunk" in rows.columns:
        return rows if "lot" in rows.columns else rows.withColumn("lot", F.lit(0).cast("long"))
    return rows.withColumn("chunk", F.floor((F.col("pos") - 1) / chunk)).withColumn("lot", F.col("chunk") + 1)


def of_several_chunks(rows: DataFrame, chunk: int) -> DataFrame | None:
    """The ``chunked`` rows of users of more than one chunk; none if there is no such user. Only they have something to carry in."""
    users = as_table(rows.where(F.col("pos") > chunk).select("user_id").distinct(), "several_chunks")
    return None if users.isEmpty() else rows.join(users, "user_id", "left_semi")


def with_carried(rows: DataFrame, carried: DataFrame) -> DataFrame:
    """Left join by cell. The keys are user and lot, so that rows dealt by them stay where they are; the chunk is compared beside."""
    other = carried.withColumnsRenamed({c: f"_{c}" for c in _CELL})
    same = [F.col(c) == F.col(f"_{c}") for c in DEALT]
    return rows.join(other, same[0] & same[1] & (F.col("chunk") - F.col("_chunk") == 0), "left").drop(*[f"_{c}" for c in _CELL])


def _earlier_prices(rows: DataFrame) -> DataFrame:
    """Sums of prices over a user's earlier chunks, for all chunks but the first."""
    cents = F.col("price_cents").cast(_BIG)
    totals = rows.groupBy(*_CELL).agg(F.count("price_cents").alias("n"), F.sum(cents).alias("s"), F.sum((cents * cents).cast(_BIG)).alias("q"))
    past = Window.partitionBy("user_id").orderBy("chunk").rowsBetween(*_PAST)
    return totals.select(*_CELL, *[F.sum(c).over(past).alias(f"{c}_carry") for c in "nsq"]).where("chunk > 0")


def _earlier_categories(mine: DataFrame) -> DataFrame:
    """``carried``: the categories of a user's earlier chunks with their counts, first seen first, for all chunks but the first.

    ``mine`` are rows of users of several chunks. A user's categories meet the user's chunks, not the rows, so the table is shorter than the histograms by
    the chunk's length.
    """
    totals = mine.withColumn("category", own_category()).groupBy(*_CELL, "category").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    seen = totals.groupBy("user_id", "category").agg(F.min("first").alias("first_pos"), F.min("chunk").alias("since"))
    grid = totals.select(*_CELL).distinct().join(seen, "user_id").where("chunk >= since")
    past = Window.partitionBy("user_id", "category").orderBy("chunk").rowsBetween(*_PAST)
    running = grid.join(totals.drop("first"), [*_CELL, "category"], "left").withColumn("n", F.sum("n").over(past)).where("chunk > since")
    entries = F.array_sort(F.collect_list(F.struct("first_pos", "category", "n")))
    return running.groupBy(*_CELL).agg(F.transform(entries, lambda e: F.struct(e["category"].alias("category"), e["n"].alias("n"))).alias("carried"))


def _counted(past: Column) -> Column:
    """The categories of a list of earlier rows with their numbers, in the order of first sight.

    Each row brings its category's first place in the chunk, how often it has come so far, and the place where it comes next: the latest row of each
    category is the one whose next place is not past.
    """
    latest = F.filter(past, lambda e: e["next"].isNull() | (e["next"] >= F.col("pos")))
    return F.transform(F.sort_array(latest), lambda e: F.struct(e["category"].alias("category"), e["n"].alias("n")))


def _joined(carried: Column, here: Column) -> Column:
    """Counts of earlier chunks and of this one."""
    added = F.transform(
        carried,
        lambda e: F.struct(
            e["category"].alias("category"),
            (e["n"] + F.coalesce(F.get(F.filter(here, lambda h: h["category"] == e["category"]), F.lit(0))["n"], F.lit(0))).alias("n"),
        ),
    )
    new = F.filter(here, lambda h: ~F.exists(carried, lambda e: e["category"] == h["category"]))
    return F.when(carried.isNull(), here).otherwise(F.concat(added, new))


def with_past(rows: DataFrame, prices: bool = False, categories: bool = False, reviews: bool = False, keep: int = HISTORY, chunk: int = CHUNK) -> DataFrame:
    """``ordered`` rows with the wanted parts of their past, all from one shuffle and sort.

    ``prices``: ``review_cnt``, ``price_mean`` and ``price_std``. Prices are whole cents (``price_cents``), so sums
    are exact in any order: the mean is null without a price, the sample deviation 0 with fewer than two; both
    are rounded to 4 decimals, half to even. ``categories``: ``shares`` as ``array<struct<category,share>>``, first
    seen first, empty for a user's first row. ``reviews``: ``history``, title and text of the last reviews, oldest first.
    """
    if chunk < keep:
        raise ValueError("a chunk must not be shorter than the history")
    now = chunked(rows, chunk)
    order = Window.partitionBy(*_CELL).orderBy("pos")
    past, made = order.rowsBetween(*_PAST), []
    cents = F.col("price_cents").cast(_BIG)
    piece = F.struct(F.col("review_title").alias("title"), F.col("review_text").alias("text"))
    if prices:
        made += [F.count(cents).over(past).alias("n_here"), F.sum(cents).over(past).alias("s_here"), F.sum((cents * cents).cast(_BIG)).over(past).alias("q_here")]
    if categories:
        alike = Window.partitionBy(*_CELL, own_category()).orderBy("pos")
        sight = F.struct(
            F.first("pos").over(alike).alias("first"), own_category().alias("category"), F.row_number().over(alike).cast("long").alias("n"), F.lead("pos").over(alike).alias("next")
        )
        now = now.withColumn("_sight", sight)
        made.append(F.collect_list("_sight").over(past).alias("seen_here"))
    if reviews:
        made.append(F.collect_list(piece).over(order.rowsBetween(-keep, -1)).alias("reviews_here"))
    now = now.select("*", *made)
    bare, out = of_several_chunks(chunked(rows, chunk), chunk), [*rows.columns]
    if prices:
        if bare is not None:
            now = with_carried(now, _earlier_prices(bare.select(*_CELL, "price_cents")))
        else:
            now = now.withColumns({f"{c}_carry": F.lit(None).cast(_BIG) for c in "nsq"})
        n, s, q = (F.coalesce(F.col(f"{c}_here"), F.lit(0)).cast(_BIG) + F.coalesce(F.col(f"{c}_carry"), F.lit(0)).cast(_BIG) for c in "nsq")
        n, s, q = n.cast("double"), s.cast("double"), q.cast("double")
        spread = F.sqrt(F.greatest(F.lit(0.0), (n * q - s * s)) / (n * (n - 1)))
        out += [
            (F.col("pos") - 1).cast("long").alias("review_cnt"),
            F.when(n > 0, half_even(s / F.nullif(n, F.lit(0.0)) / 100, 4)).alias("price_mean"),
            F.when(n > 1, half_even(spread / 100, 4)).otherwise(0.0).alias("price_std"),
        ]
    if categories:
        now = now.withColumn("counts", _counted(F.col("seen_here")))
        if bare is not None:
            now = with_carried(now, _earlier_categories(bare.select(*_CELL, "pos", "main_category")))
        before = F.col("pos") - 1
        out.append(
            F.transform(
                F.col("counts") if bare is None else _joined(F.col("carried"), F.col("counts")),
                lambda e: F.struct(e["category"].alias("category"), half_even(e["n"] / before, 4).alias("share")),
            ).alias("shares")
        )
    if reviews and bare is None:
        out.append(F.col("reviews_here").alias("history"))
    elif reviews:  # a chunk's first rows see the last reviews of the chunk before
        last = bare.where(F.pmod(F.col("pos") - 1, F.lit(chunk)) >= chunk - keep)
        last = last.groupBy("user_id", F.when(F.col("lot") > 0, F.col("lot") + 1).otherwise(0).alias("lot"), (F.col("chunk") + 1).alias("chunk"))
        now = with_carried(now, last.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", piece.alias("piece")))), lambda x: x["piece"]).alias("reviews_carry")))
        both = F.concat(F.coalesce("reviews_carry", F.array().cast("array<struct<title:string,text:string>>")), "reviews_here")
        out.append(F.when(F.size("reviews_here") >= keep, F.col("reviews_here")).otherwise(F.slice(both, F.greatest(F.size(both) - keep + 1, F.lit(1)), keep)).alias("history"))
    return now.select(*out)


def numeric_profile(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``ordered`` rows with ``review_cnt``, ``price_mean`` and ``price_std`` of the user's past."""
    return with_past(rows, prices=True, chunk=chunk)


def history(rows: DataFrame, keep: int = HISTORY, chunk: int = CHUNK) -> DataFrame:
    """``ordered`` rows with ``history``: title and text of the user's last reviews, oldest first."""
    return with_past(rows, reviews=True, keep=keep, chunk=chunk)


def category_shares(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``ordered`` rows with ``shares``: the past of each row by category, first seen first; empty for a user's first row."""
    return with_past(rows, categories=True, chunk=chunk)


def user_features(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``ordered`` rows with ``user_feat``; a user's first row has an empty map, 0, null, 0.0 and no history."""
    full = with_past(rows, prices=True, categories=True, reviews=True, chunk=chunk)
    feat = F.struct(F.map_from_entries("shares").alias("cat_hist"), "review_cnt", "price_mean", "price_std", "history")
    return full.select(*rows.columns, feat.alias("user_feat"))
