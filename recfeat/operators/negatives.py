"""Items a user has not met, drawn for each positive row from the rest of the pool.

What a user has seen up to a row is a set of pool numbers. A draw is a rank among the numbers outside of it and of the
draws before, by a hash of (row, draw, seed), shifted past those inside: no try fails, draws repeat exactly, and fewer
come out only where fewer are left. Later purchases are not excluded: at that time they are unknown.

A user may hold a large part of all rows. Rows meet by (user, lot, chunk) only; what earlier chunks have seen comes as a bitmap of
pool numbers, of which a user has one for each chunk that brings something new, so never more than the pool has items.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import as_table
from .profile import CHUNK, DEALT, chunked, of_several_chunks, with_carried

POOL, PER_POSITIVE = 10_000, 5
BITMAP = 32_768
"""Bits of one of Spark's bitmaps: the largest pool."""


def candidate_pool(items: DataFrame, key: str = "parent_asin", size: int = POOL, seed: int = 0) -> DataFrame:
    """``(idx, key)``: ``size`` different items with the least hashes, numbered from 0. Never more rows than ``size``."""
    rank = F.md5(F.concat_ws("|", F.col(key), F.lit(str(seed))).cast("binary"))
    chosen = items.where(F.col(key).isNotNull()).select(key).distinct().withColumn("h", rank).orderBy("h", key).limit(size)
    return chosen.select((F.row_number().over(Window.orderBy("h", key)) - 1).cast("long").alias("idx"), key)


_CELL = [*DEALT, "chunk"]


def _carried(mine: DataFrame) -> DataFrame:
    """``(user_id, lot, chunk, bits)``: bitmaps of the pool numbers seen in earlier chunks, for chunks that have any.

    ``mine`` are rows of users of several chunks. Bitmaps are joined along the chunks that bring new numbers; others take the last one before.
    """
    first = mine.where("idx is not null").groupBy("user_id", "idx").agg(F.min("chunk").alias("chunk"))
    new = first.groupBy("user_id", "chunk").agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("idx") + 1)).alias("new"))
    user = Window.partitionBy("user_id").orderBy("chunk")
    # several steps read it; a version is what a user has seen up to and with its chunk
    version = as_table(new.select("user_id", "chunk", F.bitmap_or_agg("new").over(user.rowsBetween(Window.unboundedPreceding, 0)).alias("bits")), "seen")
    has = version.select("user_id", "chunk", F.col("chunk").alias("version"), F.lit(False).alias("asks"))
    asks = mine.select(*_CELL).distinct().select(*_CELL, F.lit(None).cast("long").alias("version"), F.lit(True).alias("asks"))
    last = has.unionByName(asks, allowMissingColumns=True).withColumn("version", F.max("version").over(user.rangeBetween(Window.unboundedPreceding, -1))).where("asks and version is not null")
    last = last.select("user_id", "lot", F.col("chunk").alias("at"), F.col("version").alias("chunk")).join(version, ["user_id", "chunk"])
    return last.select("user_id", "lot", F.col("at").alias("chunk"), "bits")


def _words(keys: list[str], per_positive: int, seed: int) -> np.ndarray:
    """The first 32 bits of the md5 of (row, draw, seed): a line for each row."""
    tails, md5 = [f"|{nth}|{seed}".encode() for nth in range(per_positive)], hashlib.md5
    heads = [f"{key}".encode() for key in keys]
    data = b"".join([md5(head + tail).digest()[:4] for head in heads for tail in tails])
    return np.frombuffer(data, dtype=">u4").astype(np.uint64).reshape(len(keys), per_positive)


def _unseen(words: np.ndarray, numbers: np.ndarray, bits: bytes | None, n_pool: int) -> np.ndarray:
    """The draws of a chunk's rows in their order, a line for each row, -1 where nothing is left; ``numbers``: each row's item, -1 if it is not in the pool.

    A rank is shifted past the row's draws before, counted among what is free at this row, then past the free numbers that are gone since the chunk began.
    Both lists ascend, and the k-th is passed if it is at most the rank plus k.
    """
    taken = np.zeros(n_pool, dtype=bool) if bits is None else np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")[:n_pool].astype(bool)
    free = np.flatnonzero(~taken)
    at = np.flatnonzero(numbers >= 0)
    at = at[~taken[numbers[at]]]
    gone, first = np.unique(np.searchsorted(free, numbers[at]), return_index=True)
    here = at[first] <= np.arange(len(numbers))[:, None]
    least = np.where(here, gone - np.cumsum(here, axis=1) + 1, n_pool + 1)  # the rank from which on each is passed
    left = len(free) - here.sum(axis=1)
    out, before = np.full(words.shape, -1), np.zeros((len(numbers), 0), dtype=np.int64)
    for nth in range(words.shape[1]):
        rank = (words[:, nth] * np.maximum(left - nth, 0).astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        for earlier in before.T:
            rank += earlier <= rank
        before = np.sort(np.column_stack([before, rank]), axis=1)
        rank += (least <= rank[:, None]).sum(axis=1)
        some = left > nth
        out[some, nth] = free[rank[some]]
    return out


def draw_negatives(
    rows: DataFrame, pool: DataFrame, per_positive: int = PER_POSITIVE, seed: int = 0, keep: tuple[str, ...] = (), chunk: int = CHUNK
) -> DataFrame:
    """``(user_id, row_key, pos, *keep, neg_asin, nth)``: ``per_positive`` different unseen items for each of the ``ordered`` rows.

    All that are left where the pool has fewer; none from an empty pool. ``nth`` counts from 1. The one shuffle is by (user, lot), and
    there is none if ``rows`` is a table dealt that way. ``rows`` is read more than once.
    """
    pool = as_table(pool, "pool")
    n_pool = pool.count()  # the pool is bounded by its size parameter
    if n_pool > BITMAP:
        raise ValueError(f"a pool has at most {BITMAP} items")
    placed = chunked(rows, chunk).select(*_CELL, "pos", "row_key", *keep, "parent_asin").join(F.broadcast(pool), "parent_asin", "left")
    cells = placed.groupBy(*_CELL).agg(F.array_sort(F.collect_list(F.struct("pos", "row_key", "idx", *keep)), _by_place).alias("cells"))

    @F.arrow_udf("array<array<int>>")
    def drawn(keys: pa.Array, numbers: pa.Array, bits: pa.Array) -> pa.Array:
        ends = np.cumsum([0, *keys.value_lengths().to_pylist()], dtype=np.int32)
        words = _words(keys.flatten().to_pylist(), per_positive, seed)
        number = numbers.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
        made = [_unseen(words[a:b], number[a:b], x, n_pool) for a, b, x in zip(ends[:-1].tolist(), ends[1:].tolist(), bits.to_pylist())]
        flat = np.concatenate([np.zeros((0, per_positive), dtype=np.int64), *made])
        each = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(flat >= 0).sum(axis=1)], dtype=np.int32)), pa.array(flat[flat >= 0], pa.int32()))
        return pa.ListArray.from_arrays(pa.array(ends), each)

    several = of_several_chunks(placed.select(*_CELL, "pos", "idx"), chunk)
    full = cells.withColumn("bits", F.lit(None).cast("binary")) if several is None else with_carried(cells, _carried(several))
    full = full.withColumn("drawn", drawn(F.col("cells.row_key"), F.col("cells.idx"), F.col("bits")))
    each = full.select("user_id", F.explode(F.arrays_zip("cells", "drawn")).alias("x")).select("user_id", "x.cells", F.posexplode("x.drawn").alias("nth", "idx"))
    each = each.select("user_id", *[F.col(f"cells.{c}").alias(c) for c in ("row_key", "pos", *keep)], "nth", F.col("idx").cast("long").alias("idx"))
    names = pool.select("idx", F.col("parent_asin").alias("neg_asin"))
    return each.join(F.broadcast(names), "idx").select("user_id", "row_key", "pos", *keep, "neg_asin", (F.col("nth") + 1).alias("nth"))


def _by_place(x, y):
    return F.when(x["pos"] < y["pos"], -1).when(x["pos"] > y["pos"], 1).otherwise(0)


def negative_rows(drawn: DataFrame, meta: DataFrame) -> DataFrame:
    """Negatives with their item's metadata; what ``draw_negatives`` has kept of the positive (time, date, past-only profile) stays.

    ``meta`` must have one row an item; items without metadata are left out.
    """
    facts = meta.withColumnRenamed("parent_asin", "neg_asin")
    kept = [c for c in drawn.columns if c not in ("user_id", "row_key", "pos", "neg_asin", "nth")]
    zero = lambda name, kind: F.lit(0).cast(kind).alias(name)
    return drawn.join(facts, "neg_asin").select(
        "user_id", F.col("neg_asin").alias("parent_asin"), "row_key", "nth", *kept, *[c for c in meta.columns if c != "parent_asin"],
        zero("rating", "double"), zero("label_good", "int"), zero("label_best", "int"), zero("helpful_votes", "long"), F.lit(1).alias("is_neg"),
    )
