"""Repeated lines across documents, found with two Bloom filters and confirmed exactly.

Pass 1 hashes every line key into two filters, one for keys seen once and one for keys seen again.
Each task fills its own pair and hands them on in compressed chunks; merging two pairs adds to the
second filter whatever the first filters of both hold, so a key of two documents is never missed.
Pass 2 tests every key against the merged second filter. Only suspected repeats are shuffled, with
their full text, so false positives of the filters cost work but change no result.

The filters' bits follow the input, so that the share of suspects does not grow with it. At most ``MAX_BITS``
of them are held at once: beyond that, the keys' hashes are written once, dealt to blocks, and each block's two passes read
its own hashes alone; then the documents with suspects are read once more for their keys. So texts are read a fixed number of times, whatever
the number of blocks. At the end only documents that lose a line meet their lists of dropped keys; the others, told apart
by a Bloom filter over documents, are neither shuffled nor sent to Python.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ASCII_SPACE, as_table, fresh_path, unused_name, utf8

MIN_BITS, MAX_BITS = 1 << 20, 1 << 30
"""Bits of each filter: at least, and at most at a time (128 MB)."""
LOSER_BITS = 1 << 27
"""Bits of the filter over documents that lose lines, at most; past some ten million of them more documents are shuffled."""
PARTS = 1024
"""Rows of one id, or without one, are told apart by so many parts of their texts' hashes."""
CHUNK_BITS = 1 << 17
KEY_CHARS = 10


def line_key(line: bytes) -> bytes:
    """What lines are compared by: white space at both ends stripped, A-Z lower-cased."""
    return line.strip(ASCII_SPACE).lower()


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode()) >= least)


def _keys(text: bytes, least: int) -> list[bytes]:
    """The different keys of a document that are long enough to count."""
    return [k for k in dict.fromkeys(map(line_key, text.split(b"\n"))) if _long_enough(k, least)]


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), dtype=np.uint64, count=len(keys))


class BitPair:
    """Bloom filters of two probes over ``bits`` bits (a power of two): keys seen, and keys seen again."""

    def __init__(self, bits: int):
        self.mask = np.uint64(bits - 1)
        self.once = np.zeros(bits // 64, dtype=np.uint64)
        self.twice = np.zeros(bits // 64, dtype=np.uint64)

    def probes(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return hashes & self.mask, (hashes >> np.uint64(32)) & self.mask

    @staticmethod
    def put(words: np.ndarray, at: np.ndarray) -> None:
        np.bitwise_or.at(words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))

    @staticmethod
    def get(words: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1

    def add(self, hashes: np.ndarray) -> None:
        """Take in keys, each once for each document that holds it."""
        values, counts = np.unique(hashes, return_counts=True)
        one, two = self.probes(values)
        again = (counts > 1) | (self.get(self.once, one) & self.get(self.once, two))
        for at in (one, two):
            self.put(self.twice, at[again])
            self.put(self.once, at)


def _fill(hashes: DataFrame, read: Callable[[pa.Array], np.ndarray], bits: int) -> DataFrame:
    """One row ``(chunk, once, twice)`` for each task and chunk of the filters in which it set a bit; ``read``: hashes of the first column."""
    span = min(bits, CHUNK_BITS) // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = BitPair(bits)
        for batch in batches:
            mine.add(read(batch.column(0)))
        for c in range(bits // 64 // span):
            once, twice = (w[c * span : (c + 1) * span] for w in (mine.once, mine.twice))
            if once.any():
                yield pa.RecordBatch.from_pydict(
                    {"chunk": pa.array([c], pa.int32()), "once": [zlib.compress(once.tobytes(), 1)], "twice": [zlib.compress(twice.tobytes(), 1)]}
                )

    return hashes.mapInArrow(run, "chunk int, once binary, twice binary")


def _merge(parts: DataFrame) -> DataFrame:
    """The merged second filter, a row ``(chunk, twice)`` for each chunk; one pair is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done():
            return pa.RecordBatch.from_pydict({"chunk": pa.array([now], pa.int32()), "twice": [zlib.compress(twice.tobytes(), 1)]})

        now, once, twice = None, None, None
        for batch in batches:
            for c, a, b in zip(*(batch.column(i).to_pylist() for i in range(3))):
                a, b = (np.frombuffer(zlib.decompress(x), dtype=np.uint64) for x in (a, b))
                if c != now:
                    if now is not None:
                        yield done()
                    now, once, twice = c, a.copy(), b.copy()
                else:
                    twice |= b | (once & a)
                    once |= a
        if now is not None:
            yield done()

    return parts.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(run, "chunk int, twice binary")


def filter_bits(n_bytes: int) -> int:
    """Bits of each filter for so many bytes of text: the power of two from one bit for 12 bytes up."""
    return max(MIN_BITS, 1 << (max(1, n_bytes // 12)).bit_length())


def _second(filled: DataFrame, bits: int) -> Broadcast:
    """The merged second filter, compressed, on all workers."""
    span = min(bits, CHUNK_BITS) // 64
    twice = np.zeros(bits // 64, dtype=np.uint64)
    for c, part in _merge(filled).toLocalIterator():
        twice[c * span : (c + 1) * span] = np.frombuffer(zlib.decompress(part), dtype=np.uint64)
    return filled.sparkSession.sparkContext.broadcast(zlib.compress(twice.tobytes(), 1))


def _seen_again(words: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    mask = np.uint64(bits - 1)
    return BitPair.get(words, hashes & mask) & BitPair.get(words, (hashes >> np.uint64(32)) & mask)


def _keys_of(texts: pa.Array, least: int) -> tuple[list[bytes], list[int]]:
    """The keys of a column of texts, and the row of each."""
    keys, place = [], []
    for row, text in enumerate(texts.to_pylist()):
        own = _keys(text, least)
        keys += own
        place += [row] * len(own)
    return keys, place


def _suspects(rows: DataFrame, least: int, bits: int) -> DataFrame:
    """``(id, part, key)`` of ``rows`` (id, part, t) by one pair of filters."""
    sent = _second(_fill(rows.select("t"), lambda texts: _hashes(_keys_of(texts, least)[0]), bits), bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.frombuffer(zlib.decompress(sent.value), dtype=np.uint64)
        for batch in batches:
            keys, place = _keys_of(batch.column(2), least)
            at = np.flatnonzero(_seen_again(words, _hashes(keys), bits)).tolist()
            stay = batch.select([0, 1]).take(pa.array([place[i] for i in at], pa.int64()))
            yield pa.RecordBatch.from_arrays([*stay.columns, pa.array([keys[i] for i in at], pa.binary())], names=["id", "part", "key"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, part int, key binary")


def _suspects_in_blocks(rows: DataFrame, least: int, bits: int, blocks: int) -> DataFrame:
    """The same by a pair of filters for each block of hashes, one after the other.

    A table of (block, id, part, hash), written once, is all that the blocks read, each its own folder. Documents with suspected hashes are then
    read again, for the keys.
    """
    kind = dict(rows.dtypes)["id"]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, place = _keys_of(batch.column(2), least)
            hashes = _hashes(keys)
            block = (hashes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(blocks)  # apart from the bits that the probes take
            own = batch.select([0, 1]).take(pa.array(place, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(hashes.view(np.int64)), pa.array(block.astype(np.int32))], names=["id", "part", "hash", "block"])

    path, spark = fresh_path(rows.sparkSession, "line_hashes"), rows.sparkSession
    table = rows.mapInArrow(hashed, f"id {kind}, part int, hash long, block int")
    dealt = table.repartition(max(blocks, int(spark.conf.get("spark.sql.shuffle.partitions"))), "block", F.pmod("hash", F.lit(64)))
    dealt.write.partitionBy("block").option("compression", "zstd").parquet(path)
    table, found = spark.read.schema(table.schema).parquet(path), []
    for k in range(blocks):
        mine = table.where(F.col("block") == k).select("hash", "id", "part")
        sent = _second(_fill(mine.select("hash"), lambda hashes: hashes.to_numpy(zero_copy_only=False).view(np.uint64), bits), bits)

        def again(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            words = np.frombuffer(zlib.decompress(sent.value), dtype=np.uint64)
            for batch in batches:
                yield batch.filter(pa.array(_seen_again(words, batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits)))

        found.append(as_table(mine.mapInArrow(again, mine.schema), "suspected_hashes"))
        sent.unpersist()
    hashes = reduce(DataFrame.unionAll, found).groupBy("id", "part").agg(F.collect_set("hash").alias("hashes"))
    wanted = hashes.select(F.col("id").alias("of"), F.col("part").alias("of_part"), "hashes")
    again = rows.join(wanted, F.col("id").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part"))).select("id", "part", "t", "hashes")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, place = _keys_of(batch.column(2), least)
            sets = [frozenset(h) for h in batch.column(3).to_pylist()]
            at = [i for i, (h, row) in enumerate(zip(_hashes(keys).view(np.int64).tolist(), place)) if h in sets[row]]
            stay = batch.select([0, 1]).take(pa.array([place[i] for i in at], pa.int64()))
            yield pa.RecordBatch.from_arrays([*stay.columns, pa.array([keys[i] for i in at], pa.binary())], names=["id", "part", "key"])

    return again.mapInArrow(read, f"id {kind}, part int, key binary")


def _part(text_col: str):
    return F.pmod(F.xxhash64(text_col), F.lit(PARTS)).cast("int")


def suspected_lines(
    docs: DataFrame, id_col: str, text_col: str, least: int = KEY_CHARS, bits: int | None = None, max_bits: int = MAX_BITS
) -> DataFrame:
    """``(id, part, key)``: each document's keys that may be in another document too; misses none that is.

    ``part`` is taken from the text's hash. More than ``max_bits`` are made in blocks, one after the other.
    """
    if bits is None:
        bits = filter_bits(docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0)
    blocks, bits = max(1, bits // max_bits), min(bits, max_bits)
    rows = docs.select(F.col(id_col).alias("id"), _part(text_col).alias("part"), utf8(text_col).alias("t"))
    return _suspects(rows, least, bits) if blocks == 1 else _suspects_in_blocks(rows, least, bits, blocks)


def _may_lose(drops: DataFrame):
    """A function of (id, part): false only for documents that are not in ``drops``. Its filter is bounded."""
    n = drops.count()
    bits = min(LOSER_BITS, max(1 << 12, 1 << (16 * n).bit_length()))
    places = F.explode(F.array(*[F.pmod(F.xxhash64("id", "part", F.lit(k)), F.lit(bits)) for k in range(2)])).alias("at")
    words = drops.select(places).groupBy(F.shiftright("at", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("set")
    ).toArrow()
    table = np.zeros(bits // 64, dtype=np.uint64)
    table[words.column("word").to_numpy()] = words.column("set").to_numpy().view(np.uint64)
    sent = drops.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def probe(one: pd.Series, two: pd.Series) -> pd.Series:
        get = lambda at: BitPair.get(sent.value, at.to_numpy().astype(np.uint64))
        return pd.Series(get(one) & get(two))

    return lambda id_, part: probe(*[F.pmod(F.xxhash64(id_, part, F.lit(k)), F.lit(bits)) for k in range(2)])


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = KEY_CHARS, bits: int | None = None, max_bits: int = MAX_BITS
) -> DataFrame:
    """``docs`` without lines that an earlier document holds too, and two more columns.

    Texts are split at line feeds. A key of at least ``least`` code points found in at least two
    documents loses all its lines except in the document with the least id that holds it (there, all
    stay). ``text_col`` gets the other lines, joined by line feeds; ``n_lines`` (before) and
    ``n_dropped`` are added, with underscores in front where ``docs`` has such columns.
    A null text counts as one empty line and stays null. Rows of equal id are one document. Rows with a
    null id are one document that comes after all others. An empty table gives an empty result. Texts of any length are read
    whole; one must fit a task.
    """
    suspects = as_table(suspected_lines(docs, id_col, text_col, least, bits, max_bits), "suspects")
    seen = suspects.groupBy("key").agg(
        F.min("id").alias("first"), F.max("id").alias("last"), F.max(F.col("id").isNull()).alias("nameless")
    )
    repeated = as_table(seen.where("first <> last or (nameless and first is not null)").select("key", "first"), "repeated")
    drops = (
        suspects.join(repeated, "key").where("id is null or id <> first")
        .groupBy("id", "part").agg(F.collect_set("key").alias("drop"))
    )
    drops = as_table(drops, "drops")
    own, part, drop = (unused_name(docs, n) for n in ("drop_id", "drop_part", "drop_keys"))
    loses = _may_lose(drops)(F.col(id_col), _part(text_col))
    drops = drops.select(F.col("id").alias(own), F.col("part").alias(part), F.col("drop").alias(drop))
    mine = F.col(id_col).eqNullSafe(F.col(own)) & (_part(text_col) == F.col(part))
    joined = docs.where(loses).join(drops, mine, "left").drop(own, part)
    lines, dropped = unused_name(docs, "n_lines"), unused_name(docs, "n_dropped")
    schema = T.StructType([*docs.schema.fields, T.StructField(lines, T.LongType()), T.StructField(dropped, T.LongType())])
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])
    n_lines = F.coalesce(F.length(text_col) - F.length(F.replace(text_col, F.lit("\n"), F.lit(""))) + 1, F.lit(1)).cast("long")
    untouched = docs.where(~loses).select(*docs.columns, n_lines.alias(lines), F.lit(0).cast("long").alias(dropped))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, gone in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                whole = (text or "").split("\n")
                n_lines.append(len(whole))
                if gone and text is not None:
                    gone = set(gone)
                    kept = [x for x in whole if line_key(x.encode()) not in gone]
                    n_dropped.append(len(whole) - len(kept))
                    text = "\n".join(kept)
                else:
                    n_dropped.append(0)
                texts.append(text)
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=schema.names
            )

    return joined.select(*docs.columns, drop).mapInArrow(run, schema).unionByName(untouched)
