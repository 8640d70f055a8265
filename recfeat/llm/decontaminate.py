"""Benchmark decontamination by Wu-Manber search over words.

Every run of 13 words of a benchmark item is a pattern. A shift table over hashed blocks of two words says
how far the search may jump; where it says zero, buckets by the block at the pattern's end and the block at
its start select test strings, whose words are compared (Wu and Manber, "A fast algorithm for multi-pattern
searching", 1994). The tables are flat arrays, about 40 bytes for each benchmark word, and reach the workers in
blocks of a bounded number of words. One block is one pass over the documents; with more of them, passes hand
on row numbers and spans, never texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_table, unused_name, utf8

WINDOW = 13
BLOCK_WORDS = 10_000_000
"""Benchmark words whose tables are broadcast at once, at most (about): 400 MB."""
TABLE_BITS = 26
"""The shift table has at most 2 to this power entries of one byte; a collision only shortens a jump."""
SEGMENT_WORDS = 4096

_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words(text: bytes) -> list[bytes]:
    """Runs of ASCII letters (lower-cased), digits and all characters beyond ASCII."""
    return text.translate(_TABLE).split()


def _block(a, b):
    """A block's hash of 32 bits from those of its words; for numbers and arrays of 64 bits."""
    return (a * 0x9E3779B1 + b) & 0xFFFFFFFF


class WuManber:
    """Search for many patterns of one length among words; equal patterns are one, numbered by their place."""

    def __init__(self, blob: bytes, ends: np.ndarray, codes: np.ndarray, starts: np.ndarray, owners: np.ndarray, length: int):
        """``blob``: all words, joined by spaces, word k from ``ends[k]`` to before ``ends[k + 1] - 1``; ``codes``: their hashes.

        ``starts``: the first word of each pattern, ``owners``: the number of its item.
        """
        self.length = m = length
        self.width = b = min(2, m)
        self.jump, self.blob, self.ends = m - b + 1, blob, ends
        before = np.concatenate([codes[:1], codes[:-1]]) if b == 2 else np.zeros_like(codes)
        blocks = _block(before, codes)  # of the words up to each one
        size = 1 << min(TABLE_BITS, max(10, (4 * len(starts) * self.jump).bit_length()))
        self.mask, shift = size - 1, np.full(size, self.jump, dtype=np.uint8)
        for end in range(b, m + 1):  # later ones are shorter and stand
            shift[blocks[starts + end - 1] & np.uint64(self.mask)] = m - end
        self.shift = shift.tobytes()
        keys = blocks[starts + m - 1] << np.uint64(32) | blocks[starts + b - 1]
        texts = np.fromiter((xxhash.xxh3_64_intdigest(blob[i:j]) for i, j in zip(ends[starts].tolist(), (ends[starts + m] - 1).tolist())), np.uint64, len(starts))
        order = np.lexsort((texts, keys))
        keys, texts, starts, owners = keys[order], texts[order], starts[order], owners[order]
        first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (texts[1:] != texts[:-1])]))
        self.keys, self.starts, self.bounds, self.owners = keys[first], starts[first], np.append(first, len(keys)), owners

    def owners_of(self, pattern: int) -> np.ndarray:
        return self.owners[self.bounds[pattern] : self.bounds[pattern + 1]]

    def find(self, text: list) -> Iterator[tuple[int, int]]:
        """``(start, pattern)`` of each occurrence, in order."""
        m, b, shift, mask, keys, blob, ends, n = self.length, self.width, self.shift, self.mask, self.keys, self.blob, self.ends, len(text)
        block = (lambda end: _block(crc32(text[end - 2]), crc32(text[end - 1]))) if b == 2 else (lambda end: crc32(text[end - 1]))
        at = m
        while at <= n:
            key = block(at)
            step = shift[key & mask]
            if step:
                at += step
                continue
            start = at - m
            key = np.uint64(key << 32 | block(start + b))
            k = int(keys.searchsorted(key))
            if k < len(keys) and keys[k] == key:
                here = b" ".join(text[start:at])
                while k < len(keys) and keys[k] == key:
                    s = self.starts[k]
                    if blob[ends[s] : ends[s + m] - 1] == here:
                        yield start, k
                    k += 1
            at += 1


def searchers(items: list[tuple[str, bytes]], window: int = WINDOW) -> tuple[list[str], list[WuManber]]:
    """The item ids, and one searcher for each pattern length; an item of fewer words than ``window`` is one pattern.

    ``items``: ids and words, joined by spaces.
    """
    names = sorted({name for name, _ in items})
    number = {name: k for k, name in enumerate(names)}
    items = [(name, text) for name, text in items if text]
    blob = b" ".join(text for _, text in items)
    split = blob.split(b" ") if blob else []
    ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, split), np.int64, len(split)) + 1)])
    codes = np.fromiter(map(crc32, split), np.uint64, len(split))
    sizes = np.array([text.count(b" ") + 1 for _, text in items], dtype=np.int64)
    firsts, of = np.cumsum(sizes) - sizes, np.array([number[name] for name, _ in items], dtype=np.int64)
    made = []
    for length in np.unique(np.minimum(sizes, window)).tolist():
        mine = np.flatnonzero(np.minimum(sizes, window) == length)
        n = sizes[mine] - length + 1
        starts = np.repeat(firsts[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        made.append(WuManber(blob, ends, codes, starts, np.repeat(of[mine], n).astype(np.int32), length))
    return names, made


def search(text: list, names: list[str], among: list[WuManber]) -> tuple[list[tuple[int, int]], set]:
    """Merged spans of hit words, and the items that occur."""
    found, items = [], set()
    for s in among:
        patterns = set()
        for start, pattern in s.find(text):
            found.append((start, start + s.length))
            patterns.add(pattern)
        for p in patterns:
            items.update(names[k] for k in s.owners_of(p).tolist())
    return merge(found), items


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _segments(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """``(item, words, n)``: long items in overlapping segments, so that none exceeds a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = words(text)
                for at in range(0, max(1, len(w) - window + 1), SEGMENT_WORDS) if w else ():
                    part = w[at : at + SEGMENT_WORDS + window - 1]
                    rows.append((item, b" ".join(part), len(part)))
            columns = zip(*rows) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.binary(), pa.int64()))], names=["item", "words", "n"]
            )

    rows = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), utf8(text_col).alias("t"))
    return rows.mapInArrow(run, "item string, words binary, n long")


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    keep: tuple[str, ...] | list[str] = ("doc_id",),
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """What each row of ``docs`` shares with the benchmark.

    Returns the columns ``keep``, and ``n_words, n_hit, items`` (item ids as strings, sorted), ``spans``
    (start and end of hit words in turn, end exclusive) and ``contaminated`` (some word is hit, and at
    least one in 20), with underscores in front of a name that is among ``keep``.
    An item of fewer words than ``window``, but not none, is one pattern. Null texts have no words; items
    with a null id or no words are left out; equal item ids are one item. Repeated rows each give a row,
    an empty table gives none, and an empty benchmark hits nothing. Other columns are not read.
    """
    spark, keep = docs.sparkSession, list(keep)
    segments = as_table(_segments(benchmark, item_col, item_text_col, window), "segments")
    total = segments.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    inner = [f"k{i}" for i in range(len(keep))]
    kept = [T.StructField(n, docs.schema[c].dataType) for n, c in zip(inner, keep)]
    tail = [
        T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
        T.StructField("spans", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(T.StringType())),
    ]
    rows = docs.select(*[F.col(c).alias(n) for n, c in zip(inner, keep)], utf8(text_col).alias("t"))

    def one_pass(rows: DataFrame, fields: list, block: int, hits_only: bool) -> DataFrame:
        """The last column of ``rows``, searched for the patterns of one block; its other columns stay."""
        part = segments.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == block).select("item", "words")
        sent = spark.sparkContext.broadcast(searchers([(r[0], bytes(r[1])) for r in part.toLocalIterator()], window))
        schema = T.StructType([*fields, *tail])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, among = sent.value
            for batch in batches:
                made, place = [], []
                for row, text in enumerate(batch.column(len(fields)).to_pylist()):
                    w = words(text)
                    spans, items = search(w, names, among)
                    if items or not hits_only:
                        made.append((len(w), sum(b - a for a, b in spans), [x for s in spans for x in s], sorted(items)))
                        place.append(row)
                types = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string()))
                out = [pa.array(c, t) for c, t in zip(zip(*made) if made else ([], [], [], []), types)]
                stay = batch.select(list(range(len(fields)))) if hits_only else None
                columns = stay.take(pa.array(place, pa.int64())).columns if hits_only else batch.columns[: len(fields)]
                yield pa.RecordBatch.from_arrays([*columns, *out], names=schema.names)

        return rows.mapInArrow(run, schema)

    if blocks == 1:
        made = one_pass(rows, kept, 0, False)
    else:  # texts are written once, with numbers, and read by every pass
        numbered = as_table(rows.select(*inner, F.monotonically_increasing_id().alias("row"), "t"), "numbered")
        number = [T.StructField("row", T.LongType())]
        parts = [as_table(one_pass(numbered.select("row", "t"), number, k, k > 0), "hits") for k in range(blocks)]
        found = reduce(DataFrame.unionAll, parts).groupBy("row").agg(
            F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        )

        def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                spans = [merge(list(zip(s[::2], s[1::2]))) for s in batch.column(len(inner) + 1).to_pylist()]
                hits = [sum(b - a for a, b in s) for s in spans]
                flat = pa.array([[x for pair in s for x in pair] for s in spans], pa.list_(pa.int32()))
                columns = [*batch.columns[: len(inner) + 1], pa.array(hits, pa.int64()), flat, batch.column(len(inner) + 2)]
                yield pa.RecordBatch.from_arrays(columns, names=[*inner, *(f.name for f in tail)])

        made = numbered.drop("t").join(found, "row").select(*inner, "n_words", "spans", "items").mapInArrow(merged, T.StructType([*kept, *tail]))
    dirty = F.expr("n_hit > 0 and 20 * n_hit >= n_words")
    made = made.withColumn("contaminated", dirty)
    free = docs.select(*keep)
    return made.select(
        *[F.col(n).alias(c) for n, c in zip(inner, keep)],
        *[F.col(c).alias(unused_name(free, c)) for c in ("n_words", "n_hit", "items", "spans", "contaminated")],
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns; see ``contamination``."""
    found = contamination(docs, benchmark, keep=docs.columns, **how)
    return found.where(~F.col(found.columns[-1])).select(*docs.columns)
