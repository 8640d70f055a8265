"""Packing documents into few training sequences.

Packing works on the histogram of piece lengths, which has at most ``capacity`` entries however many
pieces there are. Martello-Toth dominance fixes sets that some best solution must contain (or may be
exchanged for): a piece that nothing fits beside, an exactly filling pair, and the largest partner where
no two pieces fit beside. Best fit, longest first, packs the rest. Both give patterns with a number of
sequences; Spark ranks the pieces of each length and looks up the place of each rank.
"""

from __future__ import annotations

import base64
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import as_table

END_ID = 0
SPECIAL = "<|endoftext|>"


class Encoder:
    """Token ids by a tokenizer file; where a rank file of the same vocabulary is given, it does the work.

    Both give equal ids (tested); the rank file is several times faster. A text with the vocabulary's
    special token always takes the tokenizer file, which gives it its own id.
    """

    def __init__(self, tokenizer_path: str, ranks_path: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(tokenizer_path)
        self.fast = None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None and SPECIAL not in text:
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of ``n`` tokens: full ones, but for the first where needed."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def pieces(
    docs: DataFrame, encoder: dict, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False
) -> DataFrame:
    """``(id_col, piece, start, length, ids_crc32[, ids])`` for each piece of each row's ids and end id."""
    names = [id_col, "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(**encoder)
        for batch in batches:
            rows: list[tuple] = []
            arrays: list[np.ndarray] = []
            for row, text in enumerate(batch.column(1).to_pylist()):
                ids = np.append(encode(text or ""), END_ID).astype("<u4")
                for k, (start, n) in enumerate(cut(len(ids), capacity)):
                    part = ids[start : start + n]
                    rows.append((row, k, start, n, zlib.crc32(part.tobytes())))
                    if keep_ids:
                        arrays.append(part.astype(np.int32))
            made = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))] if rows else []
            if made:
                columns = [batch.column(0).take(made[0]), *made[1:], *([pa.array(arrays, pa.list_(pa.int32()))] if keep_ids else [])]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"`{id_col}` {dict(docs.dtypes)[id_col]}, piece int, start long, length long, ids_crc32 long"
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema + ", ids array<int>" * keep_ids)


Pattern = tuple[tuple[tuple[int, int], ...], int]
"""((length, how many), ...) of one sequence, and the number of such sequences."""


def dominant(counts: Counter, capacity: int) -> list[Pattern]:
    """Take sets that dominate all alternatives out of ``counts``; returns them.

    For the piece j and the room beside it: (1) if nothing fits, {j}; (2) if a piece fills the room
    exactly, that pair; (3) if no two pieces fit together, {j, largest that fits}; (4) if no three fit
    and the largest that fits is at least every pair that fits, the same.
    """
    fixed: list[Pattern] = []
    changed = True
    while changed:
        changed = False
        lengths = sorted(x for x in counts if counts[x] > 0)
        for j in reversed(lengths):
            while counts[j] > 0:
                room = capacity - j
                counts[j] -= 1
                there = [x for x in lengths if counts[x] > 0 and x <= room]
                counts[j] += 1
                k = there[-1] if there else None
                if k is None:
                    take, times = ((j, 1),), counts[j]
                elif k == room or _alone(there, counts, j, room, k):
                    take, times = (((j, 1), (k, 1)), min(counts[j], counts[k])) if k != j else (((j, 2),), counts[j] // 2)
                else:
                    break
                for x, n in take:
                    counts[x] -= n * times
                fixed.append((take, times))
                changed = True
    return fixed


def _alone(there: list[int], counts: Counter, j: int, room: int, k: int) -> bool:
    """Whether {j, k} dominates by rule 3 or 4; ``there``: lengths that fit, ascending."""
    least = [x for x in there[:3] for _ in range(min(3, counts[x] - (x == j)))][:3]
    if len(least) < 2 or least[0] + least[1] > room:
        return True
    if len(least) == 3 and sum(least) <= room:
        return False
    best, lo, hi = 0, 0, len(there) - 1
    while lo <= hi:
        if there[lo] + there[hi] > room:
            hi -= 1
        else:
            if lo < hi or counts[there[lo]] - (there[lo] == j) > 1:
                best = max(best, there[lo] + there[hi])
            lo += 1
    return k >= best


def best_fit(counts: Counter, capacity: int) -> list[Pattern]:
    """Best fit, longest first, over a histogram: each step moves whole runs of equal sequences."""
    open_: dict[int, list[list]] = defaultdict(list)
    for length in sorted((x for x in counts if counts[x] > 0), reverse=True):
        left = counts[length]
        while left:
            room = min((r for r in open_ if r >= length and open_[r]), default=None)
            pattern, times = open_[room].pop() if room is not None else ((), left)
            room = capacity if room is None else room
            each = room // length
            full = min(times, left // each)
            rest = left - full * each if full < times and left - full * each < each else 0
            new = not pattern
            if full:
                open_[room - each * length].append([(*pattern, (length, each)), full])
            if rest:
                open_[room - rest * length].append([(*pattern, (length, rest)), 1])
            if not new and times - full - bool(rest):
                open_[room].append([pattern, times - full - bool(rest)])
            left -= full * each + rest
    return [(p, n) for groups in open_.values() for p, n in groups]


def plan(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns that hold each length as often as ``counts`` says."""
    rest = Counter(counts)
    return [*dominant(rest, capacity), *best_fit(rest, capacity)]


def _runs(patterns: list[Pattern]) -> np.ndarray:
    """Rows (length, first rank, pieces a sequence, first sequence, offset), sorted by the first two."""
    rows, ranks, base = [], Counter(), 0
    for pattern, times in patterns:
        offset = 0
        for length, each in pattern:
            rows.append((length, ranks[length], each, base, offset))
            ranks[length] += each * times
            offset += each * length
        base += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(made: DataFrame, capacity: int = 2048, length_col: str = "length", order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``made`` with ``sequence_id`` and ``offset``: few sequences of at most ``capacity``, without gaps.

    ``made`` needs ``length_col`` from 1 to ``capacity`` and must give the same rows each time it is read
    (a table). Only the histogram of lengths reaches the driver, and only the patterns' runs go back.
    Pieces of one length are ranked in salted parts, whose number follows the row count, so that a
    length that many pieces share meets in no single task. Repeated rows get places of their own.
    """
    sizes = {r[0]: r[1] for r in made.groupBy(length_col).count().collect()}
    if any(not 1 <= x <= capacity for x in sizes):
        raise ValueError(f"{length_col} must lie between 1 and {capacity}")
    sent = made.sparkSession.sparkContext.broadcast(_runs(plan(sizes, capacity)))
    salts = max(64, 1 << (sum(sizes.values()) // 1_000_000).bit_length())
    salted = made.withColumn("salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    parts = salted.groupBy(length_col, "salt").count()
    before = F.sum("count").over(Window.partitionBy(length_col).orderBy("salt")) - F.col("count")
    starts = as_table(parts.select(F.col(length_col).alias("of"), F.col("salt").alias("part"), before.alias("before")), "starts")
    ranked = salted.withColumn("place", F.row_number().over(Window.partitionBy(length_col, "salt").orderBy(*order)) - 1)
    # both sides are dealt by length and part already; Spark would broadcast the starts on the size of their file
    ranked = ranked.join(starts.hint("merge"), (F.col(length_col) == F.col("of")) & (F.col("salt") == F.col("part")))
    ranked = ranked.withColumn("rank", F.col("place") + F.col("before")).select(*made.columns, "rank")
    fields = [T.StructField(f.name, f.dataType) for f in made.schema.fields]
    schema = T.StructType([*fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    at = made.columns.index(length_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = sent.value
        keys = runs[:, 0] << 48 | runs[:, 1]
        for batch in batches:
            lengths, ranks = (batch.column(i).to_numpy(zero_copy_only=False) for i in (at, batch.num_columns - 1))
            mine = runs[np.searchsorted(keys, lengths << 48 | ranks, side="right") - 1]
            nth = ranks - mine[:, 1]
            sequence, offset = mine[:, 3] + nth // mine[:, 2], mine[:, 4] + nth % mine[:, 2] * lengths
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=schema.names)

    return ranked.mapInArrow(run, schema)


def pack_documents(
    docs: DataFrame, encoder: dict, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False
) -> DataFrame:
    """Pieces of all documents and their places: ``id_col, piece, start, length, ids_crc32, sequence_id, offset``.

    Each row of ``docs`` is encoded whole, followed by the end id 0; a null text is empty, so it has the
    end id alone. Only documents longer than ``capacity`` are cut. ``keep_ids`` adds the ids. Repeated
    rows and rows with a null id are packed like others; an empty table gives no row. Other columns are
    not read.
    """
    made = as_table(pieces(docs, encoder, capacity, id_col, text_col, keep_ids), "pieces")
    return pack(made, capacity, order=(id_col, "piece", "start", "length", "ids_crc32"))
