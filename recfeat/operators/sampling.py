"""Repeatable shuffles and splits of samples over workers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUFFER = 512


def worker_of(key: str, workers: int) -> Column:
    """The worker a sample goes to: each to exactly one."""
    return F.pmod(F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(workers))


def shuffle_key(key: str, epoch: int, seed: int = 0) -> Column:
    return F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(epoch)), F.lit(str(seed))).cast("binary"))


def shuffled(df: DataFrame, key: str, epoch: int, seed: int = 0, parts: int = 8) -> DataFrame:
    """Rows in a new order for each epoch, with ``part``: each worker's rows lie together, ordered by another hash."""
    dealt = df.withColumn("part", worker_of(key, parts)).repartition(parts, "part")
    return dealt.sortWithinPartitions("part", shuffle_key(key, epoch, seed))


def draws(seed: int, epoch: int, part: int) -> np.random.Generator:
    """The draws of one part in one epoch."""
    return np.random.Generator(np.random.Philox([seed, epoch, part]))


def buffered(df: DataFrame, epoch: int, seed: int = 0, size: int = BUFFER) -> DataFrame:
    """Each partition's rows in the order in which they leave a buffer of ``size`` rows.

    A row that comes to the full buffer takes the place of one that is drawn, which leaves; at the end the rest leaves in drawn order. So rows
    stream through, one task holds the buffer and one batch, and a partition that is read again in the same order gives the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = draws(seed, epoch, TaskContext.get().partitionId())
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            kept = list(range(min(size, rows.num_rows)))
            new = range(len(kept), rows.num_rows)
            out = []
            for row, at in zip(new, draw.integers(0, size, len(new)).tolist()):
                out.append(kept[at])
                kept[at] = row
            yield from rows.take(pa.array(out, pa.int64())).to_batches()
            held = rows.take(pa.array(kept, pa.int64()))
        if held is not None:
            yield from held.take(draw.permutation(held.num_rows)).to_batches()

    return df.mapInArrow(run, df.schema)
