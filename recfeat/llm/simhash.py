"""SimHash near-duplicate groups by multi-index hashing.

A fingerprint is cut into two halves of 32 bits. Two fingerprints that differ in at most three bits
differ in at most one bit within one of the halves, so it is enough to look up, for each half, the
33 values of its Hamming ball of radius one in a table of all halves, and to verify the complete
distance of what is found. Equal fingerprints collapse first, so copies are never expanded to pairs.
Nor are near copies: fingerprints at most two bits apart share a point of their balls of radius one in the
whole space, which at most 65 fingerprints can do, so they are linked point by point; the lookup in halves then
links only fingerprints whose neighbourhoods have different least members, and names those, each once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_table, unused_name, utf8
from .graph import components

SEED = 42
BITS = 64


def fingerprint(text: bytes, width: int = 3) -> int:
    """Majority bits of the XXH64 values of all word shingles of ``text``, repeats included (0 without words)."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype=np.uint64)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, keep: list[str] | None = None, name: str = "fp"
) -> DataFrame:
    """``(id_col, fp)`` of every row, or its columns ``keep`` and the fingerprint, a signed long."""
    keep = [id_col] if keep is None else list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.fromiter((fingerprint(t, width) for t in batch.column(len(keep)).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(made.view(np.int64))], names=[*keep, name])

    rows = docs.select(*[F.col(c) for c in keep], utf8(text_col).alias(name))
    return rows.mapInArrow(run, T.StructType([*(T.StructField(c, docs.schema[c].dataType) for c in keep), T.StructField(name, T.LongType())]))


def ball_masks(bits: int, radius: int) -> list[int]:
    """All masks of ``bits`` bits with at most ``radius`` ones."""
    return [sum(1 << i for i in on) for r in range(radius + 1) for on in combinations(range(bits), r)]


def _spread(fps: DataFrame, rows_each: int = 20_000) -> DataFrame:
    """``fps`` dealt to enough tasks for each row to become many: a table of numbers alone is read by few."""
    parts = max(fps.sparkSession.sparkContext.defaultParallelism, -(-fps.count() // rows_each))
    return fps.repartition(parts, "fp")


def close_pairs(fps: DataFrame, distance: int = 3, segments: int = 2, name: str = "fp") -> DataFrame:
    """Pairs ``(a, b)``, a < b, of different values in ``fps.fp`` at most ``distance`` bits apart, each by its ``name``.

    ``fps`` must hold each value once. The ball radius within a segment is distance // segments. Where
    ``name`` is another column, each pair of different names is given once, however many values link it.
    """
    width = BITS // segments
    values = [F.shiftrightunsigned("fp", width * s).bitwiseAND(F.lit((1 << width) - 1)) for s in range(segments)]
    masks = F.array(*[F.lit(m).cast("long") for m in ball_masks(width, distance // segments)])
    halves = F.explode(F.array(*[F.struct(F.lit(s).alias("s"), v.alias("v")) for s, v in enumerate(values)]))
    rows = fps.select("fp", F.col(name).alias("of"))
    table = rows.select(F.col("fp").alias("b"), F.col("of").alias("of_b"), halves.alias("h")).select("b", "of_b", "h.s", "h.v")
    balls = (
        rows.select(F.col("fp").alias("a"), F.col("of").alias("of_a"), halves.alias("h"))
        .select("a", "of_a", "h.s", F.explode(F.transform(masks, lambda m: m.bitwiseXOR(F.col("h.v")))).alias("v"))
    )
    near = (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance) & (F.col("of_a") != F.col("of_b"))
    # Spark takes the size of exploded rows for that of their source; neither side may be broadcast on that word
    found = balls.join(table.hint("merge"), (balls.s == table.s) & (balls.v == table.v) & (F.col("a") < F.col("b")) & near)
    return found.select(F.least("of_a", "of_b").alias("a"), F.greatest("of_a", "of_b").alias("b")).distinct()


def links(fps: DataFrame, distance: int = 3) -> DataFrame:
    """Edges ``(a, b)`` that connect what a chain of steps of at most ``distance`` bits connects.

    ``fps`` must hold each value once. Their number stays in proportion to that of the values where many lie
    close together: at most 65 a value from shared points, and one for two neighbourhoods that meet.
    """
    if distance < 2:
        return close_pairs(fps, distance)
    masks = F.array(*[F.lit(m - (1 << BITS) if m >> (BITS - 1) else m).cast("long") for m in ball_masks(BITS, 1)])
    points = _spread(fps).select("fp", F.explode(F.transform(masks, lambda m: m.bitwiseXOR(F.col("fp")))).alias("point"))
    shared = points.groupBy("point").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)  # 65 at most
    pair = shared.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b")).where("a <> b")
    two = as_table(pair.distinct(), "two")
    least = two.groupBy("a").agg(F.min("b").alias("b"))
    further = least.select(F.col("a").alias("b"), F.col("b").alias("c"))
    least = least.join(further, "b", "left").select(F.col("a").alias("fp"), F.coalesce("c", "b").alias("hub"))
    named = as_table(fps.join(least, "fp", "left").select("fp", F.coalesce("hub", "fp").alias("hub")), "hubs")
    own = named.where("fp <> hub").select(F.col("fp").alias("a"), F.col("hub").alias("b"))
    return two.unionByName(own).unionByName(close_pairs(_spread(named), distance, name="hub"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 3, width: int = 3
) -> DataFrame:
    """Near-duplicate groups: rows ``(id_col, fp, component_id, group)``, one for each row of ``docs``.

    Fingerprints at most ``distance`` bits apart are linked, and a component is all that links reach;
    ``component_id`` is its least id and ``group`` a fingerprint of it. Null, empty and blank texts have fingerprint zero and are linked
    like others. Rows with a null id take part and get the component of their text (null if no row
    there has an id). Repeated rows each give a row; an empty table gives none; other columns are
    neither read nor returned.
    """
    marked = as_table(fingerprints(docs, id_col, text_col, width), "fingerprints")
    nodes = marked.groupBy("fp").agg(F.min(id_col).alias("least_id"))
    nodes = as_table(nodes, "nodes")
    member = as_table(components(links(nodes.select("fp"), distance)), "components")
    grouped = nodes.join(member, nodes.fp == member.node, "left").select(
        "fp", "least_id", F.coalesce("component", "fp").alias("group")
    )
    least = grouped.groupBy("group").agg(F.min("least_id").alias("component_id"))
    named = as_table(grouped.join(least, "group").select("fp", "component_id", "group"), "named")
    return marked.join(named, "fp").select(id_col, "fp", "component_id", "group")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each near-duplicate group: that with the least id.

    Every row is judged by its own text. Of several rows with the group's least id (an id may stand for
    several texts) in one group the one with the least fingerprint, then text, stays; of equal rows one does. Rows with a
    null id cannot be told apart by the group's least id and all stay.
    """
    own, fp = unused_name(docs, "own_id"), unused_name(docs, "fp")
    found = near_duplicates(docs, id_col, text_col)
    ids = found.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias(own)).agg(F.count("*").alias("n"), F.min("component_id").alias("least"))
    # what goes is listed, not what stays: it is the shorter list, and small enough to be broadcast more often
    gone = as_table(ids.where((F.col(own) != F.col("least")) | (F.col("n") > 1)), "gone")
    same = F.col(id_col) == F.col(own)
    kept = docs.join(gone.select(own), same, "left_anti")
    repeated = gone.where("n > 1").select(own)
    if repeated.isEmpty():  # texts are read a second time only where ids repeat
        return kept
    again = docs.join(repeated, same, "left_semi")
    judged = fingerprints(again, id_col, text_col, keep=docs.columns, name=fp)
    # groups of different texts may share their least id
    first = found.join(repeated, same, "left_semi").where(F.col(id_col) == F.col("component_id"))
    first = first.groupBy(F.col(id_col).alias(own), "group").agg(F.min("fp").alias("least")).select(own, "least")
    mine = judged.join(first, (F.col(id_col) == F.col(own)) & (F.col(fp) == F.col("least")))
    whole = F.struct(*[F.col(c) for c in docs.columns])
    one = mine.groupBy(F.col(own).alias("of"), F.col("least").alias("text_of")).agg(F.min_by(whole, F.coalesce(text_col, F.lit(""))).alias("row"))
    return kept.unionByName(one.select(*[F.col("row")[c].alias(c) for c in docs.columns]))
