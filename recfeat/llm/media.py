"""Edited and cropped copies of images by local descriptors.

Corners are found in the smoothed image at several scales (Harris response, local maxima). Each gets an
orientation (the intensity centroid of its patch) and 128 binary brightness tests at positions turned by
it; the two points of a test lie across the orientation's axis, so that a bit is set as often as not.
Descriptors meet in Hamming tables: two that differ in at most seven bits differ in at most one bit of one of
four segments of 32 bits, so the queries' segments and all their neighbours at one bit are looked up by
(segment, value) and the complete distance is verified; none within the distance is missed. Bounded blocks of
queries are broadcast, one pass over the gallery for each; candidates are verified and their votes counted
within the task that holds the gallery image. What agrees on one similarity transform (turn, scale step,
shift) votes for it, and enough votes make a match.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_table

SCALES = (1, 2)
RADIUS = 9
TESTS = 128
SEGMENT = 32
MAX_DISTANCE = 2 * (TESTS // SEGMENT) - 1
"""The largest distance of which the tables miss none: beyond it two bits may differ in every segment."""
MIN_VOTES = 4
SMOOTH = 2
"""Pixels at each side over which brightness is averaged before corners and tests."""
SHIFT_BIN = 2.5
TURN_BINS = 12
BLOCK_POINTS = 32_000
"""So many query corners, about, are broadcast at a time: 132 table entries of 12 bytes each."""
CANDIDATES = 2_000_000
"""So many candidates are verified at a time."""
PIXELS = 1 << 19
"""Images of one size are described together up to so many pixels."""
SALTS = 16


def _tests(n: int, reach: float, apart: float) -> np.ndarray:
    """``(2, n, 2)``: pairs of points (y, x) with equal x, at least ``apart`` in y."""
    rng, out = np.random.default_rng(7), []
    while len(out) < n:
        x, y, other = rng.uniform(-reach, reach, 3)
        if abs(y - other) >= apart:
            out.append(((y, x), (other, x)))
    return np.array(out).transpose(1, 0, 2)


_POINTS = _tests(TESTS, RADIUS / 1.5, RADIUS / 3)
_DISK = np.array([(y, x) for y in range(-RADIUS, RADIUS + 1) for x in range(-RADIUS, RADIUS + 1) if x * x + y * y <= RADIUS * RADIUS])


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Sums over squares of side 2r + 1 of the last two axes, zeros outside."""
    for axis in (-2, -1):
        pad = [(0, 0)] * a.ndim
        pad[axis] = (r + 1, r)
        c = np.cumsum(np.pad(a, pad), axis=axis)
        n = a.shape[axis]
        a = np.take(c, np.arange(2 * r + 1, 2 * r + 1 + n), axis=axis) - np.take(c, np.arange(n), axis=axis)
    return a


def _smooth(images: np.ndarray) -> np.ndarray:
    pad = [(0, 0)] * (images.ndim - 2) + [(SMOOTH, SMOOTH)] * 2
    return _box(np.pad(images, pad, mode="edge"), SMOOTH)[..., SMOOTH:-SMOOTH, SMOOTH:-SMOOTH] / (2 * SMOOTH + 1) ** 2


def corners(images: np.ndarray) -> np.ndarray:
    """``(image, y, x)`` of all Harris corners (local maxima of the response) of a stack of images, the strongest of each first.

    They lie far enough from the border for a patch.
    """
    n, h, w = images.shape
    if min(h, w) <= 2 * RADIUS + 2:
        return np.zeros((0, 3), dtype=np.int64)
    gy, gx = np.gradient(images, axis=(1, 2))
    a, b, c = (_box(v, 2) for v in (gx * gx, gy * gy, gx * gy))
    response = a * b - c * c - 0.05 * (a + b) ** 2
    inner = response[:, RADIUS : h - RADIUS, RADIUS : w - RADIUS]
    found = inner > 1e-3
    for i in (-1, 0, 1):
        for j in (-1, 0, 1):
            found &= inner >= response[:, RADIUS + i : h - RADIUS + i, RADIUS + j : w - RADIUS + j]
    k, y, x = np.nonzero(found)
    order = np.lexsort((-inner[k, y, x], k))
    return np.stack([k, y + RADIUS, x + RADIUS], axis=1)[order]


def described_stack(images: np.ndarray) -> dict[str, np.ndarray]:
    """Columns ``image, scale, y, x, angle, bits`` of all corners of a stack of images of one size, by image; y and x in its pixels."""
    parts = []
    for scale in SCALES:
        now = images.astype(np.float64)
        if scale > 1:
            n, h, w = now.shape[0], now.shape[1] // scale, now.shape[2] // scale
            now = now[:, : h * scale, : w * scale].reshape(n, h, scale, w, scale).mean(axis=(2, 4))
        if min(now.shape[1:]) <= 2 * SMOOTH:
            continue
        now = _smooth(now)
        at = corners(now)
        if not len(at):
            continue
        k, y, x = (at[:, i : i + 1] for i in range(3))
        patch = now[k, y + _DISK[:, 0], x + _DISK[:, 1]]
        angle = np.arctan2(patch @ _DISK[:, 0], patch @ _DISK[:, 1])
        cos, sin = np.cos(angle)[:, None], np.sin(angle)[:, None]
        values = [
            now[k, y + np.rint(sin * p[:, 1] + cos * p[:, 0]).astype(int), x + np.rint(cos * p[:, 1] - sin * p[:, 0]).astype(int)] for p in _POINTS
        ]
        bits = np.packbits(values[0] < values[1], axis=1).view(np.uint32)
        parts.append({"image": at[:, 0], "scale": np.full(len(at), scale), "y": at[:, 1] * float(scale), "x": at[:, 2] * float(scale), "angle": angle, "bits": bits})
    if not parts:
        none = np.zeros(0)
        return {"image": none.astype(np.int64), "scale": none.astype(np.int64), "y": none, "x": none, "angle": none, "bits": np.zeros((0, TESTS // SEGMENT), np.uint32)}
    whole = {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
    order = np.argsort(whole["image"], kind="stable")
    return {c: v[order] for c, v in whole.items()}


def describe(image: np.ndarray) -> list[tuple[int, float, float, float, np.ndarray]]:
    """``(scale, y, x, angle, segments)`` of each corner of one image."""
    found = described_stack(image[None])
    return list(zip(*(found[c].tolist() for c in ("scale", "y", "x", "angle")), found["bits"].astype(np.int64)))


def _points_array(found: dict[str, np.ndarray], n: int) -> pa.ListArray:
    """The corners of each of ``n`` images as one list of structs."""
    sizes = np.bincount(found["image"], minlength=n)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    point = np.arange(len(found["image"])) - ends[found["image"]]
    segments = found["bits"].astype(np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(segments) + 1) * segments.shape[1], pa.int32()), pa.array(segments.ravel(), pa.int64()))
    columns = [
        pa.array(point, pa.int32()), pa.array(found["scale"], pa.int32()), *[pa.array(found[c], pa.float64()) for c in ("y", "x", "angle")], lists,
    ]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, ["point", "scale", "y", "x", "angle", "segments"]))


_CORNER = "struct<point:int,scale:int,y:double,x:double,angle:double,segments:array<bigint>>"


def _digest(pixels: bytes | None, h: int | None, w: int | None) -> bytes:
    """Equal for images of equal size and pixels."""
    return hashlib.sha256(f"{h}x{w} ".encode() + (pixels or b"")).digest()


def described(images: DataFrame, id_col: str = "image_id") -> DataFrame:
    """``(image, digest, points)`` of every image: its corners as ``array<struct<point,scale,y,x,angle,segments>>``.

    Images without usable pixels or corners have null points. Equal sizes and pixels have equal digests.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pixels, heights, widths = (batch.column(i).to_pylist() for i in (1, 2, 3))
            digests = pa.array(list(map(_digest, pixels, heights, widths)), pa.binary())
            by_size: dict[tuple[int, int], list[int]] = {}
            rest = []
            for row, (p, h, w) in enumerate(zip(pixels, heights, widths)):
                if p and h and w and len(p) == h * w:
                    by_size.setdefault((h, w), []).append(row)
                else:
                    rest.append(row)
            for (h, w), mine in by_size.items():
                step = max(1, PIXELS // (h * w))
                for at in range(0, len(mine), step):
                    rows = np.array(mine[at : at + step])
                    found = described_stack(np.frombuffer(b"".join(pixels[r] for r in rows), dtype=np.uint8).reshape(-1, h, w))
                    have, found["image"] = np.unique(found["image"], return_inverse=True)
                    rest += np.delete(rows, have).tolist()
                    place = pa.array(rows[have], pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(place), digests.take(place), _points_array(found, len(have))], names=["image", "digest", "points"])
            place, none = pa.array(rest, pa.int64()), _points_array(described_stack(np.zeros((0, 1, 1))), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(place), digests.take(place), pa.nulls(len(rest), none.type)], names=["image", "digest", "points"])

    kind = dict(images.dtypes)[id_col]
    rows = images.select(F.col(id_col), "pixels", "height", "width")
    return rows.mapInArrow(run, f"image {kind}, digest binary, points array<{_CORNER}>")


def descriptors(images: DataFrame, id_col: str = "image_id") -> DataFrame:
    """``(image, point, scale, y, x, angle, segments)`` of every corner of every image.

    ``images`` has ``id_col``, ``pixels`` (binary, one byte a pixel, row by row), ``height``, ``width``.
    Images without pixels, with a size that does not fit them, or too small for a patch have no row.
    """
    return described(images, id_col).where("points is not null").select("image", F.inline("points"))


def content_classes(images: DataFrame, id_col: str = "image_id") -> DataFrame:
    """``(id_col, class_id)``: images of equal size and pixels form a class, named by its least id."""
    digest = F.sha2(F.concat(F.encode(F.concat_ws("x", "height", "width", F.lit(" ")), "utf-8"), F.coalesce("pixels", F.lit(b""))), 256)
    marked = images.select(F.col(id_col), digest.alias("digest"))
    least = marked.groupBy("digest").agg(F.min(id_col).alias("class_id"))
    return marked.join(least, "digest").select(id_col, "class_id")


def _columns(points: pa.ListArray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The image of each corner (by its row) and the corners' columns; ``bits`` has a row of four words."""
    flat = points.flatten()
    out = {name: flat.field(name).to_numpy(zero_copy_only=False) for name in ("point", "scale", "y", "x", "angle")}
    out["bits"] = flat.field("segments").flatten().to_numpy(zero_copy_only=False).astype(np.uint32).reshape(-1, TESTS // SEGMENT)
    return np.repeat(np.arange(len(points)), points.value_lengths().to_numpy(zero_copy_only=False)), out


def _keys(bits: np.ndarray) -> np.ndarray:
    """(segment, value) of each corner's segments as one number."""
    return bits.astype(np.uint64) | np.arange(bits.shape[1], dtype=np.uint64) << np.uint64(SEGMENT)


def _probes(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of all segments and of their neighbours at one bit, and the corner of each."""
    flips = np.concatenate([[0], 1 << np.arange(SEGMENT)]).astype(np.uint64)
    keys = (_keys(bits)[:, :, None] ^ flips).reshape(len(bits), -1)
    order = np.argsort(keys, axis=None)
    return keys.ravel()[order], (order // keys.shape[1]).astype(np.int32)


def _verified(bits: np.ndarray, table: tuple[np.ndarray, np.ndarray], others: np.ndarray, max_distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a query's and a gallery's corner (each once) that meet in a table and are within the distance."""
    keys, owner = table
    wanted = _keys(others).ravel()
    low = np.searchsorted(keys, wanted)
    number = np.searchsorted(keys, wanted, "right") - low
    found, some = [np.zeros(0, dtype=np.int64)], np.flatnonzero(number)
    cuts = np.searchsorted(np.cumsum(number[some]), np.arange(CANDIDATES, int(number.sum()) + CANDIDATES, CANDIDATES), "right")
    for mine in np.split(some, np.unique(cuts)):
        if not len(mine):
            continue
        n = number[mine]
        g = np.repeat(mine // others.shape[1], n)
        q = owner[np.repeat(low[mine] - (np.cumsum(n) - n), n) + np.arange(len(g))].astype(np.int64)
        apart = np.bitwise_count(bits[q, 0] ^ others[g, 0])
        for k in range(1, others.shape[1]):
            apart += np.bitwise_count(bits[q, k] ^ others[g, k])
        near = apart <= max_distance
        found.append(np.unique(q[near] * len(others) + g[near]))
    pairs = np.unique(np.concatenate(found))
    return pairs // max(len(others), 1), pairs % max(len(others), 1)


def _votes(q: dict[str, np.ndarray], g: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The transform of each pair of corners that votes, and the pair: every vote counts in four neighbouring bins."""
    turn = np.rint((q["angle"] - g["angle"]) * TURN_BINS / (2 * np.pi)).astype(np.int64) % TURN_BINS
    angle = turn * (2 * np.pi / TURN_BINS)
    # a corner of scale 1 that meets one of scale 2 is of a copy at half the size
    step = np.rint(np.log2(q["scale"] / g["scale"])).astype(np.int64)
    y, x = (2.0**step * g[c] for c in ("y", "x"))
    # where the image's origin lies in the query under turn and scale: equal for all corners of a true copy
    dy = np.rint((q["y"] - (np.sin(angle) * x + np.cos(angle) * y)) / SHIFT_BIN).astype(np.int64)
    dx = np.rint((q["x"] - (np.cos(angle) * x - np.sin(angle) * y)) / SHIFT_BIN).astype(np.int64)
    # neighbouring bins share their votes, so that a shift near an edge does not split them
    bins = np.concatenate([np.stack([turn, step, dy + a, dx + b], axis=1) for a in (0, 1) for b in (0, 1)])
    return bins, np.tile(np.arange(len(turn)), 4)


def _unique_rows(rows: np.ndarray) -> np.ndarray:
    """The different rows of a table of integers, sorted; as one number a row where they fit into one."""
    low = rows.min(axis=0)
    spans = [int(x) for x in rows.max(axis=0) - low + 1]
    if math.prod(spans) >= 1 << 62:
        return np.unique(rows, axis=0)
    keys = np.zeros(len(rows), dtype=np.int64)
    for k, span in enumerate(spans):
        keys = keys * span + (rows[:, k] - low[k])
    keys, out = np.unique(keys), []
    for span in reversed(spans):
        out.append(keys % span)
        keys = keys // span
    return np.column_stack(out[::-1]) + low


def _counted(images: np.ndarray, points: np.ndarray, bins: np.ndarray, min_votes: int) -> Iterator[tuple[int, int, int]]:
    """``(query, image, votes)``: the most different query corners in one bin, where they are enough."""
    if not len(bins):
        return
    rows = _unique_rows(np.column_stack([images, bins, points]))
    bounds = np.flatnonzero(np.concatenate([[True], (np.diff(rows[:, :-1], axis=0) != 0).any(axis=1)]))
    votes, heads = np.diff(np.append(bounds, len(rows))), rows[bounds, :2]
    heads, votes = heads[votes >= min_votes], votes[votes >= min_votes]
    order = np.lexsort((-votes, heads[:, 1], heads[:, 0]))
    heads, votes = heads[order], votes[order]
    first = np.concatenate([[True], (np.diff(heads, axis=0) != 0).any(axis=1)])[: len(heads)]
    yield from zip(heads[first, 0].tolist(), heads[first, 1].tolist(), votes[first].tolist())


def _match_images(queries: DataFrame, gallery: DataFrame, min_votes: int, max_distance: int, block_points: int) -> DataFrame:
    """``matches`` over two tables of ``described``; the queries in blocks of about so many corners."""
    spark, parts = queries.sparkSession, []
    kinds = dict(queries.dtypes)["image"], dict(gallery.dtypes)["image"]
    schema = f"query {kinds[0]}, image {kinds[1]}, votes long"
    blocks = max(1, -(-(queries.agg(F.sum(F.size("points"))).first()[0] or 0) // block_points))
    for block in range(blocks):
        held = queries.where(F.pmod(F.xxhash64("image"), F.lit(blocks)) == block).toArrow().combine_chunks()
        if not held.num_rows:
            continue
        names = held.column("image").combine_chunks()
        owner, columns = _columns(held.column("points").combine_chunks())
        sent = spark.sparkContext.broadcast((names, owner, columns, _probes(columns["bits"])))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, owner, mine, table = sent.value
            for whole in batches:
                for at in range(0, whole.num_rows, 256):
                    batch = whole.slice(at, 256)
                    image, theirs = _columns(batch.column(1))
                    a, b = _verified(mine["bits"], table, theirs["bits"], max_distance)
                    pair = owner[a] * batch.num_rows + image[b]
                    _, number, n = np.unique(pair, return_inverse=True, return_counts=True)
                    a, b = a[n[number] >= min_votes], b[n[number] >= min_votes]
                    bins, which = _votes({k: v[a] for k, v in mine.items()}, {k: v[b] for k, v in theirs.items()})
                    both = np.column_stack([owner[a], image[b]])[which]
                    got = list(_counted(both, mine["point"][a][which], bins, min_votes))
                    q, g, votes = (pa.array(c, pa.int64()) for c in (zip(*got) if got else ([], [], [])))
                    yield pa.RecordBatch.from_arrays([names.take(q), batch.column(0).take(g), votes], names=["query", "image", "votes"])

        parts.append(as_table(gallery.select("image", "points").mapInArrow(run, schema), "matches"))
        sent.destroy()
    return reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], schema)


def matches(
    queries: DataFrame, gallery: DataFrame, min_votes: int = MIN_VOTES, max_distance: int = MAX_DISTANCE, block_points: int = BLOCK_POINTS
) -> DataFrame:
    """``(query, image, votes)``: images of which a query is a copy, cropped, turned, resized by the ratio of two scales or edited in brightness.

    Both sides are ``descriptors``. ``votes`` counts the query's corners that agree on one transform. No pair of
    corners within ``max_distance`` is missed up to ``MAX_DISTANCE``; beyond it those that differ in more than one
    bit in every segment are.
    """
    point = F.struct("point", "scale", "y", "x", "angle", "segments")
    q, g = (as_table(d.groupBy("image").agg(F.collect_list(point).alias("points")), "points") for d in (queries, gallery))
    return _match_images(q, g, min_votes, max_distance, block_points)


def find_copies(queries: DataFrame, images: DataFrame, id_col: str = "image_id") -> DataFrame:
    """For each row of ``queries`` the images it is a copy of: ``id_col, n_matches, matches, class_id``.

    ``matches`` is ``array<struct<class_id,votes>>`` in order of class: of images with equal pixels only
    the class representative (least id) is matched and named; ``content_classes`` has the members. The
    queries too are matched once for each class of equal queries, whose representative is ``class_id``.
    Images without usable pixels match nothing. Repeated rows each give a row; an empty ``queries`` gives
    none; rows with a null id match nothing; other columns are not read. Of several transforms with equally
    many votes any counts, as only the number of votes is given out.
    """
    parts = []
    for name, df in (("query", queries), ("gallery", images)):  # pixels are read once and never shuffled
        made = as_table(described(df, id_col), f"{name}_points")
        heads = as_table(made.groupBy("digest").agg(F.min("image").alias("class_id"), F.first("points", True).alias("points")), f"{name}_classes")
        parts.append((made, heads, heads.where("class_id is not null and points is not null").select(F.col("class_id").alias("image"), "points")))
    (mine, heads, points), (_, _, gallery) = parts
    mine = mine.join(heads.select("digest", "class_id"), "digest").select(F.col("image").alias(id_col), "class_id")
    found = _match_images(points, gallery, MIN_VOTES, MAX_DISTANCE, BLOCK_POINTS)
    lists = found.groupBy("query").agg(F.array_sort(F.collect_list(F.struct(F.col("image").alias("class_id"), "votes"))).alias("matches"))
    # many queries may be equal: each list goes to every part of its class
    lists = lists.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    mine = mine.withColumn("part", F.pmod(F.xxhash64(id_col, F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
    return mine.join(lists, (mine.class_id == lists.query) & (mine.part == lists.part), "left").select(
        mine[id_col], F.coalesce(F.size("matches"), F.lit(0)).cast("long").alias("n_matches"), F.coalesce("matches", F.array()).alias("matches"), "class_id"
    )


def vector_images(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cell: int = 6) -> DataFrame:
    """One grey image for each vector: its values as a square grid, stretched to 0..255 and enlarged smoothly.

    ``(image_id, pixels, height, width)``; null vectors and those without a full square of two by two
    values give null pixels and size 0. Values past the largest square are not drawn.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pixels, sides = [], []
            for v in batch.column(1).to_pylist():
                n = int(len(v or ()) ** 0.5)
                grid = np.nan_to_num(np.array(v[: n * n], dtype=np.float64)).reshape(n, n) if n > 1 else None
                side = n * cell if n > 1 else 0
                if side:
                    low, high = grid.min(), grid.max()
                    grid = (grid - low) / (high - low if high > low else 1.0)
                    at = np.linspace(0, n - 1, side)
                    a, f = np.minimum(at.astype(int), n - 2), at - np.minimum(at.astype(int), n - 2)
                    rows = grid[a] * (1 - f)[:, None] + grid[a + 1] * f[:, None]
                    grid = rows[:, a] * (1 - f) + rows[:, a + 1] * f
                pixels.append(np.rint(grid * 255).astype(np.uint8).tobytes() if side else None)
                sides.append(side)
            side = pa.array(sides, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pixels, pa.binary()), side, side], names=["image_id", "pixels", "height", "width"])

    kind = dict(vectors.dtypes)[id_col]
    return vectors.select(F.col(id_col), F.col(vector_col)).mapInArrow(run, f"image_id {kind}, pixels binary, height int, width int")


def edited(pixels: np.ndarray, key: int) -> np.ndarray:
    """A copy, edited by rule of the key: cropped by up to 6 pixels at each side, darkened, a third of them turned."""
    top, left, cut = key % 7, key // 7 % 7, key // 49 % 5
    part = pixels[top : pixels.shape[0] - cut, left : pixels.shape[1] - cut]
    part = np.rint(part * (0.7 + 0.05 * (key % 5)) + 10).astype(np.uint8)
    return np.rot90(part) if key % 3 == 0 else part


def edited_images(images: DataFrame) -> DataFrame:
    """``images`` after ``edited``, by the hash of the id; images without pixels stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for pixels, h, w, key in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
                part = edited(np.frombuffer(pixels, dtype=np.uint8).reshape(h, w), key) if pixels else None
                out.append((part.tobytes(), *part.shape) if part is not None else (None, 0, 0))
            columns = zip(*out) if out else ([], [], [])
            made = [pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["image_id", "pixels", "height", "width"])

    keyed = images.select("image_id", "pixels", "height", "width", F.pmod(F.xxhash64("image_id"), F.lit(1 << 20)).alias("key"))
    return keyed.mapInArrow(run, images.schema)
