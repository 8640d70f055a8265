"""Pixels to patches and back, in Arrow batches over binary columns."""

import struct
import zlib
from collections.abc import Callable
from typing import Iterator  # what Spark looks for in a function's hints

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIDE, PATCH = 224, 16
SHAPE = [196, 3, 16, 16]
# Channel means and deviations that pixel values are standardised with.
MEAN = (0.485, 0.456, 0.406)
STD = (0.229, 0.224, 0.225)


def resize(pixels: np.ndarray, shorter: int) -> np.ndarray:
    """(channel, height, width) with the shorter side at ``shorter``, bilinear."""
    _, h, w = pixels.shape
    scale = shorter / min(h, w)
    axes = []
    for n in (h, w):
        size = max(1, round(n * scale))
        at = np.clip((np.arange(size) + 0.5) / scale - 0.5, 0, n - 1)
        low = np.minimum(at.astype(int), max(0, n - 2))
        axes.append((low, np.minimum(low + 1, n - 1), at - low))
    (y0, y1, fy), (x0, x1, fx) = axes
    rows = pixels[:, y0] * (1 - fy)[None, :, None] + pixels[:, y1] * fy[None, :, None]
    out = rows[:, :, x0] * (1 - fx) + rows[:, :, x1] * fx
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def centre_crop(pixels: np.ndarray, side: int = SIDE) -> np.ndarray:
    _, h, w = pixels.shape
    top, left = (h - side) // 2, (w - side) // 2
    return pixels[:, top : top + side, left : left + side]


def to_patches(pixels: np.ndarray) -> np.ndarray:
    """(3, 224, 224) to (196, 768): the grid row by row, channels first within a patch."""
    n = SIDE // PATCH
    return pixels.reshape(3, n, PATCH, n, PATCH).transpose(1, 3, 0, 2, 4).reshape(n * n, -1)


def from_patches(patches: np.ndarray) -> np.ndarray:
    n = SIDE // PATCH
    return patches.reshape(n, n, 3, PATCH, PATCH).transpose(2, 0, 3, 1, 4).reshape(3, SIDE, SIDE)


AT_ONCE = 64
"""Images of so many rows are made together; what a worker holds does not follow the rows of a batch."""


def _few(kind: pa.DataType, make: Callable[..., object]) -> Callable[[Iterator], Iterator[pa.Array]]:
    """An iterator function over Arrow columns that hands on ``make`` of each row, a few rows at a time."""

    def run(batches: Iterator) -> Iterator[pa.Array]:
        for batch in batches:
            columns = batch if isinstance(batch, tuple) else (batch,)
            for at in range(0, len(columns[0]), AT_ONCE):
                yield pa.array([make(*row) for row in zip(*(c.slice(at, AT_ONCE).to_pylist() for c in columns))], kind)

    return run


def _patches_of(raw: bytes | None, h: int | None, w: int | None) -> bytes | None:
    if raw is None or h is None or w is None or h < 1 or w < 1 or len(raw) not in (h * w, 3 * h * w, 4 * h * w):
        return None
    bgr = np.frombuffer(raw, dtype=np.uint8).reshape(h, w, -1)[:, :, :3]
    rgb = np.broadcast_to(bgr, (h, w, 3))[:, :, ::-1].transpose(2, 0, 1)
    return to_patches(centre_crop(resize(rgb, 256))).tobytes()


@F.arrow_udf(T.BinaryType())
def image_patches(columns: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    """Patches of Spark image rows (BGR bytes, row by row, height and width): 256 shorter side, centre crop, patchify.

    Grey images are repeated for each channel, a fourth channel is left out; other rows give null.
    """
    return _few(pa.binary(), _patches_of)(columns)


def _whole(raw: bytes | None) -> bool:
    return raw is not None and len(raw) == 3 * SIDE * SIDE


@F.arrow_udf(T.BinaryType())
def patchify(pixels: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Patches of (3, 224, 224) bytes; bytes of another length give null."""
    return _few(pa.binary(), lambda b: to_patches(np.frombuffer(b, dtype=np.uint8)).tobytes() if _whole(b) else None)(pixels)


_VALUES = np.stack([(np.arange(256, dtype=np.float32) / 255 - np.float32(m)) / np.float32(s) for m, s in zip(MEAN, STD)])
"""The standardised value of each byte in each channel."""


def _standardised(raw: bytes | None) -> np.ndarray:
    if not _whole(raw):
        return np.zeros(3 * SIDE * SIDE, dtype=np.float32)
    image = from_patches(np.frombuffer(raw, dtype=np.uint8))
    return np.concatenate([np.take(v, c).reshape(-1) for v, c in zip(_VALUES, image)])


@F.arrow_udf(T.ArrayType(T.FloatType()))
def pixel_values(patches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Patch bytes to standardised pixel values (3 * 224 * 224, channel first); anything else gives an image of zeros."""
    for batch in patches:
        for at in range(0, len(batch), AT_ONCE):
            rows = [_standardised(raw) for raw in batch.slice(at, AT_ONCE).to_pylist()]
            ends = np.arange(len(rows) + 1, dtype=np.int32) * (3 * SIDE * SIDE)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows)))


def over_pixel_values(patches: Column, use: Callable[[np.ndarray], object], kind: T.DataType, arrow: pa.DataType) -> Column:
    """``use`` of each image's ``pixel_values``, where they are made: 600 kB of values an image do not leave the worker. ``arrow`` is ``kind`` as an Arrow type."""

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _few(arrow, lambda raw: use(_standardised(raw)))(batches)

    return run(patches)


@F.arrow_udf(T.BinaryType())
def unpatchify(patches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Patch bytes to (3, 224, 224) bytes."""
    return _few(pa.binary(), lambda b: from_patches(np.frombuffer(b, dtype=np.uint8)).tobytes() if _whole(b) else None)(patches)


def _png_of(raw: bytes | None, h: int, w: int) -> bytes | None:
    if raw is None or len(raw) != 3 * h * w:
        return None
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = b"".join(b"\0" + raw[3 * w * y : 3 * w * (y + 1)] for y in range(h))  # no filter
    head = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b"")


@F.arrow_udf(T.BinaryType())
def png(columns: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    """RGB bytes, row by row, with height and width, as a PNG file; bytes of another length give null."""
    return _few(pa.binary(), _png_of)(columns)
