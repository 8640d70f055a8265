"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

Counts of words and word pairs of the training texts are quantised to 1 + floor(log_b(count)) and stored
in a Bloom filter by that many events (n-gram, 1), (n-gram, 2), ... (Talbot and Osborne, 2007): a count is
read back by probing for one level after the other until a probe fails, so it is never too low. The
filter is built in shards, each by one task from the packed hashes of its n-grams; it has the same bits
and probes for each event at every size. A filter of up to ``MAX_BYTES`` is handed out whole, as a file that the
Python workers of an executor map and share. Of a larger
one, blocks of shards within that bound are handed out one after the other, and each pass scores the tokens
whose pair its block holds: pairs are dealt to groups by the blocks of their two words, so that a pass has
all three counts of its tokens, and a text's score is the sum over the passes.

The model backs off from pairs to words by absolute discounting (Ney, Essen and Kneser, 1994):
P(w | v) = max(c(vw) - D, 0) / c(v) + B P(w), with P(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)). D and B depend on the
class of v, the level of its count (rare words share one class), and are estimated from all pairs: with n1 and n2
pairs seen once and twice after the class, D = n1 / (n1 + 2 n2), and B = D T / C for its T different pairs among C.
So a class whose pairs hardly ever repeat leaves nearly all to the words. The class is the top bits of a hash.
Beside it, the base score uses exact word counts: a bounded number of the most frequent words reaches the
workers, all other words are counted and joined by Spark.
"""

from __future__ import annotations

import math
import os
import uuid
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_table, utf8

END = b"\n"
"""The end token: no word holds a line feed."""
LEVEL_BASE = 1.5
HEAD_WORDS = 200_000
"""At most so many of the most frequent words are sent to the workers with their exact counts."""
MAX_BYTES = 320 << 20
"""So much of the filter at most is handed out at a time."""
PROBES = 5
BYTES_FOR = PROBES / math.log(2) / 8
"""The filter's size for each event."""
WORDS_HELD = 200_000
COUNTED_AT_ONCE, PACKED_AT_ONCE = 250_000, 2_000_000
"""So many words or n-grams at most does a worker hold before it hands them on."""
BATCH_BYTES = 1 << 20
SHARD_NGRAMS = 1 << 20
PARTITIONS = 20_000
"""At most so many tasks build shards, several of them in turn where there are more."""
CLASS_SHIFT = 58
CLASSES = 64
_REST = np.uint64((1 << CLASS_SHIFT) - 1)

_PAIR = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_LEVEL = np.uint64(0xD6E8FEB86659FD93)


def tokens(text: bytes) -> list[bytes]:
    """Words (A-Z lower-cased), then the end token."""
    return [*text.lower().split(), END]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def before(values: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of each token, what belongs to the token before it; ``ends`` and ``sizes``: of the texts, side by side."""
    out = np.concatenate([values[-1:], values[:-1]])
    out[ends - sizes] = values[ends - 1]
    return out


class Layout:
    """Which shard holds an n-gram: words are dealt to blocks by their hash, pairs to a group for each two blocks."""

    def __init__(self, blocks: int, word_shards: int, pair_shards: int):
        """``word_shards`` of each block, ``pair_shards`` of each group."""
        self.blocks, self.word_shards, self.pair_shards = blocks, word_shards, pair_shards
        self.first_pair = blocks * word_shards
        self.shards = self.first_pair + blocks * blocks * pair_shards

    def pairs(self, words: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Hashes of (previous token, token) for each token; each text's end token stands before its first.

        With several blocks a hash's remainder (without the class) is its group; its class is the context's.
        """
        context, blocks = before(words, ends, sizes), np.uint64(self.blocks)
        hashes = mix(context * _PAIR + words) & _REST
        if self.blocks > 1:
            hashes >>= np.uint64(1)  # no overflow below
            hashes += (context & _REST) % blocks * blocks + (words & _REST) % blocks - hashes % (blocks * blocks)
        return hashes | context & ~_REST

    @staticmethod
    def _place(hashes: np.ndarray, parts: int, shards: int) -> np.ndarray:
        rest, n = hashes & _REST, np.uint64(shards)
        return (rest % np.uint64(parts) * n + rest // np.uint64(parts) % n).astype(np.int64)

    def of_words(self, hashes: np.ndarray) -> np.ndarray:
        return self._place(hashes, self.blocks, self.word_shards)

    def of_pairs(self, hashes: np.ndarray) -> np.ndarray:
        return self.first_pair + self._place(hashes, self.blocks**2, self.pair_shards)

    def passes(self, sizes: dict[int, int], max_bytes: int) -> Iterator[tuple[list[int], int, int]]:
        """``(shards, first, last)``: what a pass holds, ``first`` to before ``last`` of it pairs; ``sizes``: bytes of shards that are not empty."""
        for group in range(self.blocks**2):
            words = [b * self.word_shards + k for b in sorted({group // self.blocks, group % self.blocks}) for k in range(self.word_shards)]
            base = sum(sizes.get(s, 8) for s in words)
            at = end = self.first_pair + group * self.pair_shards
            while at < self.first_pair + (group + 1) * self.pair_shards:
                held, end = base, at
                while end < self.first_pair + (group + 1) * self.pair_shards and (end == at or held + sizes.get(end, 8) <= max_bytes):
                    held += sizes.get(end, 8)
                    end += 1
                yield [*words, *range(at, end)], at, end  # also what holds no pair: there tokens' pairs are unseen
                at = end


def groups(texts: Iterable[pa.Scalar]) -> Iterator[list[bytes]]:
    """Texts of an Arrow column in runs of about ``BATCH_BYTES``: no more of them are Python objects at a time."""
    now, size = [], 0
    for text in texts:
        now.append(text.as_py())
        size += len(now[-1])
        if size > BATCH_BYTES:
            yield now
            now, size = [], 0
    if now:
        yield now


def level(counts: np.ndarray) -> np.ndarray:
    """Quantised counts: 0 for 0, else 1 + floor(log_b(count))."""
    return np.where(counts > 0, 1 + np.floor(np.log(np.maximum(counts, 1)) / math.log(LEVEL_BASE) + 1e-9), 0).astype(np.int64)


def _level_counts() -> np.ndarray:
    """The middle (by its logarithm) of the counts of each level; 1 for level 1."""
    low = np.ceil(LEVEL_BASE ** np.arange(0, 110) - 1e-6)
    high = np.maximum(low, np.ceil(LEVEL_BASE ** np.arange(1, 111) - 1e-6) - 1)
    return np.concatenate([[0.0], np.sqrt(low * high)])


LEVEL_COUNTS = _level_counts()


class LogBloom:
    """Shards of bits side by side, and the number of probes for each event."""

    def __init__(self, bits: np.ndarray, starts: np.ndarray, probes: int):
        self.bits, self.starts, self.sizes, self.probes = bits, starts[:-1].astype(np.uint64), np.diff(starts).astype(np.uint64), probes

    @staticmethod
    def seeds(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and (odd) step of each n-gram's probes."""
        return hashes, mix(hashes ^ _LEVEL) | np.uint64(1)

    @staticmethod
    def positions(start: np.ndarray, step: np.ndarray, sizes, nth: int) -> np.ndarray:
        """Where the n-th probe falls within a shard of so many bits; probes are numbered on from level to level."""
        h = step * np.uint64(nth)
        h += start
        h >>= np.uint64(32)
        h *= sizes
        h >>= np.uint64(32)
        return h

    @staticmethod
    def shard(hashes: np.ndarray, counts: np.ndarray, n_bits: int, probes: int) -> np.ndarray:
        """The bytes of one shard."""
        bits, levels, k = np.zeros(n_bits // 8, dtype=np.uint8), level(counts), 1
        start, step = LogBloom.seeds(hashes)
        while len(start):
            for probe in range(probes):
                at = LogBloom.positions(start, step, np.uint64(n_bits), k * probes + probe)
                np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
            k += 1
            start, step, levels = start[levels >= k], step[levels >= k], levels[levels >= k]
        return bits

    def levels(self, hashes: np.ndarray, shard: np.ndarray | None = None) -> np.ndarray:
        """The stored level of each n-gram: the probes go on from level to level until one fails.

        ``shard``: where each one is, else by its remainder.
        """
        found, active = np.zeros(len(hashes), dtype=np.int64), np.arange(len(hashes))
        if not len(self.sizes):
            return found
        start, step = self.seeds(hashes)
        if shard is None:
            shard = (hashes % np.uint64(len(self.sizes))).astype(np.int64)
        base, sizes = self.starts[shard] << np.uint64(3), self.sizes[shard] << np.uint64(3)
        for k in range(1, len(LEVEL_COUNTS)):
            for probe in range(self.probes):
                at = self.positions(start, step, sizes, k * self.probes + probe)
                at += base
                hit = np.flatnonzero(self.bits[(at >> np.uint64(3)).view(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1)
                if len(hit) < len(active):
                    active, start, step, base, sizes = active[hit], start[hit], step[hit], base[hit], sizes[hit]
                if not len(active):
                    return found
            found[active] = k
        return found


class Words(dict):
    """Words to running numbers, and the hash of each number; forgotten when they are many.

    ``known``: exact counts of the most frequent words, of which a hash's class follows; others have class 0.
    ``counts`` holds these by number, nan for others.
    """

    def __init__(self, known: dict[bytes, int]):
        super().__init__()
        self.known, self.names = known, []
        self.hashes, self.counts = np.zeros(0, dtype=np.uint64), np.zeros(0)
        self.resets = 0

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.names)
        self.names.append(word)
        return n

    def __call__(self, words: list[bytes]) -> np.ndarray:
        """The numbers of the words of a batch; an earlier batch's numbers may hold no more."""
        if len(self.names) > WORDS_HELD:
            self.clear()
            self.names, self.hashes, self.counts, self.resets = [], self.hashes[:0], self.counts[:0], self.resets + 1
        numbers = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
        new = self.names[len(self.hashes) :]
        counts = np.fromiter((self.known.get(w, math.nan) for w in new), float, len(new))
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, new), np.uint64, len(new)) & _REST
        self.hashes = np.concatenate([self.hashes, hashes | class_of(counts) << np.uint64(CLASS_SHIFT)])
        self.counts = np.concatenate([self.counts, counts])
        return numbers


def class_of(counts: np.ndarray) -> np.ndarray:
    """The class of words of these counts: their level, or 0 (nan) if they are not among the most frequent."""
    return np.minimum(level(np.nan_to_num(counts)), CLASSES - 1).astype(np.uint64)


def back_off(stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(D, B)`` of each class from its rows (pairs seen once, seen twice, different pairs, all pairs).

    Without a pair seen once nothing is known of unseen ones: D is a half then. A class without pairs leaves all to the words.
    """
    once, twice, different, whole = stats.astype(float)
    discount = np.where(once > 0, once / np.maximum(once + 2 * twice, 1), 0.5)
    return discount, np.where(whole > 0, discount * different / np.maximum(whole, 1), 1.0)


def _word_counts(texts: DataFrame) -> DataFrame:
    """``(word, n)`` over all texts; tasks hand on one row for each of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                held.update(tokens(text.as_py()))
                if len(held) > COUNTED_AT_ONCE:
                    yield flush()
        yield flush()

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _packed(hashes: np.ndarray, place) -> Iterator[pa.RecordBatch]:
    """One row for each shard (by ``place``): its different hashes and how often each occurs."""
    values, n = np.unique(hashes, return_counts=True)
    shard = place(values)
    order = np.argsort(shard, kind="stable")
    names, firsts = np.unique(shard[order], return_index=True)
    for s, mine in zip(names.tolist(), np.split(order, firsts[1:])):
        yield pa.RecordBatch.from_pydict({
            "shard": pa.array([s], pa.int32()), "hashes": [values[mine].tobytes()], "n": [zlib.compress(n[mine].astype(np.uint32).tobytes(), 1)],
        })


def _filter_shards(texts: DataFrame, layout: Layout, head) -> DataFrame:
    """``(shard, size, bits, stats)``: words and pairs of all texts, gathered by shard of their hash; ``size`` in bytes.

    ``head``: the broadcast counts of the most frequent words. ``stats``: of shards of pairs, the rows of ``back_off``.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, alone, both, size = Words(head.value), [], [], 0

        def flush():
            yield from _packed(np.concatenate(alone), layout.of_words)
            yield from _packed(np.concatenate(both), layout.of_pairs)

        for batch in batches:
            for texts in groups(batch.column(0)):
                split = [tokens(t) for t in texts]
                sizes = np.array([len(w) for w in split])
                numbers = words(list(chain.from_iterable(split)))
                h = words.hashes[numbers]
                alone.append(h)
                both.append(layout.pairs(h, np.cumsum(sizes), sizes))
                size += 2 * len(h)
                if size > PACKED_AT_ONCE:
                    yield from flush()
                    alone, both, size = [], [], 0
        if alone:
            yield from flush()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []

        def fold():
            hashes = np.concatenate([p[0] for p in parts])
            n = np.concatenate([p[1] for p in parts])
            values, place = np.unique(hashes, return_inverse=True)
            return values, np.bincount(place, weights=n, minlength=len(values)).astype(np.int64)

        def done():
            values, n = fold()
            size = max(8, -(-int(level(n).sum() * BYTES_FOR) // 8) * 8)
            bits = LogBloom.shard(values, n, size * 8, PROBES).tobytes()
            stats = np.zeros((4, CLASSES), dtype=np.int64)
            if now >= layout.first_pair:
                of = (values >> np.uint64(CLASS_SHIFT)).astype(np.int64)
                for row, weight in enumerate((n == 1, n == 2, n > 0, n)):
                    stats[row] = np.rint(np.bincount(of, weights=weight, minlength=CLASSES))
            return pa.RecordBatch.from_pydict({
                "shard": pa.array([now], pa.int32()), "size": pa.array([size], pa.int64()), "bits": [bits], "stats": pa.array([stats.ravel()], pa.list_(pa.int64())),
            })

        for batch in batches:
            for s, hashes, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if s != now and now is not None:
                    yield done()
                    parts = []
                now = s
                parts.append((np.frombuffer(hashes, np.uint64), np.frombuffer(zlib.decompress(n), np.uint32)))
                if len(parts) >= 64:
                    parts = [fold()]
        if now is not None:
            yield done()

    packed = texts.mapInArrow(pack, "shard int, hashes binary, n binary")
    dealt = packed.repartition(min(layout.shards, PARTITIONS), "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(build, "shard int, size long, bits binary, stats array<bigint>")


class Part:
    """Some shards side by side in one file that Spark brings to each executor once; its Python workers map it, so that they share its pages."""

    def __init__(self, made: DataFrame, wanted: list[int], sizes: dict[int, int], shards: int):
        """``wanted`` ascends; of these shards, one without n-grams is eight empty bytes. ``sizes``: bytes of the others."""
        held = np.zeros(shards + 1, dtype=np.int64)
        held[np.array(wanted, dtype=np.int64) + 1] = [sizes.get(s, 8) for s in wanted]
        self.starts, self.name = np.cumsum(held), f"filter-{uuid.uuid4().hex}"
        ranges = F.lit(False)
        for run in np.split(np.array(wanted), np.flatnonzero(np.diff(wanted) != 1) + 1):
            ranges |= F.col("shard").between(int(run[0]), int(run[-1]))
        folder = os.path.join(SparkFiles.getRootDirectory(), "made")  # deleted with the application
        os.makedirs(folder, exist_ok=True)
        with open(path := os.path.join(folder, self.name), "wb") as file:
            file.truncate(int(self.starts[-1]))
            for shard, bits in made.where(ranges).select("shard", "bits").toLocalIterator():
                file.seek(int(self.starts[shard]))
                file.write(bits)
        made.sparkSession.sparkContext.addFile(path)

    def bloom(self) -> LogBloom:
        return LogBloom(np.memmap(SparkFiles.get(self.name), dtype=np.uint8, mode="r"), self.starts, PROBES)


def _logs(alone: np.ndarray, context: np.ndarray, both: np.ndarray, pairs: np.ndarray, model: tuple[float, np.ndarray, np.ndarray]) -> np.ndarray:
    """log10 P(w | v) from the counts of w, v and vw, and the hash of vw; ``model``: N + 0.5 (V + 1), D and B."""
    all_words, discount, left = model
    of = (pairs >> np.uint64(CLASS_SHIFT)).astype(np.int64)
    rest = np.where(context > 0, left[of], 1.0) * (alone + 0.5) / all_words
    return np.log10(np.minimum(np.maximum(both - discount[of], 0.0) / np.maximum(np.maximum(context, both), 1.0) + rest, 1.0))


def _pass_scores(
    hashed: DataFrame, part: Part, layout: Layout, first: int, last: int, model: tuple[float, np.ndarray, np.ndarray]
) -> DataFrame:
    """``(row, part)``: the sum of each text over its tokens whose pair is in the shards ``first`` to before ``last``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = part.bloom()
        for batch in batches:
            at = 0
            for texts in groups(batch.column(1)):
                words, sizes = np.frombuffer(b"".join(texts), dtype=np.uint64), np.array([len(t) // 8 for t in texts])
                ends = np.cumsum(sizes)
                pairs = layout.pairs(words, ends, sizes)
                shard = layout.of_pairs(pairs)
                mine = np.flatnonzero((shard >= first) & (shard < last))
                names, number = np.unique(np.concatenate([words[mine], before(words, ends, sizes)[mine]]), return_inverse=True)
                single = LEVEL_COUNTS[bloom.levels(names, layout.of_words(names))][number]
                both = LEVEL_COUNTS[bloom.levels(pairs[mine], shard[mine])]
                logs = _logs(single[: len(mine)], single[len(mine) :], both, pairs[mine], model)
                sums = np.bincount(np.repeat(np.arange(len(texts)), sizes)[mine], weights=logs, minlength=len(texts))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(sums, pa.float64())], names=["row", "part"])
                at += len(texts)

    return as_table(hashed.mapInArrow(run, "row long, part double"), "pass")


def score(
    docs: DataFrame, learned: DataFrame, id_col: str = "doc_id", text_col: str = "text", head_words: int = HEAD_WORDS, max_bytes: int = MAX_BYTES
) -> DataFrame:
    """Scores of every whole text of ``docs`` by a model of the texts of ``learned``.

    Returns ``id_col, n_tokens, n_known`` (tokens seen in training), ``train_tokens`` (N), ``base_score``
    (exact unigram log10 probability with add-half smoothing) and ``score`` (the model's log10
    probability). Null texts are empty: they count one end token. With nothing learned every count is 0
    and N is 0. Repeated rows and null ids each give a row; an empty ``docs`` gives none; other columns
    are not read.
    """
    spark = docs.sparkSession
    texts = learned.select(utf8(text_col).alias("t"))
    counts = as_table(_word_counts(texts), "words")
    events = F.sum(1 + F.floor(F.log("n") / math.log(LEVEL_BASE) + 1e-9))
    total, vocabulary, word_events = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(events, F.lit(0))).first()
    by_count = counts.groupBy("n").count().groupBy(F.floor(F.log2("n") * 64).alias("step")).agg(F.sum("count").alias("words"), F.min("n").alias("least"))
    least, words = 1 << 62, 0
    for row in by_count.orderBy(F.desc("step")).collect():  # a few thousand steps at most, whatever the input
        if words + row.words > head_words:
            break
        words, least = words + row.words, row.least
    head = spark.sparkContext.broadcast({bytes(r[0]): r[1] for r in counts.where(F.col("n") >= least).collect()})

    blocks = max(1, math.ceil(word_events * BYTES_FOR / (max_bytes / 4)))
    ngrams = max(1, min(SHARD_NGRAMS, max_bytes // 4))
    layout = Layout(blocks, *(max(1, -(-total // (ngrams * n))) for n in (blocks, blocks**2)))
    made = as_table(_filter_shards(texts, layout, head), "filter")
    sums = {r[0]: r[1] for r in made.select(F.posexplode("stats").alias("at", "n")).groupBy("at").agg(F.sum("n")).collect()}
    stats = np.array([sums.get(k, 0) for k in range(4 * CLASSES)]).reshape(4, CLASSES)
    sizes_of = {r[0]: r[1] for r in made.select("shard", "size").collect()}
    whole = sum(sizes_of.values()) <= max_bytes
    all_shards = Part(made, list(range(layout.shards)), sizes_of, layout.shards) if whole else None
    all_words = total + 0.5 * (vocabulary + 1)
    floor_log, smoothing = math.log10(all_words), (all_words, *back_off(stats))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = all_shards.bloom() if whole else None
        words, resets, task, done = Words(head.value), 0, TaskContext.get().partitionId(), 0
        exact = single = np.zeros(0)  # of each word held: log10(count + 0.5), nan if not among the head; the filter's count
        for batch in batches:
            at = 0
            for texts in groups(batch.column(1)):
                split = [tokens(t) for t in texts]
                sizes = np.array([len(w) for w in split])
                ends = np.cumsum(sizes)
                numbers = words(list(chain.from_iterable(split)))
                have = len(exact) if resets == words.resets else 0
                resets = words.resets
                exact = np.concatenate([exact[:have], np.log10(words.counts[have:] + 0.5)])
                hashes, n = words.hashes[numbers], len(texts)
                if whole:
                    single = np.concatenate([single[:have], LEVEL_COUNTS[bloom.levels(words.hashes[have:], layout.of_words(words.hashes[have:]))]])
                    alone, pairs = single[numbers], layout.pairs(hashes, ends, sizes)
                    both = LEVEL_COUNTS[bloom.levels(pairs, layout.of_pairs(pairs))]
                    model, packed = np.add.reduceat(_logs(alone, before(alone, ends, sizes), both, pairs, smoothing), ends - sizes), [None] * n
                else:
                    model, packed = np.zeros(n), [h.tobytes() for h in np.split(hashes, ends[:-1])]
                value = exact[numbers]
                rare = np.isnan(value)
                base = np.add.reduceat(np.where(rare, 0.0, value), ends - sizes) - sizes * floor_log
                sure = np.add.reduceat((~rare).astype(np.int64), ends - sizes)
                ids = (task << 40) + done + np.arange(n)
                keys, times = np.unique(np.repeat(np.arange(n), sizes)[rare] << 32 | numbers[rare], return_counts=True)
                m = len(keys)
                zeros = np.zeros(m)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([ids, ids[keys >> 32]])), pa.concat_arrays([batch.column(0).slice(at, n), pa.nulls(m, batch.column(0).type)]),
                        pa.array([None] * n + [words.names[k] for k in (keys & 0xFFFFFFFF).tolist()], pa.binary()), pa.array(np.concatenate([sizes, times])),
                        pa.array(np.concatenate([sure, zeros.astype(np.int64)])), pa.array(np.concatenate([base, zeros])), pa.array(np.concatenate([model, zeros])),
                        pa.array(packed + [None] * m, pa.binary()),
                    ],
                    names=["row", "id", "word", "n", "known", "base", "model", "hashes"],
                )
                at += n
                done += n

    schema = f"row long, id {dict(docs.dtypes)[id_col]}, word binary, n long, known long, base double, model double, hashes binary"
    rows = as_table(docs.select(F.col(id_col), utf8(text_col).alias("t")).mapInArrow(run, schema), "scored")
    rare = rows.where("word is not null").select("row", "word", F.col("n").alias("times"))
    tail = (
        rare.join(counts.where(F.col("n") < least), "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more"),
            F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rest"),
        )
    )
    scored = rows.where("word is null").drop("hashes")
    if not whole:
        hashed = rows.where("word is null").select("row", "hashes")
        parts = [
            _pass_scores(hashed, Part(made, wanted, sizes_of, layout.shards), layout, first, last, smoothing)
            for wanted, first, last in layout.passes(sizes_of, max_bytes)
        ]
        sums = reduce(DataFrame.unionAll, parts).groupBy("row").agg(F.sum("part").alias("model"))
        scored = scored.drop("model").join(sums, "row")
    return scored.join(tail, "row", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"), F.col("model").alias("score"),
    )
