"""Token ids in ORC files: ascending by document id, with row indexes and Bloom filters on the ids.

Documents are dealt to ranges of ids, sorted, encoded and written by Spark's ORC writer, one file a range: ORC holds
the integers run-length encoded in stripes, each with an index of its rows and a Bloom filter on ``id``. Stripes are read
in parallel, and a look-up of ids reads only the stripes and row groups whose statistics and filters allow them.
A row also holds how many tokens of its file stand before it; with the totals of earlier files, of which there is one
number a file, this gives its place in the whole stream.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import batched, chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

END_ID = 2
CACHED = 300_000
"""So many pieces of text at most, of those that take all steps, are kept with their ids by a Python worker."""
FLUSH = 1 << 22
"""Texts of so many bytes at most, or one document, are encoded before they are handed on."""
AT_ONCE = 4096
"""So many pieces are given to the whole tokenizer in one call, whose results are several times larger than their ids."""
LONG = 1000
"""Longer pieces, in bytes, take all steps: merging by ranks may take the square of a word's length."""
STRIPE_BYTES = 16 << 20
ROWS_INDEXED = 1000
"""Rows of a row group: each has its own statistics and Bloom filter."""
_CODED: dict[str, Coder] = {}
_LATIN_PIECE = "^[!-~À-ÖØ-öø-ÿ]*$"
_LATIN = re.compile("[!-~À-ÖØ-öø-ÿ]+").fullmatch
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+").findall
_PARTS_AND_ENDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|\n|[^\na-zß-öø-ÿ0-9]+").findall
"""Fixed values: what the tokenizer file takes as a word, for lower-cased Latin characters; a line feed ends a piece."""


class Coder:
    """Ids of texts by a tokenizer file that drops white space, spells words in bytes and marks word ends in its tokens.

    So no token crosses a space or a line feed. Texts are cut there, each different
    piece is encoded once by the library, and the ids of a text are those of its pieces, one after the other. What the file's
    steps before its model do to ASCII and Latin-1 letters is no more than lower-casing and parting words, digits and marks, so
    the model gets these parts as they are, all in one call; all other pieces take all steps.

    ``encode`` does the same for whole Arrow arrays, without an object for each piece: merges of Latin parts are looked up by
    rank. A part's last byte and a space after it stand for the last symbol with its word-end mark. This needs a file whose ids
    ascend in the order of its merges and whose tokens, spelled, give themselves (both tested for the file in use).
    """

    def __init__(self, tokenizer_path: str):
        from tiktoken import Encoding
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(tokenizer_path)
        self.model = Tokenizer(self.whole.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþßÿ"
        self.spelled = {ord(c): as_bytes.pre_tokenize_str(c)[0][0] for c in letters}
        suffix, vocabulary = self.model.model.end_of_word_suffix, self.whole.get_vocab()
        self.closing = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  # the tokens that end a word
        self.closing[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.known, self.words = Kept(), Kept()
        self.known[""] = b""
        self.ranks = self._ranks(vocabulary, suffix)
        self.piece_end = self.ranks[b"\n "]
        self.latin = Encoding("latin words", pat_str="[^ ]+ ", mergeable_ranks=self.ranks, special_tokens={})

    def _ranks(self, vocabulary: dict[str, int], suffix: str) -> dict[bytes, int]:
        """Ids of all tokens of lower-cased Latin characters, by their bytes and a space for ``suffix``; an id of its own ends a piece."""
        bytes_of = {s: b for c, spelled in self.spelled.items() for s, b in zip(spelled, chr(c).encode())} | {chr(b): b for b in range(33, 127)}
        ranks, added = {}, self.whole.get_added_tokens_decoder()
        for token, i in vocabulary.items():
            stem = token.removesuffix(suffix)
            if i not in added and all(map(bytes_of.__contains__, stem)):
                ranks[bytes(map(bytes_of.__getitem__, stem)) + b" " * (stem != token)] = i
        return ranks | {b"\n ": len(self.closing)}

    @staticmethod
    def of(tokenizer_path: str) -> Coder:
        """The worker's coder: workers serve many tasks, and later ones find most pieces known."""
        if tokenizer_path not in _CODED:
            _CODED[tokenizer_path] = Coder(tokenizer_path)
        return _CODED[tokenizer_path]

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """The ids of new pieces."""
        simple = [p for p in new if _LATIN(p) and "<|" not in p]
        parts = [_PARTS(p) for p in map(str.lower, simple)]
        fresh = list(set(chain.from_iterable(parts)).difference(self.words))
        words = self.words
        if fresh:
            made = self.model.encode_batch_fast([" ".join(fresh).translate(self.spelled)], add_special_tokens=False)
            ids = np.array(made[0].ids, dtype="<u4")
            data, ends = ids.tobytes(), (4 * np.flatnonzero(self.closing[ids]) + 4).tolist()
            words = _add(words, dict(zip(fresh, (data[a:b] for a, b in zip([0, *ends], ends)))))
        found = {p: words[x[0]] if len(x) == 1 else b"".join(map(words.__getitem__, x)) for p, x in zip(simple, parts)}
        other = [p for p in new if p not in found]
        for some in batched(other, AT_ONCE):
            made = self.whole.encode_batch_fast(list(some), add_special_tokens=False)
            found.update(zip(some, (np.array(m.ids, dtype="<u4").tobytes() for m in made)))
        return found

    def _having(self, pieces: set[str]) -> Kept:
        """What gives the ids of the pieces."""
        new = list(pieces.difference(self.known))
        return _add(self.known, self._learn(new)) if new else self.known

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        cut = [t.replace("\n", " ").split(" ") for t in texts]
        known = self._having(set().union(*cut))
        return [b"".join(map(known.__getitem__, c)) for c in cut]

    def _by_rank(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of Latin pieces one after the other, and how many each has."""
        text = _lines(pieces).lower() + "\n" * (len(pieces) > 0)
        ids = self.latin.encode_to_numpy(" ".join([*_PARTS_AND_ENDS(text), ""]), disallowed_special=())
        ended = ids == self.piece_end
        return ids[~ended], np.diff(np.flatnonzero(ended), prepend=-1) - 1

    def encode(self, texts: pa.Array, end_id: int) -> pa.ListArray:
        """The ids of each text and ``end_id``; a null text is empty. Each different piece is encoded once."""
        cut = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        coded = cut.flatten().dictionary_encode()
        pieces, of = coded.dictionary, coded.indices.to_numpy()
        latin = pc.and_(pc.match_substring_regex(pieces, _LATIN_PIECE), pc.less_equal(pc.binary_length(pieces), LONG))
        latin = pc.and_not(latin, pc.match_substring(pieces, "<|")).to_numpy(zero_copy_only=False)
        ids, sizes = self._by_rank(pieces.filter(pa.array(latin)))
        rest = [] if latin.all() else _lines(pieces.filter(pa.array(~latin))).split("\n")
        other = list(map(self._having(set(rest)).__getitem__, rest))
        ids = np.concatenate([ids, np.frombuffer(b"".join(other), dtype="<u4")]).astype("<i4")
        starts = np.cumsum([0, *sizes.tolist(), *(len(o) // 4 for o in other)], dtype=np.int32)
        place = np.empty(len(pieces), dtype=np.int32)
        place[np.concatenate([np.flatnonzero(latin), np.flatnonzero(~latin)])] = np.arange(len(pieces), dtype=np.int32)
        all_ids = pa.ListArray.from_arrays(pa.array(starts), pa.array(ids)).take(pa.array(place[of]))
        bounds = all_ids.offsets.to_numpy()[cut.offsets.to_numpy() - cut.offsets[0].as_py()]
        ended = np.insert(all_ids.values.to_numpy(), bounds[1:], np.uint32(end_id).astype("<i4"))
        return pa.ListArray.from_arrays(pa.array(bounds + np.arange(len(bounds), dtype=np.int32)), pa.array(ended))


class Kept(dict):
    """What a worker keeps, and what only the present texts need."""

    def __init__(self):
        super().__init__()
        self.passing: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        return self.passing[key]


def _add(kept: Kept, new: dict[str, bytes]) -> Kept:
    """Keep what is new as far as there is room (frequent pieces come first), and have the rest at hand until the next call."""
    room = max(0, CACHED - len(kept))
    kept.update(islice(new.items(), room))
    kept.passing = dict(islice(new.items(), room, None))
    return kept


def _lines(pieces: pa.Array) -> str:
    return pc.binary_join(pa.ListArray.from_arrays([0, len(pieces)], pieces), "\n")[0].as_py()


def _runs(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """First and next row of runs of ``FLUSH`` bytes at most; a longer text is a run of its own."""
    ends, first = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), dtype=np.int64), 0
    while first < len(texts):
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + FLUSH, side="right")))
        yield first, last
        first = last


def _schema(id_type: str) -> str:
    return f"id {id_type}, before long, n long, ids array<int>"


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every row's whole text, append ``end_id`` and write ORC files under ``path``, ascending by id.

    A null text is empty, so it has the end id alone; null ids come first. Rows of one id stand in the order in which they
    are read, and may fill several files. No row: files without rows. Other columns are not read, whatever their names.
    A text of any length is one row and must fit a task.
    """
    id_type = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("read"))
    ranged = rows.repartitionByRange("id", "read").sortWithinPartitions("id", "read").select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, before = Coder.of(tokenizer_path), 0
        for batch in batches:
            for first, last in _runs(batch.column(1)):
                ids = code.encode(batch.column(1).slice(first, last - first), end_id)
                n = np.diff(ids.offsets.to_numpy()).astype(np.int64)
                ends = before + np.cumsum(n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(ends - n), pa.array(n), ids], names=["id", "before", "n", "ids"]
                )
                before = int(ends[-1])

    made = ranged.mapInArrow(run, _schema(id_type))
    options = {
        "compression": "zstd", "orc.bloom.filter.columns": "id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "maxRecordsPerFile": "0",
        "orc.row.index.stride": str(ROWS_INDEXED), "orc.stripe.size": str(STRIPE_BYTES),
    }
    made.write.options(**options).orc(path)


def _files(spark: SparkSession, path: str, id_type: str) -> DataFrame:
    part = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).cast("long")
    return spark.read.schema(_schema(id_type)).orc(path).select("*", part.alias("part"))


def read_tokens(spark: SparkSession, path: str, ids: list | None = None, id_col: str = "doc_id", id_type: str = "bigint") -> DataFrame:
    """``(id_col, start, n_tokens, ids)`` of the files under ``path``; ``start``: tokens of all rows before.

    With ``ids`` only their rows: the condition reaches the reader, which skips stripes and row groups by statistics and Bloom
    filters. The totals come from two narrow columns; one row a file is broadcast, whatever the number of documents.
    """
    rows = _files(spark, path, id_type)
    totals = rows.groupBy("part").agg(F.max(F.col("before") + F.col("n")).alias("total"))
    bases = totals.select(F.col("part").alias("of"), (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    found = rows if ids is None else rows.where(F.col("id").isin(ids))
    placed = found.join(F.broadcast(bases), F.col("part") == F.col("of"))
    return placed.select(F.col("id").alias(id_col), (F.col("base") + F.col("before")).alias("start"), F.size("ids").cast("long").alias("n_tokens"), "ids")


def checksums(tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(id_col, start, n_tokens, ids_crc32)`` of rows of ``read_tokens``: unsigned crc32 of little-endian unsigned 32-bit ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
            data = memoryview(values).cast("B")
            sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums, pa.int64())], names=[id_col, "start", "n_tokens", "ids_crc32"])

    kind = dict(tokens.dtypes)[id_col]
    return tokens.select(id_col, "start", "n_tokens", "ids").mapInArrow(run, f"`{id_col}` {kind}, start long, n_tokens long, ids_crc32 long")
