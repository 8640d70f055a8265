"""Sentence packing into token chunks of a bounded length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .pieces import WORD
from .vectors import once

MAX_TOK, MAX_CHUNKS = 384, 4


def words_as_ids(sentences: Column, vocabulary: int = 30_000) -> Column:
    """Ids without a learned vocabulary: for each word of a sentence its crc32, folded to ids from 10 up."""
    number = lambda w: (F.crc32(w.cast("binary")) % (vocabulary - 10) + 10).cast("int")
    return F.transform(sentences, lambda s: F.transform(F.regexp_extract_all(F.coalesce(s, F.lit("")), F.lit(WORD), F.lit(0)), number))


def sentence_chunks(ids: Column, max_tok: int = MAX_TOK, max_chunks: int = MAX_CHUNKS, first: int = 1, last: int = 2, mark: int = 3) -> Column:
    """Chunks of whole sentences as ``array<struct<ids,marks>>``, from the ids of each sentence; null gives none.

    Each sentence is led by ``mark``, each chunk by ``first``, and closed by ``last``. A sentence is cut to max_tok - 3 ids; a chunk holds at
    most max_tok. Past ``max_chunks`` the rest is left out. ``marks`` are the places of the sentence marks in the chunk.
    """
    room = max_tok - 2
    some = F.slice(F.coalesce(ids, F.array().cast("array<array<int>>")), 1, max_chunks * room)  # more sentences than that fill all chunks
    led = F.transform(some, lambda s: F.concat(F.array(F.lit(mark)), F.slice(F.coalesce(s, F.array().cast("array<int>")), 1, max_tok - 3)))
    nothing = F.array().cast("array<struct<chunk:int,place:int>>")

    def place(state: Column, n: Column) -> Column:
        full = (state["used"] > 0) & (state["used"] + n > room)
        chunk, used = F.when(full, state["chunk"] + 1).otherwise(state["chunk"]), F.when(full, 0).otherwise(state["used"])
        at = F.array(F.struct(chunk.alias("chunk"), (used + 1).alias("place")))
        return F.struct(chunk.alias("chunk"), (used + n).alias("used"), F.concat(state["at"], at).alias("at"))

    start = F.struct(F.lit(0).alias("chunk"), F.lit(0).alias("used"), nothing.alias("at"))
    placed = lambda led: F.aggregate(F.transform(led, lambda s: F.size(s)), start, place, lambda state: state["at"])
    zipped = lambda led: F.zip_with(led, placed(led), lambda s, at: F.struct(s.alias("ids"), at.alias("at")))

    def chunk(mine: Column) -> Column:
        whole = F.concat(F.array(F.lit(first)), F.flatten(F.transform(mine, lambda x: x["ids"])), F.array(F.lit(last)))
        return F.struct(whole.alias("ids"), F.transform(mine, lambda x: x["at"]["place"]).alias("marks"))

    def chunks_of(both: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(max_chunks - 1)), lambda k: once(F.filter(both, lambda x: x["at"]["chunk"] == k), chunk))

    return F.filter(once(once(led, zipped), chunks_of), lambda c: F.size(c["marks"]) > 0)


def padded(values: Column, length: Column | int, pad: int) -> Column:
    """Cut or filled to ``length``."""
    length = F.lit(length) if isinstance(length, int) else length
    cut = F.slice(values, F.lit(1), length)
    return F.concat(cut, F.array_repeat(F.lit(pad), F.greatest(F.lit(0), length - F.size(cut)).cast("int")))


def within_vocabulary(ids: Column, size: int, pad: int = 0) -> Column:
    """Ids at or past the vocabulary's size become padding; ``size`` counts the marks too."""
    return F.transform(ids, lambda i: F.when(i < size, i).otherwise(pad))
