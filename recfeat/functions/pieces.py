"""Word pieces: words cut into the longest pieces of a vocabulary that is learned from their histogram."""

from __future__ import annotations

from array import array
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START = "\x01"
"""Stands before each word, so pieces at a word's start differ from those inside; cleaned texts have no such character."""
FIRST_ID, BYTES = 10, 256
"""Ids below are for marks; then one id for each byte, for characters that no piece has; then the pieces in order."""
WORD = r"[^\x20\x09-\x0D\p{Z}]+"
_WORDS = regex.compile(WORD)
LONGEST, SIZE = 8, 8_000
CACHED, SLICE = 200_000, 256


def words_of(text: Column) -> Column:
    """The words between white space."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def histogram(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(word, n)`` of all texts."""
    return docs.select(F.explode(words_of(F.col(text_col))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def learn(words: DataFrame, size: int = SIZE, longest: int = LONGEST) -> DataFrame:
    """``(piece, id)``: the ``size`` pieces that save most tokens, with ids from ``FIRST_ID + BYTES`` up.

    A piece of k characters that occurs n times in the words saves n (k - 1) single characters; single ones come with what they
    occur. Ties go by the text. Each word counts once with its number, so the work follows the words, not the texts.
    """
    marked = F.concat(F.lit(START), "word")

    def spans_of(k: int) -> Column:
        starts = F.when(F.length(marked) >= k, F.sequence(F.lit(1), F.length(marked) - k + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda at: F.substring(marked, at, F.lit(k)))

    spans = [spans_of(k) for k in range(1, longest + 1)]
    counts = words.select(F.explode(F.concat(*spans)).alias("piece"), "n").groupBy("piece").agg(F.sum("n").alias("n"))
    gain = F.col("n") * F.greatest(F.length("piece") - 1, F.lit(1))
    best = counts.orderBy(gain.desc(), "piece").limit(size).select("piece", gain.alias("gain"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("gain")).alias("minus"), "piece")))  # of ``size`` rows
    return best.agg(ranked.alias("all")).select(F.posexplode("all").alias("at", "x")).select("x.piece", (F.col("at") + FIRST_ID + BYTES).alias("id"))


class Trie:
    """All pieces as a trie in flat arrays: an edge is a key (node, character), sorted, with its child; a node has the id of its piece or -1."""

    def __init__(self, pieces: dict[str, int]):
        edges: dict[int, int] = {}
        ids = [-1]
        for piece, number in pieces.items():
            node = 0
            for c in piece:
                key = node << 21 | ord(c)
                if key not in edges:
                    edges[key] = len(ids)
                    ids.append(-1)
                node = edges[key]
            ids[node] = number
        keys = np.array(sorted(edges), dtype=np.int64)
        self.keys, self.children, self.ids = keys, np.array([edges[k] for k in keys.tolist()], dtype=np.int64), np.array(ids, dtype=np.int64)

    def _step(self, nodes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """Children, -1 where there is none."""
        if not len(self.keys):
            return np.full(len(nodes), -1)
        wanted = nodes << 21 | chars
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.children[at], -1)

    def encode(self, words: list[str]) -> list[list[int]]:
        """The ids of each word, all words side by side: longest pieces from the left, bytes where no piece begins."""
        marked = [START + w for w in words]
        ends = np.cumsum([len(w) for w in marked], dtype=np.int64)
        chars = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        out: list[list[int]] = [[] for _ in words]
        at, who = ends - [len(w) for w in marked], np.arange(len(words))
        while len(who):
            node, place, best, best_id = np.zeros(len(who), dtype=np.int64), at.copy(), at.copy(), np.full(len(who), -1)
            live = np.arange(len(who))
            while len(live):
                live = live[place[live] < ends[who[live]]]
                child = self._step(node[live], chars[place[live]])
                live, child = live[child >= 0], child[child >= 0]
                node[live] = child
                place[live] += 1
                whole = live[self.ids[child] >= 0]
                best[whole], best_id[whole] = place[whole], self.ids[node[whole]]
            for w, number, a in zip(who.tolist(), best_id.tolist(), at.tolist()):
                out[w] += [number] if number >= 0 else [FIRST_ID + b for b in chr(chars[a]).encode("utf-8", "surrogatepass")]
            at = np.maximum(best, at + 1)
            going = at < ends[who]
            at, who = at[going], who[going]
        return out

    def decode(self, ids: list[int], names: dict[int, str]) -> str:
        """The words of ids, joined by spaces; ``names``: the piece of each id."""
        data = b"".join(names[i].encode() if i in names else bytes([i - FIRST_ID]) for i in ids)
        return data.decode("utf-8", "surrogatepass").replace(START, " ").removeprefix(" ")


def _first_words(sentences: pa.Array, each: int | None, most: int | None) -> list[list[str]]:
    """The words of a text's sentences; at most ``each`` of a sentence, and sentences until these and a mark for each are more than ``most``."""
    out, n = [], 0
    for sentence in sentences:
        out.append([m.group() for m in islice(_WORDS.finditer(sentence.as_py() or ""), each)])
        n += 1 + len(out[-1])
        if most is not None and n > most:
            break
    return out


def encoded(sentences: Column, pieces: dict[str, int], each: int | None = None, most: int | None = None) -> Column:
    """The ids of each sentence of an array; null gives null. ``pieces`` is the bounded vocabulary, sent to the workers.

    A worker cuts each different word once and keeps up to ``CACHED`` of them; the words of ``SLICE`` texts are Python objects at a time.
    Whoever uses only ``each`` ids of a sentence, and of a text only sentences that fit into ``most`` ids with a mark for each,
    says so: what is past both need not be there then. A word has at least one id.
    """
    state: dict = {}

    @F.arrow_udf("array<array<int>>")
    def run(arrays: pa.Array) -> pa.Array:
        if "trie" not in state:
            state["trie"], state["known"] = Trie(pieces), {}
        known, flat, ends, lengths = state["known"], array("i"), [0], [0]
        for first in range(0, len(arrays), SLICE):
            rows = [_first_words(r.values, each, most) if r.is_valid else [] for r in arrays.slice(first, SLICE)]
            new = {w for r in rows for s in r for w in s}.difference(known)
            if len(known) + len(new) > CACHED:
                known.clear()
                new = {w for r in rows for s in r for w in s}
            known.update(zip(new, state["trie"].encode(list(new))))
            for r in rows:
                for s in r:
                    for w in s:
                        flat.extend(known[w])
                    ends.append(len(flat))
                lengths.append(len(ends) - 1)
        ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(flat, dtype=np.int32)))
        return pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), ids, mask=arrays.is_null())

    return run(sentences)
