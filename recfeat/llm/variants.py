"""Spelling variants: words within one edit of each other, found by variable-length grams.

Grams are short pieces of a word between two border marks. A gram of ``QMIN`` to ``QMAX`` - 1 characters that occurs more often than a
threshold is extended by its next character; the others make the dictionary (Li, Wang and Yang, "VGRAM", 2007). A word is
decomposed into the longest dictionary gram at each place, without those that lie inside an earlier one. For each word
the most grams that one edit can affect is known, so of any two near words one of the (that bound + 1) rarest grams of
the one meets one of the other, and the edit lies on one side of it. Only the lists of these grams are merged, kept apart by length and by
what the words have on the other side of the gram, and each pair found is verified. Words whose bound covers all their grams are
besides compared with each other by their deletion neighbours.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_table

QMIN, QMAX = 2, 5
FREQUENT = 200
"""A gram is frequent if it occurs more often, in a small vocabulary."""
MOST_FREQUENT = 200_000
"""At most so many grams are frequent, whatever the vocabulary: the threshold follows the number of grams. They are broadcast."""
START, END = "\x01", "\x02"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTIAL = 200_000


class Grams:
    """The frequent grams, and what decomposition and bounds need of them."""

    def __init__(self, counts: dict[str, int], qmin: int = QMIN, qmax: int = QMAX):
        self.counts, self.qmin, self.qmax = counts, qmin, qmax
        self.extended = {g for g in counts if len(g) < qmax}
        self.tails = {g[i:] for g in self.extended for i in range(1, len(g))}

    def decompose(self, word: str) -> list[tuple[int, int]]:
        """``(start, end)`` of the grams of a word with its border marks."""
        found, far, n = [], 0, len(word)
        for p in range(n - self.qmin + 1):
            e = p + self.qmin
            while e < n and e - p < self.qmax and word[p:e] in self.extended:
                e += 1
            if e > far:
                found.append((p, e))
                far = e
        return found

    def affected(self, word: str, grams: list[tuple[int, int]]) -> int:
        """At most so many of a word's grams are lost by one edit between the marks.

        A replacement or deletion loses the grams over it, an insertion those around it. A gram further right is
        lost only if a new one, from the edit on or before it, ends no earlier: then an extended gram has what lies between as its tail.
        """
        n = len(word)
        at, gap = [0] * n, [0] * (n + 1)
        for p, e in grams:
            for i in range(max(1, p), min(e, n - 1)):
                at[i] += 1
            for i in range(p + 1, e):
                gap[i] += 1
            for i in range(max(1, e - self.qmax), p + 1):
                if i < p and word[i + 1 : e - 1] in self.tails:
                    at[i] += 1
                if word[i : e - 1] in self.tails:
                    gap[i] += 1
        return max(*at, *gap)

    def rarest(self, word: str) -> tuple[list[tuple[int, int]], bool]:
        """The places of the grams of which near words share one, and whether the bound leaves any."""
        grams = self.decompose(word)
        bound = self.affected(word, grams)
        ranked = sorted((self.counts.get(word[p:e], 0), word[p:e], p, e) for p, e in grams)
        return [(p, e) for _, _, p, e in ranked[: bound + 1]], bound < len(grams)


def word_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, drop_every: int = 31) -> DataFrame:
    """``word``: each maximal run of Latin letters of whole texts, A-Z lower-cased, of at least ``least`` code points.

    A run whose crc32 (of id, colon and run) ``drop_every`` divides loses one code point, as a stand-in for misspellings. A null
    text has no runs; a null id counts as empty.
    """
    runs = F.regexp_extract_all(F.col(text_col), F.lit(rf"[A-Za-zÀ-ÿ]{{{least},}}"), F.lit(0))
    made = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    lowered = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run"))  # translating is slow, and few need it
    made = made.select("id", lowered.alias("run"))
    made = made.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    k = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), k), F.substring("run", k + 2, F.length("run")))
    made = made.select(F.when(F.col("h") % drop_every == 0, cut).otherwise(F.col("run")).alias("word"))
    return made.where(F.length("word") >= least)


def vocabulary(words: DataFrame, least: int = 2) -> DataFrame:
    """``(word, n)`` of the words that occur at least so often."""
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def gram_counts(words: DataFrame, qmin: int = QMIN, qmax: int = QMAX) -> DataFrame:
    """``(gram, n)``: how often each piece of ``qmin`` to ``qmax`` characters occurs in the marked words, once for each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for word in batch.column(0).to_pylist():
                word = f"{START}{word}{END}"
                for q in range(qmin, qmax + 1):
                    counts.update(word[p : p + q] for p in range(len(word) - q + 1))
                if len(counts) > _PARTIAL:
                    yield pa.RecordBatch.from_pydict({"gram": list(counts), "n": list(counts.values())})
                    counts.clear()
        if counts:
            yield pa.RecordBatch.from_pydict({"gram": list(counts), "n": list(counts.values())})

    return words.select("word").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def frequent_grams(words: DataFrame, qmin: int = QMIN, qmax: int = QMAX, threshold: int = FREQUENT, most: int = MOST_FREQUENT) -> Grams:
    """The dictionary's inner grams: those above the threshold, which rises so that at most ``most`` can pass it."""
    counts = as_table(gram_counts(words, qmin, qmax), "grams")
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.where(F.col("n") > max(threshold, total // most)).collect()  # each takes more than total / most of the total
    return Grams({r.gram: r.n for r in rows}, qmin, qmax)


def _lists(words: DataFrame, grams: Grams) -> DataFrame:
    """``(word, n, long, start, end)``: the grams to merge by; a row without a place for words whose bound covers all."""
    sent = words.sparkSession.sparkContext.broadcast(grams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, ends, longs = [], [], [], []
            for at, word in enumerate(batch.column(0).to_pylist()):
                found, sure = sent.value.rarest(f"{START}{word}{END}")
                found = found if sure else [*found, (None, None)]
                rows += [at] * len(found)
                starts += [p for p, _ in found]
                ends += [e for _, e in found]
                longs += [len(word) + 2] * len(found)
            columns = [*(c.take(pa.array(rows, pa.int64())) for c in batch.columns), *(pa.array(c, pa.int32()) for c in (longs, starts, ends))]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "n", "long", "start", "end"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, long int, start int, end int")


def _verified(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of equal keys whose words are one edit apart, each once."""
    left = left.select("key", F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("long").alias("a_long"))
    right = right.select("key", F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("long").alias("b_long"))
    found = left.join(right, "key").where((F.col("a_long") < F.col("b_long")) | ((F.col("a_long") == F.col("b_long")) & (F.col("a") < F.col("b"))))
    return found.where(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n").distinct()


def near_pairs(words: DataFrame, qmin: int = QMIN, qmax: int = QMAX, threshold: int = FREQUENT, most: int = MOST_FREQUENT) -> DataFrame:
    """``(a, a_n, b, b_n)``: pairs of different words that differ by one inserted, deleted or replaced code point, each once.

    ``words`` has different words with their numbers ``n``, and is read several times (a table). Words may be of any length.
    """
    lists = as_table(_lists(words, frequent_grams(words, qmin, qmax, threshold, most)), "gram_lists")
    kept, listed = ["word", "n", "long"], lists.where("start is not null")
    marked = F.concat(F.lit(START), "word", F.lit(END))
    upto, onward = F.substring(marked, F.lit(1), F.col("end")), F.substring(marked, F.col("start") + 1, F.col("long"))
    sides = F.array(F.xxhash64(F.lit("up to"), upto), F.xxhash64(F.lit("from"), onward))
    sided = listed.select(*kept, F.explode(sides).alias("side"))
    index = sided.select(F.xxhash64("side", "long").alias("key"), *kept)
    probes = sided.select("side", *kept, F.explode(F.array("long", F.col("long") + 1)).alias("other")).select(F.xxhash64("side", "other").alias("key"), *kept)
    short = lists.where("start is null").select(*kept)
    less = lambda i: F.concat(F.substring("word", F.lit(1), i), F.substring("word", i + 2, F.length("word")))
    hole = lambda i: F.concat(F.substring("word", F.lit(1), i), F.lit(START), F.substring("word", i + 2, F.length("word")))
    places = F.sequence(F.lit(0), F.length("word") - 1)
    whole = short.select(F.explode(F.concat(F.array("word"), F.transform(places, hole))).alias("k"), *kept)
    cut = short.select(F.explode(F.concat(F.transform(places, less), F.transform(places, hole))).alias("k"), *kept)
    hashed = lambda df: df.select(F.xxhash64("k").alias("key"), *kept)
    return _verified(probes, index).union(_verified(hashed(whole), hashed(cut))).distinct()


def forms(words: DataFrame, pairs: DataFrame, ratio: int = 10) -> DataFrame:
    """``(word, n, n_near, form, form_n)`` of each word.

    ``form``: the near word of largest ``n`` (ties: least in code-point order), if that is at least ``ratio`` times the word's.
    """
    there = pairs.select(F.col("a").alias("of"), F.col("b").alias("other"), F.col("b_n").alias("other_n"))
    both = there.union(pairs.select("b", "a", "a_n"))
    best = both.groupBy("of").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("best"))
    made = words.join(best, F.col("word") == F.col("of"), "left")
    taken = -F.col("best.minus") >= ratio * F.col("n")
    return made.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("best.other")).alias("form"), F.when(taken, -F.col("best.minus")).alias("form_n"))


def roots(links: DataFrame) -> DataFrame:
    """``(word, root)`` of words with a ``form``: forms followed to the last, by doubling the steps.

    A form is more frequent by a factor, so chains end and are short: their length is at most a logarithm of the counts.
    """
    now = as_table(links.where("form is not null").select("word", F.col("form").alias("root")), "links")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        step = as_table(step, "links")
        now = step.select("word", "root")
        if step.where("moved").isEmpty():
            return now


def spelling_groups(words: DataFrame, ratio: int = 10, **grams: int) -> DataFrame:
    """``(word, n, n_near, form, form_n, root)`` of each row of ``words`` (word, n): different words and their numbers.

    Other columns are not read; null words are left out. No word: no row. Many near words of one word meet in partial aggregates only.
    """
    words = as_table(words.where("word is not null").select("word", F.col("n").cast("long").alias("n")), "words")
    found = as_table(forms(words, near_pairs(words, **grams), ratio), "forms")
    last = roots(found).select(F.col("word").alias("of"), "root")
    return found.join(last, F.col("word") == F.col("of"), "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
