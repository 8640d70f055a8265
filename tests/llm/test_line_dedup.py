import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from recfeat.llm import line_dedup as ld


def brute(docs, least=10):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x))
    holders = {}
    for i, t in docs:
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        gone = lambda x: len(key(x)) >= least and len(holders[key(x)]) > 1 and i != min(holders[key(x)])
        kept = [x for x in lines if not gone(x)]
        out.append((i, len(lines), len(lines) - len(kept), None if t is None else "\n".join(kept)))
    return sorted(out, key=repr)


def made(seed):
    rng = random.Random(seed)
    pool = ["Subscribe to our list", "  subscribe TO our list\t", "short", "ééééééééé", "éééééééééé", "A long line of its own", "", "x" * 3000, "\x1cspaced\x1c line here"]
    docs = [(i, "\n".join(rng.choices(pool, k=rng.randint(0, 5)) + [f"unique line number {i}"] * rng.randint(0, 2))) for i in range(40)]
    return [*docs, (41, None), (42, ""), (43, "only once here\nonly once here"), (7, "Subscribe to our list"), (44, "a" * 200_000)]


@pytest.mark.parametrize("bits,most", [(None, ld.MAX_BITS), (1 << 7, 1 << 7), (1 << 12, 1 << 10)])
def test_equals_brute_force(spark, bits, most):
    """With a filter of 128 bits nearly every line is suspected, and the last is made in four blocks; the result is the same."""
    docs = made(4)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = ld.dedup_lines(df, bits=bits, max_bits=most)
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()), key=repr) == brute(docs)


def test_the_share_of_suspects_does_not_grow_with_the_input(spark):
    """Unlike lines are hardly ever suspected, whether the filter is held at once or made in blocks."""
    for n, most in ((500, 1 << 20), (5000, 1 << 20), (5000, 1 << 18)):
        df = spark.range(n).selectExpr("id doc_id", "array_join(transform(sequence(1, 30), x -> concat('line ', md5(concat(id, '-', x)))), '\n') text")
        assert ld.suspected_lines(df, "doc_id", "text", max_bits=most).count() < 0.2 * 30 * n


def test_hot_and_missing_ids_are_split_by_text(spark):
    """Many rows of one id, and many without one, hold repeated lines: each row finds its own."""
    docs = [(None, f"shared by number {i % 50} of them\nown {i} line of this one") for i in range(300)] + [(9, f"shared by number {i % 50} of them") for i in range(300)]
    docs += [(1, f"shared by number {i} of them") for i in range(25)]
    got = ld.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert all(r.n_dropped == 1 for r in got if r.doc_id is None) and {r.n_dropped for r in got if r.doc_id == 1} == {0}
    assert sum(r.n_dropped for r in got if r.doc_id == 9) == 150 and len(got) == 625


def test_null_ids_come_last_and_columns_stay(spark):
    df = spark.createDataFrame([(None, "a line of some length", 1), (3, "A line of some length", 2), (None, None, 3)], "doc_id long, text string, n_lines int")
    got = sorted(((r.doc_id, r.text, r.n_lines, r["_n_lines"], r.n_dropped) for r in ld.dedup_lines(df).collect()), key=repr)
    assert got == [(3, "A line of some length", 2, 1, 0), (None, "", 1, 1, 1), (None, None, 3, 1, 0)]
    assert ld.dedup_lines(df.limit(0)).count() == 0


def test_second_filter_misses_no_repeat():
    rng = np.random.default_rng(1)
    a, b = ld.BitPair(1 << 12), ld.BitPair(1 << 12)
    x, y = rng.integers(0, 2**63, 300).astype(np.uint64), rng.integers(0, 2**63, 300).astype(np.uint64)
    a.add(np.concatenate([x, x[:10]]))
    b.add(np.concatenate([y, x[100:120]]))
    twice = a.twice | b.twice | (a.once & b.once)
    seen = lambda h: ld.BitPair.get(twice, a.probes(h)[0]) & ld.BitPair.get(twice, a.probes(h)[1])
    assert seen(x[:10]).all() and seen(x[100:120]).all() and seen(y).mean() < 0.5


def counting(seen):
    @F.pandas_udf("string")
    def counted(texts: pd.Series) -> pd.Series:
        seen.add(len(texts))
        return texts

    return counted


def test_texts_are_read_a_fixed_number_of_times(spark):
    """Four or sixteen blocks of filters: as many texts read as with four, and the same rows as with one block."""
    n = 400
    df = spark.range(n).selectExpr("id as doc_id", "concat('line of ', id, ' alone\n', 'shared by some ', id % 97, '\nshort') as text")
    want, read = None, []
    for most in (1 << 12, 1 << 10, 1 << 8):
        seen = spark.sparkContext.accumulator(0)
        found = ld.suspected_lines(df.withColumn("text", counting(seen)("text")), "doc_id", "text", bits=1 << 12, max_bits=most)
        got = {r.id for r in found.collect()}
        assert got == set(range(n))
        read.append(seen.value)
        rows = sorted(map(tuple, ld.dedup_lines(df, bits=1 << 12, max_bits=most).collect()))
        want = want or rows
        assert rows == want
    assert read[1] == read[2] <= 2 * read[0]
