import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from recfeat.llm import packing
from recfeat.llm.queries import ENCODER


def fewest(sizes, capacity):
    """The least number of bins, by trying all."""
    best = len(sizes)

    def go(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(sizes):
            best = len(bins)
            return
        for i in sorted(set(range(len(bins))), key=lambda i: bins[i]):
            if bins[i] + sizes[k] <= capacity:
                bins[i] += sizes[k]
                go(k + 1, bins)
                bins[i] -= sizes[k]
        bins.append(sizes[k])
        go(k + 1, bins)
        bins.pop()

    go(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_dominance_keeps_a_best_solution(sizes):
    rest = Counter(sizes)
    fixed = packing.dominant(rest, 20)
    left = sorted(rest.elements(), reverse=True)
    assert sum(n for _, n in fixed) + fewest(left, 20) == fewest(sorted(sizes, reverse=True), 20)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=300))
def test_plans_are_whole_and_near_the_bound(sizes):
    made, got = packing.plan(Counter(sizes), 50), Counter()
    for pattern, times in made:
        assert times > 0 and sum(x * n for x, n in pattern) <= 50
        for x, n in pattern:
            got[x] += n * times
    assert got == Counter(sizes)
    assert sum(n for _, n in made) <= math.ceil(11 / 9 * math.ceil(sum(sizes) / 50)) + 1 or max(sizes) > 16


def test_cut():
    assert packing.cut(1, 4) == [(0, 1)] and packing.cut(4, 4) == [(0, 4)] and packing.cut(9, 4) == [(0, 1), (1, 4), (5, 4)]


def test_rank_file_gives_the_tokenizers_ids():
    both, plain = packing.Encoder(**ENCODER), packing.Encoder(ENCODER["tokenizer_path"])
    rng = random.Random(0)
    pieces = ["the", " of", "é", "ß", "\n\n", "  ", "\t", "123", "'s", "...", "😀", "<|endoftext|>", "ñción", " ", "́", "AKIA", "$$$", "\r\n", "漢字", "\x00"]
    for _ in range(3000):
        text = "".join(rng.choices(pieces, k=rng.randint(0, 12)))
        assert both(text).tolist() == plain(text).tolist()


def check(rows, docs, capacity):
    by, places = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in places.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= capacity
    encode = packing.Encoder(ENCODER["tokenizer_path"])
    for i, text in docs:
        ids = np.append(encode(text or ""), 0).astype("<u4")
        mine = sorted(by[i], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in mine] == [(k, *c) for k, c in enumerate(packing.cut(len(ids), capacity))]
        assert [r.ids_crc32 for r in mine] == [zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in mine]
    return len(places)


def test_documents(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choices(["alpha", "beta", "γ", "1"], k=rng.choice([0, 3, 9, 40])))) for i in range(300)] + [(300, None), (301, "long " * 3000)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, length int").repartition(3)
    rows = packing.pack_documents(df, ENCODER, capacity=64).collect()
    used = check(rows, docs, 64)
    assert used <= math.ceil(sum(r.length for r in rows) / 64) * 1.05 + 1


def test_repeats_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (None, None)], "doc_id long, text string")
    rows = packing.pack_documents(df, ENCODER, keep_ids=True).collect()
    assert len(rows) == 4 and len({(r.sequence_id, r.offset) for r in rows}) == 4 and len({r.sequence_id for r in rows}) == 1
    assert sorted(len(r.ids) for r in rows) == [1, 2, 2, 2]
    assert packing.pack_documents(df.limit(0), ENCODER).count() == 0
    with pytest.raises(ValueError, match="length"):
        packing.pack(spark.createDataFrame([(1, 0, 9)], "doc_id long, piece int, length long"), 8)
