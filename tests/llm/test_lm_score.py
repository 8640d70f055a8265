import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from recfeat.llm import lm_score as lm
from recfeat.llm.queries import fold

from ..conftest import rows


def brute_tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) + ["\n"]


def brute_base(docs, learned):
    c = Counter(t for _, x in learned for t in brute_tokens(x))
    n, v = sum(c.values()), len(c)
    out = []
    for i, x in docs:
        t = brute_tokens(x)
        out.append((i, len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)))
    return sorted(out, key=repr)


def made(seed=0):
    rng = random.Random(seed)
    words = [f"W{int(rng.paretovariate(0.7))}" for _ in range(3000)] + ["É", "x"]
    return [(i, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(120)] + [(120, None), (121, ""), (121, ""), (None, "Only here"), (122, "W1 " * 50_000)]


@pytest.mark.parametrize("head", [100_000, 10, 0])
def test_base_score_is_exact(spark, head):
    docs = made()
    learned = docs[:80]
    schema = "doc_id long, text string, score string"
    df, known = (spark.createDataFrame([(*d, "k") for d in x], schema).repartition(3) for x in (docs, learned))
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in lm.score(df, known, head_words=head).collect()), key=repr)
    want = brute_base(docs, learned)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert [r[4] for r in got] == pytest.approx([r[4] for r in want])


def test_filter_levels_are_never_too_low():
    rng = np.random.default_rng(0)
    hashes, counts = rng.integers(0, 2**63, 3000).astype(np.uint64), rng.geometric(0.2, 3000)
    bits = lm.LogBloom.shard(hashes, counts, 8 * int(lm.level(counts).sum() * 0.9), 5)
    bloom = lm.LogBloom(bits, np.array([0, len(bits)]), 5)
    assert (bloom.levels(hashes) >= lm.level(counts)).all() and (bloom.levels(hashes) == lm.level(counts)).mean() > 0.93
    assert (bloom.levels(rng.integers(0, 2**63, 3000).astype(np.uint64)) > 0).mean() < 0.07
    exact = np.arange(1, 5000)
    assert (np.abs(np.log(lm.LEVEL_COUNTS[lm.level(exact)] / exact)) < math.log(lm.LEVEL_BASE)).all() and lm.LEVEL_COUNTS[1] == 1


def test_the_model_beats_the_base_on_text_like_its_own(spark):
    rng = random.Random(1)
    follow = {w: [f"v{rng.randrange(50)}" for _ in range(3)] for w in [f"v{k}" for k in range(50)]}

    def text():
        w = ["v0"]
        for _ in range(200):
            w.append(rng.choice(follow[w[-1]]))
        return " ".join(w)

    df = spark.createDataFrame([(i, text()) for i in range(60)], "doc_id long, text string")
    got = lm.score(df, df.where("doc_id < 50")).where("doc_id >= 50").collect()
    assert all(r.base_score < r.score < 0 for r in got)


@pytest.mark.parametrize("head", [100, 2])
def test_model_follows_its_formula(spark, head):
    """Against the same smoothing with exact counts; quantised counts of 1 and 2 are exact."""
    texts = ["a b c", "a b d", "e", "f a", "b b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    c, p = Counter(), Counter()
    for t in texts:
        w = brute_tokens(t)
        c.update(w)
        p.update(zip(["\n", *w], w))
    n, v = sum(c.values()), len(c)
    often = [w for w in c if sum(c[x] >= c[w] for x in c) <= head]
    of = lambda w: int(math.log(c[w], 1.5) + 1e-9) + 1 if w in often else 0

    def smoothing(group):
        mine = [k for (a, _), k in p.items() if of(a) == group]
        once, twice = mine.count(1), mine.count(2)
        d = once / (once + 2 * twice) if once else 0.5
        return d, d * len(mine) / sum(mine)

    def score(t):
        w, out = brute_tokens(t), 0.0
        for a, b in zip(["\n", *w], w):
            d, left = smoothing(of(a))
            out += math.log10(min(1.0, max(p[a, b] - d, 0) / c[a] + left * (c[b] + 0.5) / (n + 0.5 * (v + 1))))
        return out

    assert [r.score for r in lm.score(df, df, head_words=head).orderBy("doc_id").collect()] == pytest.approx([score(t) for t in texts], rel=0.04)


def test_back_off_of_classes():
    discount, left = lm.back_off(np.array([[4, 0, 0], [1, 3, 0], [6, 3, 0], [10, 6, 0]]))
    assert discount.tolist() == pytest.approx([4 / 6, 0.5, 0.5]) and left.tolist() == pytest.approx([0.4, 0.25, 1.0])


def test_held_out_documents_score_above_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lm.score(docs, docs.where(fold("doc_id", 5) != 1)).where(fold("doc_id", 5) == 1).collect()
    assert len(got) > 150 and np.mean([r.score > r.base_score for r in got]) >= 0.95


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert rows(lm.score(df, df.limit(0)).select("doc_id", "n_tokens", "n_known", "train_tokens")) == [(1, 3, 0, 0), (2, 1, 0, 0)]
    assert lm.score(df.limit(0), df).count() == 0


def test_the_bound_on_the_filter_only_costs_accuracy(spark):
    df = spark.createDataFrame(made(), "doc_id long, text string")
    small, large = (lm.score(df, df, max_bytes=m).where("doc_id < 100").toPandas() for m in (2000, 1 << 20))
    assert len(small) == len(large) == 100 and np.isfinite(small.score).all() and (small.score <= 0).all()


@pytest.mark.parametrize("bound", [20_000, 4000])
def test_scores_hold_when_the_filter_passes_the_bound(spark, bound):
    """In several passes, at 4000 bytes with several blocks of words, scores are as with the whole filter."""
    rng = random.Random(2)
    words = [f"w{int(rng.paretovariate(0.9))}" for _ in range(4000)]
    df = spark.createDataFrame([(i, " ".join(rng.choices(words, k=100)) or None) for i in range(200)] + [(200, None)], "doc_id long, text string")
    small, large = (lm.score(df.where("doc_id >= 100"), df.where("doc_id < 100"), max_bytes=m).orderBy("doc_id").toPandas() for m in (bound, 1 << 24))
    assert len(small) == 101 and (small.drop(columns="score") == large.drop(columns="score")).all().all()
    assert (np.abs(small.score - large.score) / small.n_tokens).max() < 0.1 and np.corrcoef(small.score[:-1], large.score[:-1])[0, 1] > 0.97


def test_passes_cover_each_pair_once_within_the_bound():
    layout = lm.Layout(3, 2, 5)
    sizes = {s: 40 + s for s in range(layout.shards) if s % 4}
    held = list(layout.passes(sizes, 500))
    assert sorted(s for _, first, last in held for s in range(first, last)) == list(range(layout.first_pair, layout.shards))
    assert all(sum(sizes.get(s, 8) for s in shards) <= 500 for shards, _, _ in held)
    words = np.random.default_rng(0).integers(0, 2**64, 1000, dtype=np.uint64)
    pairs = layout.of_pairs(layout.pairs(words, np.array([1000]), np.array([1000])))
    mine = layout.of_words(words)
    for shards, first, last in held:
        here = (pairs >= first) & (pairs < last)
        assert {*mine[here], *np.roll(mine, 1)[here]} <= set(shards)


def test_a_part_of_the_filter_is_a_mapped_file_and_texts_are_taken_in_short_runs(spark, monkeypatch):
    """Workers hold neither the filter nor a batch's texts: shards lie in order in a mapped file, texts leave Arrow in runs."""
    import pyarrow as pa

    monkeypatch.setattr(lm, "BATCH_BYTES", 10)
    assert list(lm.groups(pa.array([b"x" * n for n in (4, 8, 1, 20, 3)]))) == [[b"x" * 4, b"x" * 8], [b"x", b"x" * 20], [b"xxx"]]
    made = spark.createDataFrame([(4, bytearray(b"d" * 16)), (1, bytearray(b"a" * 8)), (2, bytearray(b"b" * 24))], "shard int, bits binary")
    bloom = lm.Part(made, [1, 3, 4], {1: 8, 2: 24, 4: 16}, 6).bloom()
    assert isinstance(bloom.bits, np.memmap) and bytes(bloom.bits) == b"a" * 8 + bytes(8) + b"d" * 16
    assert bloom.starts.tolist() == [0, 0, 8, 8, 16, 32] and bloom.sizes.tolist() == [0, 8, 0, 8, 16, 0]
