import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from recfeat.llm import variants


def near(a, b):
    """One inserted, deleted or replaced code point, by trying all places."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words, ratio=10):
    made, form = {}, {}
    for w, n in words.items():
        others = [o for o in words if near(w, o)]
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best and words[best] >= ratio * n else None
        made[w] = (n, len(others), form[w], words[form[w]] if form[w] else None)
    root = {}
    for w in words:
        root[w] = w
        while form[root[w]]:
            root[w] = form[root[w]]
    return sorted((w, *made[w], root[w]) for w in words)


def dictionary(words, qmin, qmax, threshold):
    marked = [f"{variants.START}{w}{variants.END}" for w in words]
    counts = Counter(w[p : p + q] for w in marked for q in range(qmin, qmax + 1) for p in range(len(w) - q + 1))
    return variants.Grams({g: n for g, n in counts.items() if n > threshold}, qmin, qmax)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text("abé", min_size=1, max_size=12), min_size=1, max_size=12), st.integers(0, 3), st.integers(2, 5), st.randoms())
def test_no_edit_affects_more_grams_than_the_bound(words, threshold, qmax, rng):
    """Grams that stay are at the same distance from the start, or from the end, on one side of the edit."""
    grams = dictionary(words, 2, qmax, threshold)
    for word in words:
        s = f"{variants.START}{word}{variants.END}"
        mine = grams.decompose(s)
        bound = grams.affected(s, mine)
        for _ in range(8):
            kind, i = rng.choice("rid"), rng.randint(1, len(s) - 2)
            i = rng.randint(1, len(s) - 1) if kind == "i" else i
            t = s[:i] + (rng.choice("abé") if kind != "d" else "") + s[i + (kind != "i") :]
            move, theirs = len(t) - len(s), set(grams.decompose(t))
            kept = [(p, e) for p, e in mine if (e <= i and (p, e) in theirs) or (p >= i + (kind != "i") and (p + move, e + move) in theirs)]
            assert len(mine) - len(kept) <= bound, (s, t)


def vocabulary(seed, n, alphabet="abcdeé", least=7, most=10):
    rng = random.Random(seed)
    words = {}
    while len(words) < n:
        w = "".join(rng.choices(alphabet, k=rng.randint(least, most)))
        words[w] = rng.choice([2, 3, 30, 500, 9000])
        for _ in range(3):
            i = rng.randrange(len(w))
            v = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(alphabet) + w[i + 1 :], w[:i] + rng.choice(alphabet) + w[i:]])
            if len(v) >= least:
                words.setdefault(v, rng.choice([2, 3, 30, 500, 9000]))
    return words


@pytest.mark.parametrize(("alphabet", "qmax", "threshold"), [("abcdefghé", 4, 5), ("ab", 5, 3), ("abc", 6, 0), ("abcdefghé", 3, 10**9)])
def test_groups_equal_brute_force(spark, alphabet, qmax, threshold):
    words = vocabulary(qmax, 350, alphabet)
    df = spark.createDataFrame([(w, n, 1) for w, n in words.items()], "word string, n long, root int").repartition(3)
    got = variants.spelling_groups(df, qmin=2, qmax=qmax, threshold=threshold)
    assert sorted(tuple(r) for r in got.select("word", "n", "n_near", "form", "form_n", "root").collect()) == brute(words)


def test_few_grams_may_be_frequent(spark):
    words = spark.createDataFrame([(w, 2) for w in vocabulary(1, 300, "abc")], "word string, n long")
    grams = variants.frequent_grams(words, 2, 4, threshold=0, most=60)
    assert 0 < len(grams.counts) <= 60


def test_chains_and_hubs(spark):
    words = {"aaaaaaa": 10**6, "aaaaaab": 10**5, "aaaaabb": 10**4, "aaaabbb": 10**3, "aaabbbb": 100, "aabbbbb": 10, "abbbbbb": 9}
    hub = "mmmmmmmmm"
    words[hub] = 50_000
    for i in range(9):
        for c in "abcdefghijklopqrst":
            words[hub[:i] + c + hub[i + 1 :]] = 2
    got = variants.spelling_groups(spark.createDataFrame(list(words.items()), "word string, n long"))
    assert sorted(tuple(r) for r in got.select("word", "n", "n_near", "form", "form_n", "root").collect()) == brute(words)


def test_runs_of_texts(spark):
    long = "Ab" * 60_000
    docs = [(1, "Straße Straßenbahn straßenbahn, NAÏVETÉ naïveté × ÷abcdefg"), (2, None), (None, "Wonderful wonderful"), (3, ""), (4, long), (4, long), (5, " ".join(["kindness"] * 200))]
    docs += [(i, "repetition Repetition") for i in range(100, 400)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, run string").repartition(4)
    want = Counter()
    for i, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                want[run] += 1
    got = variants.vocabulary(variants.word_runs(df))
    assert {r.word: r.n for r in got.collect()} == {w: n for w, n in want.items() if n >= 2}
    assert variants.spelling_groups(got).count() == got.count()


def test_empty_and_null_words(spark):
    df = spark.createDataFrame([(None, 3), ("lonesome", 2)], "word string, n int")
    got = [tuple(r) for r in variants.spelling_groups(df).collect()]
    assert got == [("lonesome", 2, 0, None, None, "lonesome")]
    assert variants.spelling_groups(df.limit(0)).count() == 0
