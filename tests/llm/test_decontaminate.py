import random
import re

from recfeat.llm import decontaminate as d


def brute_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window):
    w, hit, names = brute_words(text), set(), set()
    for name, item in items:
        b = brute_words(item)
        m = min(window, len(b))
        for s in range(len(b) - m + 1) if b else ():
            for at in range(len(w) - m + 1):
                if w[at : at + m] == b[s : s + m]:
                    hit |= set(range(at, at + m))
                    names.add(str(name))
    return len(w), len(hit), sorted(names), bool(hit) and 20 * len(hit) >= len(w)


def made(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "C", "d1", "é", "naïve"]
    text = lambda n: "".join(w + rng.choice([" ", ", ", "_", "\n", "\u007f"]) for w in rng.choices(vocabulary, k=n))
    items = [(i, text(rng.choice([0, 1, 2, 3, 4, 5, 9]))) for i in range(8)] + [(3, "b b b b a"), (None, "a"), (9, None), (10, "x y z w v")]
    docs = [(i, text(rng.randint(0, 60)), "k") for i in range(30)] + [(None, None, None), (5, "x y z w v", "k"), (5, "x y z w v", "k")]
    return docs, items


def test_search_equals_brute_force(spark):
    for seed, block in ((0, 200_000), (1, 15)):  # the second in several blocks
        docs, items = made(seed)
        df = spark.createDataFrame(docs, "doc_id long, text string, items string").repartition(2)
        bench = spark.createDataFrame(items, "item_id long, text string")
        got = d.contamination(df, bench, window=4, block_words=block).collect()
        want = sorted((i, *brute(t, [x for x in items if x[0] is not None], 4)) for i, t, _ in docs if i is not None)
        assert sorted((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in got if r.doc_id is not None) == want
        assert [(r.n_words, r.n_hit) for r in got if r.doc_id is None] == [(0, 0)]


def test_threshold_and_columns(spark):
    item = " ".join(f"w{i}" for i in range(13))
    docs = spark.createDataFrame(
        [(1, item + " x" * 247, "a"), (2, item + " x" * 248, "b"), (3, " ".join(item.split()[:12]) + " y", "c")], "doc_id long, text string, n_hit string"
    )
    bench = spark.createDataFrame([("q", item)], "item_id string, text string")
    kept = d.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]
    found = d.contamination(docs, bench, keep=docs.columns).where("doc_id = 1").first()
    assert found["_n_hit"] == 13 and found["spans"] == [0, 13]


def test_empty_tables_and_long_items(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "z")], "item_id long, text string")
    assert d.contamination(docs, bench.limit(0)).first().n_hit == 0 and d.contamination(docs.limit(0), bench).count() == 0
    long = [f"v{i}" for i in range(9000)]
    bench = spark.createDataFrame([(1, " ".join(long))], "item_id long, text string")
    docs = spark.createDataFrame([(k, " ".join(long[k : k + 13])) for k in (0, 4080, 4096, 4100, 8987)] + [(9, " ".join(long * 3))], "doc_id long, text string")
    assert {r.n_hit for r in d.contamination(docs, bench).collect()} == {13, 27000}


def test_many_benchmark_words_are_one_pass_and_found(spark):
    """A hundred thousand patterns in one table; collisions of the shift table cost no occurrence."""
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(500)]
    items = [(k, " ".join(rng.choices(vocabulary, k=400))) for k in range(300)]
    names, among = d.searchers([(str(k), t.encode()) for k, t in items])
    assert len(among) == 1 and len(among[0].keys) == 300 * 388
    for k, t in rng.sample(items, 50):
        w = t.split()
        at = rng.randrange(381)
        text = [x.encode() for x in [*rng.choices(vocabulary, k=40), *w[at : at + 20], *rng.choices(vocabulary, k=40)]]
        spans, found = d.search(text, names, among)
        assert found == {str(k)} and any(a <= 40 and b >= 60 for a, b in spans)
    assert d.search([x.encode() for x in rng.choices(vocabulary, k=5000)], names, among) == ([], set())


def test_equal_patterns_name_all_their_items(spark):
    text = " ".join(f"v{k}" for k in range(13))
    bench = spark.createDataFrame([(k, f"a{k} {text}") for k in range(400)], "item_id long, text string")
    row = d.contamination(spark.createDataFrame([(1, f"{text} x")], "doc_id long, text string"), bench).first()
    assert row["items"] == sorted(str(k) for k in range(400)) and row["spans"] == [0, 13]
