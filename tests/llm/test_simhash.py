import random

import xxhash
from pyspark.sql import functions as F

from recfeat.llm import graph, simhash

from ..conftest import rows


def brute_fingerprint(text):
    import re

    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    label = {n: n for n in nodes}
    while True:
        new = {a: min([label[a], *(label[b] for b in nodes if linked(a, b))]) for a in nodes}
        if new == label:
            return label
        label = new


def test_fingerprint_equals_the_rule(spark):
    rng = random.Random(0)
    texts = [" ".join(rng.choices(["Ab", "c", "É", "d e", "\x1c"], k=rng.randint(0, 40))) for _ in range(100)] + ["", None, "one", "Two  words", "\t\n", "x" * 100_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.fp % 2**64 for r in simhash.fingerprints(df).collect()}
    assert got == {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    long = ("Some words " * 60_000)
    assert simhash.fingerprint(long.encode()) == brute_fingerprint(long)


def test_close_pairs_lose_no_link(spark):
    rng = random.Random(1)
    values = {rng.getrandbits(64) for _ in range(40)}
    for v in list(values):
        for _ in range(4):
            values.add(v ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))))
    signed = [v - 2**64 if v >> 63 else v for v in values]
    want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) % 2**64).count("1") <= 3}
    got = simhash.close_pairs(spark.createDataFrame([(v,) for v in signed], "fp long"))
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_components_equal_brute_force(spark):
    rng = random.Random(2)
    for n, m in ((30, 20), (40, 60), (2, 1)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(None, 1)]
        pairs = {frozenset(e) for e in edges}
        nodes = sorted({x for e in edges[:-1] if e[0] != e[1] for x in e})
        want = brute_components(nodes, lambda a, b: frozenset((a, b)) in pairs)
        got = graph.components(spark.createDataFrame(edges, "x long, y long"))
        assert {r.node: r.component for r in got.collect()} == want and got.count() == len(want)
    chain = spark.range(200).select("id", (F.col("id") + 1).alias("to"))
    assert graph.components(chain).agg(F.max("component"), F.count("*")).first() == (0, 201)
    assert graph.components(chain.limit(0)).count() == 0


def documents():
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefg", k=5))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(400)]
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(400)] = word()
            texts.append(" ".join(copy))
    texts += ["", None, "  ", "same", "same"]
    return [(i, t, "clash") for i, t in enumerate(texts)]


def test_groups_equal_brute_force(spark):
    data = documents()
    df = spark.createDataFrame(data, "doc_id long, text string, fp string").repartition(3)
    fps = {i: brute_fingerprint(t) for i, t, _ in data}
    want = brute_components(sorted(fps), lambda a, b: bin(fps[a] ^ fps[b]).count("1") <= 3)
    got = simhash.near_duplicates(df)
    assert {r.doc_id: r.component_id for r in got.collect()} == want and got.count() == len(data)
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_links_connect_what_pairs_connect_and_stay_few(spark):
    """A dense cluster, where nearly all pairs are close, and a sparse one."""
    rng = random.Random(4)
    center, values = rng.getrandbits(64), set()
    while len(values) < 20_000:
        values.add(center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))))
    edges = simhash.links(spark.createDataFrame([(v - 2**64 if v >> 63 else v,) for v in values], "fp long"))
    assert edges.count() < 65 * len(values)
    assert graph.components(edges).select("component").distinct().count() == 1
    few = set(rng.sample(sorted(values), 150)) | {rng.getrandbits(64) for _ in range(50)}
    for v in list(few)[:100]:
        few.add(v ^ sum(1 << b for b in rng.sample(range(64), 3)))
    signed = [v - 2**64 if v >> 63 else v for v in few]
    want = brute_components(signed, lambda a, b: bin((a ^ b) % 2**64).count("1") <= 3)
    got = {r.node: r.component for r in graph.components(simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"))).collect()}
    assert {v: got.get(v, v) for v in signed} == want


def test_one_id_with_several_texts(spark):
    """Each row goes or stays by its own group; an id that is least in one group may go in another."""
    a, b = "one two three four five six", "quite another text that stands alone"
    data = [(3, a), (5, a), (5, b), (6, b), (7, "x y z"), (7, "p q r s"), (7, "x y z")]
    df = spark.createDataFrame([(i, t, "extra") for i, t in data], "doc_id long, text string, fp string")
    got = rows(simhash.keep_first(df).select("doc_id", "text"))
    assert got == sorted([(3, a), (5, b), (7, "x y z"), (7, "p q r s")], key=repr)


def test_nulls_repeats_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, "other text here now"), (2, "A B C D")], "doc_id long, text string")
    got = rows(simhash.near_duplicates(df).select("doc_id", "component_id"))
    assert got == [(1, 1), (1, 1), (2, 1), (None, 1), (None, None)]
    assert rows(simhash.keep_first(df).select("doc_id")) == [(1,), (None,), (None,)]
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.keep_first(df.limit(0)).count() == 0
