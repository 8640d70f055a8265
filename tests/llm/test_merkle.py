import hashlib
import random

from pyspark.sql import functions as F

from recfeat.llm import merkle


def H(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    """The root and each leaf's steps, by plain recursion over levels."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 8] for i in range(0, len(nodes), 8)]
        for k, i in enumerate(at):
            run = runs[i // 8]
            steps[k].append((i % 8, run[: i % 8] + run[i % 8 + 1 :]))
            at[k] = i // 8
        nodes = [H(r) for r in runs]
    return nodes[0], steps


def brute(rows):
    """rows (lang, doc_id, leaf) -> sorted (lang, doc_id, leaf, subroot, root, steps)."""
    first = lambda x: (x is not None, x.encode() if isinstance(x, str) else x or 0)
    groups = {}
    for lang, i, d in rows:
        groups.setdefault(lang, []).append((first(i), d, i))
    done = {g: ([(i, d) for _, d, i in sorted(v)], *tree([d for _, d, _ in sorted(v)])) for g, v in groups.items()}
    order = sorted(done, key=first)
    root, above = tree([done[g][1] for g in order]) if order else (None, [])
    return sorted(
        ((g, i, d, sub, root, steps[k] + above[n]) for n, g in enumerate(order) for leaves, sub, steps in [done[g]] for k, (i, d) in enumerate(leaves)), key=repr
    )


def run(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, doc_id long, leaf string, path int, g string").repartition(5)
    made = merkle.manifest(df).withColumn("folded", merkle.folded(F.col("leaf"), F.col("path"))).withColumn("proof", merkle.proof_digest(F.col("path")))
    got = made.collect()
    assert all(r.folded == r.root for r in got)
    assert all(r.proof == H([x for s in r.path for x in s.others]) for r in got)
    return sorted(((r.lang, r.doc_id, r.leaf, r.subroot, r.root, [(s.place, list(s.others)) for s in r.path]) for r in got), key=repr)


def test_groups_of_all_shapes(spark):
    rng = random.Random(0)
    sizes = {"a": 1, "b": 7, "c": 8, "d": 9, "é": 64, "z": 65, None: 513, "hot": 1300, "e": 2, "f": 520, "g": 3}
    rows = [(g, i, H([str(rng.random())])) for g, n in sizes.items() for i in rng.sample(range(10 * n), n)]
    assert run(spark, rows) == brute(rows)


def test_rounds_over_many_blocks(spark, monkeypatch):
    """Blocks of eight leaves, so that several rounds with last subtrees of all widths are exchanged."""
    monkeypatch.setattr(merkle, "DEPTH", 1)
    for n in (65, 130, 521):
        rows = [("a", i, H([str(i)])) for i in range(n)] + [("b", 1, "00"), (None, 2, "01")]
        assert run(spark, rows) == brute(rows), n


def test_nulls_repeats_and_empty(spark):
    rows = [("a", None, "aa"), ("a", 1, "bb"), ("a", 1, "bb"), ("a", 1, "ab"), (None, None, "cc")]
    assert run(spark, rows) == brute(rows)
    same = [("a", 5, "dd")] * 700
    assert run(spark, same) == brute(same)
    one = [(None, 3, "ee")]
    assert run(spark, one) == brute(one) and brute(one)[0][4] == "ee"
    assert run(spark, []) == []


def test_leaf_and_tampering(spark):
    long = "Añ" * 400_000
    docs = [(1, "s", "en", 3, "Abc"), (2, None, None, None, None), (None, "", "é", 0, ""), (4, "s", "en", 1, long)]
    df = spark.createDataFrame(docs, "doc_id long, source string, lang string, n_chars long, text string")
    text = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    rows = df.select("*", merkle.leaf("doc_id", "source", "lang", "n_chars", "text").alias("leaf"))
    assert [r.leaf for r in rows.collect()] == [H(map(text, d)) for d in docs]
    made = merkle.manifest(rows.withColumn("claim", F.when(F.col("doc_id") == 1, "00").otherwise(F.col("leaf"))), keep=("claim",))
    made = made.withColumn("ok", merkle.folded(F.col("claim"), F.col("path")) == F.col("root"))
    assert {r.doc_id: r.ok for r in made.collect()} == {1: False, 2: True, None: True, 4: True}
