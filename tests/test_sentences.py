import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recfeat.functions import chunks, pieces
from recfeat.operators import sentences

SHORT = ["Dr.", "Mr.", "etc.", "p.m.", "e.g.", "St.", "approx.", "No."]
NAMES = ["Smith", "Miller", "Jones", "Okafor", "Lindqvist"]


def corpus(n, seed):
    """Texts with their sentences: abbreviations before names, numbers and small words, and sometimes at the end."""
    rng = random.Random(seed)
    common = [f"{a}{b}{c}" for a in ("ba", "ko", "lin", "mer", "so", "tu") for b in ("da", "ri", "pen", "lo") for c in ("", "n", "st", "ra")]
    texts = []
    for _ in range(n):
        said = []
        for _ in range(rng.randint(2, 9)):
            words = rng.choices(common, k=rng.randint(3, 9))
            words[0] = words[0].capitalize()
            for _ in range(rng.choice([0, 1, 1, 2])):
                at, short = rng.randrange(1, len(words)), rng.choice(SHORT)
                after = [rng.choice(NAMES)] if short in ("Dr.", "Mr.", "St.") else [str(rng.randint(1, 99))] if short in ("approx.", "No.") else [rng.choice(common)]
                words[at:at] = [short, *after]
            if rng.random() < 0.2:
                words.insert(rng.randrange(1, len(words)), f"{rng.randint(1, 9)}.{rng.randint(10, 99)}")
            end = rng.choices([".", "!", "?", ".\"", " p.m."], [20, 2, 2, 1, 1])[0]
            said.append(" ".join(words) + end)
        texts.append(said)
    return texts


@pytest.fixture(scope="module")
def learned(spark):
    texts = corpus(600, 1)
    return sentences.learn(spark.createDataFrame([(" ".join(t),) for t in texts] + [(None,), ("",)], "text string"))


def test_abbreviations_are_found(learned):
    assert {s.lower().removesuffix(".") for s in SHORT} <= learned.abbreviations
    assert len(learned.abbreviations) < 20


def test_planted_boundaries(spark, learned):
    texts = corpus(300, 2)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: r.s for r in df.select("i", sentences.split(F.col("text"), learned).alias("s")).collect()}
    right = found = wanted = 0
    for i, said in enumerate(texts):
        cuts = lambda parts: {sum(len(p.replace(" ", "")) for p in parts[:k]) for k in range(1, len(parts))}
        mine, theirs = cuts(got[i]), cuts(said)
        right, found, wanted = right + len(mine & theirs), found + len(mine), wanted + len(theirs)
        assert "".join(got[i]).replace(" ", "") == "".join(said).replace(" ", "")
    assert 2 * right / (found + wanted) >= 0.97


def test_examples(learned):
    assert learned.split("Dr. Smith paid 3.50 p.m. today.") == ["Dr. Smith paid 3.50 p.m. today."]
    assert learned.split("Dr. Smith came. Mr. Jones went!  Who (e.g. badan) stayed?\nNobody.") == ["Dr. Smith came.", "Mr. Jones went!", "Who (e.g. badan) stayed?", "Nobody."]
    assert learned.split(None) == learned.split(" \n ") == [] and learned.split("他来了。她走了！end") == ["他来了。", "她走了！", "end"]
    long = "word " * 200_000 + "end. Next one."
    assert [len(s) for s in learned.split(long)] == [1_000_004, 9]
    assert sentences.Boundaries().split("a.b. c... D. E") == ["a.b.", "c... D. E"]


def test_nothing_to_learn_from(spark):
    none = sentences.learn(spark.createDataFrame([], "text string"))
    assert not none.abbreviations and none.split("One. Two.") == ["One.", "Two."]


def brute_pieces(word, vocabulary):
    """Longest match, character by character."""
    text, out, at = pieces.START + word, [], 0
    while at < len(text):
        k = next((k for k in range(len(text) - at, 0, -1) if text[at : at + k] in vocabulary), 0)
        out += [vocabulary[text[at : at + k]]] if k else [pieces.FIRST_ID + b for b in text[at].encode()]
        at += max(k, 1)
    return out


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abcé漢\x01", min_size=1, max_size=5), max_size=30), st.lists(st.text("abcdé漢字😀", max_size=12), max_size=12))
def test_trie_equals_brute_force(vocabulary, words):
    numbered = {p: 1000 + i for i, p in enumerate(sorted(vocabulary))}
    trie = pieces.Trie(numbered)
    got = trie.encode(words)
    assert got == [brute_pieces(w, numbered) for w in words]
    names = {i: p for p, i in numbered.items()}
    assert [trie.decode(ids, names) for ids in got] == words
    assert trie.decode([i for ids in got for i in ids], names) == " ".join(words)


def test_learned_pieces(spark):
    docs = spark.createDataFrame([("low lower lowest newer newest wide widest",)] * 50 + [(None,), ("",), ("zzz漢",)], "text string")
    words = pieces.histogram(docs)
    vocabulary = {r.piece: r.id for r in pieces.learn(words, size=40, longest=6).collect()}
    assert len(vocabulary) == 40 and sorted(vocabulary.values()) == list(range(266, 306))
    df = spark.createDataFrame([(["lowest newest", "漢 zz", "", None],), (None,), ([],)], "s array<string>")
    got = [r.ids for r in df.select(pieces.encoded(F.col("s"), vocabulary).alias("ids")).collect()]
    assert got[1] is None and got[2] == []
    assert got[0] == [[i for w in (s or "").split() for i in brute_pieces(w, vocabulary)] for s in df.first().s]
    assert pieces.learn(words.limit(0)).count() == 0 and pieces.Trie({}).encode(["ab"]) == [[11, 107, 108]]


def brute_chunks(ids, max_tok, max_chunks):
    """The packing rule, sentence by sentence."""
    out, body, marks = [], [], []
    for one in ids or []:
        led = [3, *(one or [])[: max_tok - 3]]
        if body and len(body) + len(led) > max_tok - 2:
            out.append(([1, *body, 2], marks))
            body, marks = [], []
        marks = [*marks, len(body) + 1]
        body = body + led
    return [*out, ([1, *body, 2], marks)][:max_chunks] if body else []


@pytest.mark.parametrize(("max_tok", "max_chunks"), [(12, 3), (4, 2), (384, 4)])
def test_chunks_equal_brute_force(spark, max_tok, max_chunks):
    rng = random.Random(max_tok)
    rows = [([[rng.randrange(10, 99) for _ in range(rng.choice([0, 1, 3, 8, 30]))] for _ in range(rng.randint(0, 40))],) for _ in range(60)] + [(None,), ([None, [5]],)]
    df = spark.createDataFrame(rows, "ids array<array<int>>")
    got = [[(c.ids, c.marks) for c in r.c] for r in df.select(chunks.sentence_chunks(F.col("ids"), max_tok, max_chunks).alias("c")).collect()]
    assert got == [brute_chunks(r[0], max_tok, max_chunks) for r in rows]


def test_a_text_of_very_many_sentences(spark):
    df = spark.range(1).select(F.array_repeat(F.array(F.lit(7)), 100_000).alias("ids"))
    got = df.select(chunks.sentence_chunks(F.col("ids")).alias("c")).first().c
    assert [len(c.ids) for c in got] == [384] * 4 and all(len(c.marks) == 191 for c in got)


def test_a_batch_of_texts_is_split_a_few_at_a_time():
    """The Python objects of a batch do not grow with it."""
    import tracemalloc

    import pyarrow as pa

    texts = pa.array([None, "", *("word " * 2000 + f"is {i}. Next one!" for i in range(1500))])
    tracemalloc.start()
    got = sentences.split_texts(texts, sentences.Boundaries())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5_000_000 < texts.nbytes
    assert got[:2].to_pylist() == [[], []] and got[1501].as_py() == ["word " * 2000 + "is 1499.", "Next one!"] and len(got) == 1502
    assert sentences.split_texts(texts[:0], sentences.Boundaries()).to_pylist() == []


def test_tables_of_any_size_are_used_whole(spark):
    """Where the learned tables are too large to send to all, each text meets its own entries: nothing is dropped."""
    texts = [" ".join(t) for t in corpus(400, 3)] + [None, "", "\n", "他来了。Dr. Smith去了。e.g. badan. Next one.", "a.b. c... D. E", "Dr. Smith paid No. 7 p.m. Then left."] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(3)
    got = lambda frame: {r.i: r.sentences for r in frame.select("i", "sentences").collect()}
    whole = got(sentences.with_sentences(df))
    assert len(whole) == len(texts) and whole[400] == [] and sum(map(len, whole.values())) > 2000
    for most in (0, 2):
        assert got(sentences.with_sentences(df, most=most)) == whole
        with pytest.raises(ValueError, match=f"more than {most} entries"):
            sentences.learn(df, most=most)
    bounds = sentences.learn(df)
    assert got(df.withColumn("sentences", sentences.split(F.col("text"), bounds))) == whole


def test_a_long_word_after_a_period_is_looked_up_whole():
    long = "w" * 300
    bounds = sentences.Boundaries(abbreviations=frozenset(["dr"]), openers=frozenset([long]))
    assert bounds.split(f"A dr. {long.capitalize()} x.") == ["A dr.", f"{long.capitalize()} x."]
    assert sentences.asked(f"A dr. {long.capitalize()} x. 3. Y! Z") == [("dr", long), ("x", "##")]
