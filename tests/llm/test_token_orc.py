import json
import random
import tracemalloc
import uuid
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.orc as orc
from tokenizers import Tokenizer

from recfeat.llm import token_orc
from recfeat.llm.common import fresh_path

FILE = public_tokenizers.path("word_bpe_49k.json")


def ids_of(text):
    return [*Tokenizer.from_file(FILE).encode(text or "", add_special_tokens=False).ids, 2]


def test_pieces_give_the_tokenizers_ids():
    code, whole, rng = token_orc.Coder(FILE), Tokenizer.from_file(FILE), random.Random(0)
    pieces = ["the", " of", "É", "ß", "\n\n", "  ", "\t", "12", "'s", "it's", "...", "😀", "<|endoftext|>", "<|startoftext|>", "Σ", "ΟΔΟΣ ", " ", " ", "́", " ́", "İ", "\r\n", "漢字", "\x00", "\x0b", "ạ̇", "'re"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 12))) for _ in range(4000)]
    texts += ["".join(rng.choices("aBcsTrelmdÀÖØöÿÞßéÑ×÷µ.,;:!?'' -1<|>", k=rng.randint(0, 20))) for _ in range(4000)] + list(map(chr, range(0x250)))
    for text, got in zip(texts, code(texts)):
        assert np.frombuffer(got, dtype="<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_a_full_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(token_orc, "CACHED", 20)
    code, whole = token_orc.Coder(FILE), Tokenizer.from_file(FILE)
    for i in range(60):
        text = " ".join(f"w{j} common" for j in range(i, i + 15))
        assert np.frombuffer(code([text])[0], dtype="<u4").tolist() == whole.encode(text, add_special_tokens=False).ids
        assert len(code.known) <= 21 and len(code.words) <= 21


def test_arrays_give_the_tokenizers_ids():
    code, whole, rng = token_orc.Coder(FILE), Tokenizer.from_file(FILE), random.Random(3)
    pieces = ["the", " of", "É", "ß", "\n\n", "  ", "\t", "12", "'s", "it's", "...", "😀", "<|endoftext|>", "<|startoftext|>", "Σ", " ", "\u00a0", "́", " ́", "İ", "\r\n", "漢字", "\x00", "ª", "µ", "'re", "ÿÑ×÷", "a" * 1500]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 12))) for _ in range(3000)] + list(map(chr, range(0x250))) + [None, "", " ", "\n"]
    texts += ["".join(rng.choices("aBcsTrelmdÀÖØöÿÞßéÑ×÷.,;:!?'' -1<|>", k=rng.randint(0, 20))) for _ in range(4000)]
    made = code.encode(pa.array(["not this", *texts]).slice(1), 7)
    assert [whole.encode(t or "", add_special_tokens=False).ids + [7] for t in texts] == made.to_pylist()
    for few in ([], ["漢字"], [""], [None], ["漢 字", "only\nLatin"]):
        made = code.encode(pa.array(few, pa.string()), 2).to_pylist()
        assert made == [whole.encode(t or "", add_special_tokens=False).ids + [2] for t in few]


def test_merging_by_rank_is_merging_by_rule():
    """The tokens' order is the merges' order, and the merges make each token of its own symbols: so no other pair of tokens makes it."""
    model = json.loads(Path(FILE).read_text())["model"]
    order = {tuple(m): i for i, m in enumerate(model["merges"])}
    made = [model["vocab"][a + b] for a, b in order]
    assert made == sorted(made) and min(made) > 511
    for token in (a + b for a, b in order):
        symbols = list(token.removesuffix("</w>"))
        symbols[-1] += "</w>" * token.endswith("</w>")
        while len(symbols) > 1:
            rank, at = min((order.get(pair, len(order)), i) for i, pair in enumerate(zip(symbols, symbols[1:])))
            assert rank < len(order), token
            symbols[at : at + 2] = ["".join(symbols[at : at + 2])]


def test_a_worker_stays_small():
    """Rare words do not add up in a worker, and a run of texts leaves nothing behind."""
    code, rng = token_orc.Coder(FILE), random.Random(4)
    texts = pa.array([" ".join("".join(rng.choices("abcdefghijklmnop", k=9)) for _ in range(20_000)) for _ in range(30)])
    assert [b - a for a, b in token_orc._runs(texts)] == [20, 10]
    tracemalloc.start()
    for first, last in token_orc._runs(texts):
        code.encode(texts.slice(first, last - first), 2)
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert kept < 5e6 and len(code.known) + len(code.words) < 1000


def test_a_cache_fills_to_its_end(monkeypatch):
    """More new pieces than there is room for: some are kept, and results stay."""
    monkeypatch.setattr(token_orc, "CACHED", 20)
    monkeypatch.setattr(token_orc, "AT_ONCE", 7)
    code, whole = token_orc.Coder(FILE), Tokenizer.from_file(FILE)
    for i in range(0, 90, 30):
        texts = [" ".join(f"слово{j} Latin 漢字" for j in range(i, i + 50)), "漢字"]
        assert code.encode(pa.array(texts), 2).to_pylist() == [[*whole.encode(t, add_special_tokens=False).ids, 2] for t in texts]
        assert len(code.known) == 20 and not code.words


def test_runs_of_texts(monkeypatch):
    monkeypatch.setattr(token_orc, "FLUSH", 10)
    texts = pa.array(["x", "a" * 6, None, "", "bcd", "e", "f" * 50, "", "g" * 10, "hé"])
    assert list(token_orc._runs(texts)) == [(0, 5), (5, 6), (6, 7), (7, 9), (9, 10)]
    assert list(token_orc._runs(texts.slice(6))) == [(0, 1), (1, 3), (3, 4)]
    assert list(token_orc._runs(texts[:0])) == []


def check(spark, docs, path):
    got = token_orc.checksums(token_orc.read_tokens(spark, path)).collect()
    assert len(got) == len(docs)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    at = 0
    for i in sorted({d[0] for d in docs}, key=lambda x: (x is not None, x)):
        mine = sorted(by[i], key=lambda r: r.start)
        want = sorted((ids_of(t) for j, t in docs if j == i), key=lambda x: zlib.crc32(np.array(x, dtype="<u4").tobytes()))
        assert sorted((r.n_tokens, r.ids_crc32) for r in mine) == sorted((len(w), zlib.crc32(np.array(w, dtype="<u4").tobytes())) for w in want)
        for r in mine:
            assert r.start == at
            at += r.n_tokens


def test_round_trip(spark):
    rng = random.Random(2)
    words = ["alpha", "Beta", "γάμμα", "12", "it's", "<|endoftext|>", "\n"]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 5, 60])))) for i in rng.sample(range(-500, 5000), 400)]
    docs += [(None, "no id"), (None, None), (7777, None), (7778, ""), (9, "long words " * 100_000), (10_000, "same"), (10_000, "same"), (10_000, "other")]
    docs += [(20_000, "copies")] * 300
    path = fresh_path(spark, "tokens")
    df = spark.createDataFrame([(*d, 1, "x", "y") for d in docs], "doc_id long, text string, n int, ids string, before string").repartition(6)
    token_orc.write_tokens(df, path, FILE)
    check(spark, docs, path)
    one = token_orc.read_tokens(spark, path, [10_000]).collect()
    assert sorted(list(r.ids) for r in one) == sorted([ids_of("same"), ids_of("same"), ids_of("other")])


def test_empty_table(spark):
    path = fresh_path(spark, "tokens")
    token_orc.write_tokens(spark.createDataFrame([], "doc_id long, text string"), path, FILE)
    assert token_orc.checksums(token_orc.read_tokens(spark, path)).count() == 0


def test_stripes_and_look_ups(spark, monkeypatch, tmp_path):
    """Files have several stripes, and a look-up reads a small part of the rows, also where ranges of statistics do not tell."""
    monkeypatch.setattr(token_orc, "STRIPE_BYTES", 100_000)
    n, rng = 60_000, random.Random(1)
    path = str(tmp_path / uuid.uuid4().hex)
    docs = spark.range(n).selectExpr("id * 2 as doc_id", "concat('doc ', id, ' ', md5(cast(id as string))) as text")
    token_orc.write_tokens(docs, path, FILE)
    files = sorted(Path(path).glob("part-*"))
    assert max(orc.ORCFile(f).nstripes for f in files) > 1

    def read(ids):
        """Rows that the scan gave out."""
        found = token_orc.read_tokens(spark, path, ids)
        plan = found._jdf.queryExecution().executedPlan()
        count = len(found.collect())
        text = plan.toString()
        assert "PushedFilters: [" in text and ("In(id" in text or "EqualTo(id" in text)
        scans = [p for p in _leaves(plan) if "Scan orc" in p.nodeName() and "In(id" in p.toString() or "EqualTo(id" in p.toString()]
        return count, min(s.metrics().apply("numOutputRows").value() for s in scans)

    some = rng.sample(range(n), 3)
    count, seen = read([2 * i for i in some])
    assert count == 3 and seen <= 3 * token_orc.ROWS_INDEXED + 3000
    count, seen = read([2 * some[0] + 1])  # within the range of a row group, but not there: the Bloom filter tells
    assert count == 0 and seen == 0


def _leaves(plan):
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
    if hasattr(plan, "plan") and "QueryStage" in plan.getClass().getSimpleName():
        plan = plan.plan()
    kids = plan.children()
    if kids.isEmpty():
        return [plan]
    return [x for i in range(kids.size()) for x in _leaves(kids.apply(i))]
