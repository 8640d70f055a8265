import numpy as np
import pytest

from recfeat.llm import language_id as li
from recfeat.llm.common import table
from recfeat.llm.queries import op10_language_id

from ..conftest import SMALL, rows


def test_gradients_by_differences():
    net = li.Network.fresh(["a", "b", "c"], 3)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    rng = np.random.default_rng(1)
    strips, labels, real = rng.integers(1, 255, (5, 4)).astype(np.uint8), np.array([0, 1, 2, 0]), rng.random((5, 4)) < 0.8
    _, g = net.gradients(strips, real, labels)
    for k, w in net.weights.items():
        for at in list(map(tuple, np.argwhere(g[k] != 0)))[:6]:
            keep = w[at]
            losses = []
            for step in (1e-4, -1e-4):
                w[at] = keep + step
                losses.append(net.gradients(strips, real, labels)[0])
            w[at] = keep
            assert g[k][at] == pytest.approx((losses[0] - losses[1]) / 2e-4, rel=2e-2, abs=1e-6)


def test_pooling_reads_every_position():
    net = li.Network.fresh(["a", "b"], 4, seed=3)
    texts = [b"x" * n for n in (1, 63, 64, 65, 300)] + [b"", bytes(range(1, 200)) * 40]
    got = net.documents(texts, width=3)
    for text, p in zip(texts, got):
        strips, _ = li._strips([text])
        flat = net.positions(strips).transpose(1, 0, 2).reshape(-1, 2)[: len(text)] if text else np.zeros((1, 2))
        assert p == pytest.approx(flat.mean(axis=0), abs=1e-5)
        spans = net.runs(text)
        assert sum(b - a for a, b, _ in spans) == len(text)


def plain_pass(net, text):
    """Every position's distribution by the gates' formulas, one byte and one unit at a time, with numbers only."""
    soft = lambda v: v / (1 + abs(v))
    gate = lambda v: 0.5 + 0.5 * soft(v)
    w, n, out = {k: v.astype(float).tolist() for k, v in net.weights.items()}, net.weights["uf"].shape[0], []
    for at in range(0, len(text), li.STRIP):
        strip = text[at : at + li.STRIP].ljust(li.STRIP, b"\0")
        states = {}
        for d in "fb":
            h, seen = [0.0] * n, {}
            for t in range(li.STRIP) if d == "f" else range(li.STRIP - 1, -1, -1):
                x = [w[f"x{d}"][strip[t]][j] + w[f"b{d}"][j] for j in range(3 * n)]
                u = [sum(h[i] * w[f"u{d}"][i][j] for i in range(n)) for j in range(3 * n)]
                z, r = [gate(x[j] + u[j]) for j in range(n)], [gate(x[n + j] + u[n + j]) for j in range(n)]
                c = [soft(x[2 * n + j] + r[j] * u[2 * n + j]) for j in range(n)]
                h = [h[j] + z[j] * (c[j] - h[j]) for j in range(n)]
                seen[t] = h
            states[d] = seen
        for t in range(min(li.STRIP, len(text) - at)):
            both = states["f"][t] + states["b"][t]
            e = [2.718281828459045 ** (w["c"][k] + sum(b * o[k] for b, o in zip(both, w["o"]))) for k in range(len(net.languages))]
            out.append([v / sum(e) for v in e])
    return out


def test_labels_and_pooling_equal_a_plain_forward_pass(spark):
    net = li.Network.fresh(["a", "b", "c"], 3, seed=5)
    texts = ["Some words, é.", "x" * 64, "y z" * 50, "日本語 text"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in li.predict(df, net, with_runs=True).collect():
        each = plain_pass(net, texts[r.doc_id].encode())
        pooled = [sum(p[k] for p in each) / len(each) for k in range(3)]
        assert r.lang_pred == "abc"[pooled.index(max(pooled))] and r.score == pytest.approx(max(pooled), abs=1e-5)
        assert [x for run in r.runs for x in [run.lang] * (run.end - run.start)] == ["abc"[p.index(max(p))] for p in each]


def test_equally_likely_languages_go_to_the_first(spark):
    net = li.Network.fresh(["b", "a"])
    net.weights["o"][:], net.weights["c"][:] = 0, 0
    net.languages = sorted(net.languages)
    row = li.predict(spark.createDataFrame([(1, "text")], "doc_id long, text string"), net).first()
    assert (row.lang_pred, row.score) == ("a", pytest.approx(0.5))


def test_samples_come_from_the_whole_text(spark, monkeypatch):
    got = []
    monkeypatch.setattr(li.Network, "fit", staticmethod(lambda texts, labels, *how: got.extend(zip(texts, labels))))
    text = "a" * 300 + "b" * 300 + "c" * 300 + "d" * 300
    df = spark.createDataFrame([(1, text, "x"), (2, "short", "y"), (3, None, "x")], "doc_id long, text string, lang string")
    li.train(df, sample_chars=40, sample_places=4)
    assert sorted(got) == [(b"a" * 10 + b"b" * 10 + b"c" * 10 + b"d" * 10, "x"), (b"short", "y")]


def test_held_out_accuracy(spark):
    got = op10_language_id(spark, "/root/testdata/sf0.01").join(table(spark, "/root/testdata/sf0.01", "documents"), "doc_id").where("held_out and text is not null and lang is not null").toPandas()
    assert len(got) > 200 and (got.lang_pred == got.lang).mean() > 0.95
    assert ((got.score > 0) & (got.score <= 1)).all()


def test_undetermined_texts_and_columns(spark):
    net = li.Network.fresh(["a", "b"])
    df = spark.createDataFrame([(1, None, 1), (1, None, 1), (2, "", 1), (3, "12 ² ...", 1), (None, "é", 1), (4, "x" * 300_000, 1)], "doc_id long, text string, score int")
    got = li.annotate(df, net)
    assert got.columns == ["doc_id", "text", "score", "lang_pred", "_score"]
    by = rows(got.select("doc_id", "lang_pred", "_score"))
    assert [r for r in by if r[1] == "und"] == [(1, "und", 0.0), (1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0)] and len(by) == 6
    assert {r.lang_pred for r in li.predict(df, li.Network([], {})).collect()} == {"und"}
    assert li.predict(df.limit(0), net).count() == 0


def test_training_without_rows_or_with_one_language(spark):
    df = table(spark, SMALL, "documents")
    assert li.train(df.limit(0)).languages == []
    one = li.train(df.where("lang = 'en'"), epochs=1)
    assert one.languages == ["en"] and li.predict(df, one).where("lang_pred = 'en'").count() > 0
