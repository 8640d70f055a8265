import pytest

import corpus_pipeline as cp
from recfeat.llm.common import as_table, table

from ..conftest import SMALL
from .test_decontaminate import brute_words
from .test_line_dedup import brute as brute_lines
from .test_packing import check as check_packing
from .test_simhash import brute_components, brute_fingerprint

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def hostile(spark):
    base = table(spark, SMALL, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    extra = [(None, None, None, None, None), (900001, None, None, "s", None), (900002, "", "en", "s", 0), (900003, "1234 !!", None, "s", 7)]
    extra += [(900010 + k, " ".join(WORDS) + " Same text", None, "s", 9) for k in range(5)] + [(900020, "Twice", "en", "s", 5)] * 2
    extra += [(900030, "word " * 30_000, "en", "s", 150_000)]
    return base.unionByName(spark.createDataFrame(extra, SCHEMA))


def has_letter(text):
    return any(c.isalpha() for c in text or "")


def heads(rows):
    """The least id of each near-duplicate group."""
    fps = {i: brute_fingerprint(t) for i, t in rows}
    return set(brute_components(sorted(fps), lambda a, b: bin(fps[a] ^ fps[b]).count("1") <= 3).values())


def uncontaminated(spark):
    """A test of texts against all windows of the benchmark, one by one."""
    windows = {}
    for r in table(spark, SMALL, "benchmark").collect():
        w = brute_words(r.text)
        m = min(13, len(w))
        for k in range(len(w) - m + 1) if w else ():
            windows.setdefault(m, set()).add(tuple(w[k : k + m]))

    def clean(text):
        w, hit = brute_words(text), set()
        for m, known in windows.items():
            for k in range(len(w) - m + 1):
                if tuple(w[k : k + m]) in known:
                    hit |= set(range(k, k + m))
        return not (hit and 20 * len(hit) >= len(w))

    return clean


def test_stages_equal_brute_force(spark):
    docs = as_table(hostile(spark), "docs")
    names = [n for n, _ in cp.STAGES]
    assert names == ["language_id", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]

    stage = dict(cp.STAGES)
    one = as_table(stage["language_id"](spark, docs, SMALL), "one")
    want = sorted((r.doc_id, r.text) for r in docs.collect() if has_letter(r.text))
    assert one.columns == list(cp.COLUMNS) and sorted((r.doc_id, r.text) for r in one.collect()) == want

    two = as_table(stage["line_dedup"](spark, one, SMALL), "two")
    kept = brute_lines([(r.doc_id, r.text) for r in one.collect()])
    assert two.columns == list(cp.COLUMNS)
    assert sorted(((r.doc_id, r.text, r.n_chars) for r in two.collect()), key=repr) == sorted(((i, t, len(t)) for i, _, _, t in kept), key=repr)

    three = as_table(stage["simhash_near_dedup"](spark, two, SMALL), "three")
    assert three.columns == list(cp.COLUMNS) and sorted(r.doc_id for r in three.collect()) == sorted(heads([(r.doc_id, r.text) for r in two.collect()]))

    four = as_table(stage["benchmark_decontamination"](spark, three, SMALL), "four")
    clean = uncontaminated(spark)
    assert four.columns == list(cp.COLUMNS) and sorted(r.doc_id for r in four.collect()) == sorted(r.doc_id for r in three.collect() if clean(r.text))

    last = stage["best_fit_packing"](spark, four, SMALL).collect()
    check_packing(last, [(r.doc_id, r.text) for r in four.collect()], 2048)


def test_run_applies_all_stages(spark):
    """The whole run over the given documents, against the rules applied one after the other."""
    docs = [(r.doc_id, r.text) for r in table(spark, SMALL, "documents").collect() if has_letter(r.text)]
    lined = [(i, t) for i, _, _, t in brute_lines(docs)]
    first, clean = heads(lined), uncontaminated(spark)
    want = [(i, t) for i, t in lined if i in first and clean(t)]
    check_packing(cp.run(spark, SMALL).collect(), want, 2048)
    assert cp.ORACLE_SQL is None


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_stages_take_an_empty_table(spark, name):
    empty = table(spark, SMALL, "documents").select("doc_id", "text", "lang", "source", "n_chars").limit(0)
    assert dict(cp.STAGES)[name](spark, empty, SMALL).count() == 0
