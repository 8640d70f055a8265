import subprocess
import sys

import pytest

from recfeat.llm import queries

from ..conftest import ROOT, SMALL
from ..test_oracle import compare


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    compare(spark, queries.queries()[name], queries.oracle_sql()[name], SMALL)


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_one_row_for_each_input_row(spark, name):
    got = queries.queries()[name](spark, SMALL)
    read = lambda t: spark.read.parquet(f"{SMALL}/{t}.parquet")
    if name == "op9_best_fit_packing":
        assert got.select("doc_id").distinct().count() == read("documents").select("doc_id").distinct().count()
    else:
        if name.startswith("op12_"):
            return
        want = read("pages") if name.startswith("op1_") else read("embeddings").where("vec_id % 50 = 0") if name.startswith("op7_") else read("documents")
        assert got.count() == want.count()


def test_entry_module_lists_all(spark):
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 14)} == {x.split("_")[0] for x in names if x.startswith("op")} and "pipeline" in names
    assert set(entry.oracle_sql()) <= names


def test_a_broken_import_is_not_hidden(tmp_path):
    """The guard of the entry module is for missing folders only."""
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_library\n")
    code = f"import sys; sys.path[:0] = [{str(tmp_path)!r}, {str(ROOT)!r}]\nimport __spark_entry__"
    run = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=tmp_path)
    assert run.returncode != 0 and "no_such_library" in run.stderr
