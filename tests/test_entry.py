"""Driver contract: entry smoke run and every registered query against its DuckDB oracle."""

import pytest

import __spark_entry__ as entry
from oracle_check import duck, rows_of

from conftest import SF_SMALL
from tremor.plans.registry import ORACLES, QUERIES


def test_entry_smoke(spark):
    df = entry.entry(spark)
    out = df.collect()
    assert len(out) > 0
    assert df.columns[:2] == ["event", "post_count"]


WITHOUT_SQL = {"segment_words"}  # compared with a plain version in test_lexicon.py


def test_every_query_has_an_oracle():
    assert set(QUERIES) - WITHOUT_SQL == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF_SMALL)
    spdf = df.toPandas()
    ddf = con.execute(entry.oracle_sql()[name]).df()
    sc, sr = rows_of(spdf)
    dc, dr = rows_of(ddf)
    assert sc == dc
    assert len(sr) == len(dr)
    assert sr == dr and len(sr) > 0


WRITES_OR_TRAINS = {"write_results", "split_files", "post_results_csv", "catalogue_listing", "cleaned_cache",
                    "stream_cache", "read_posts", "train_classifier", "write_table", "label_json", "read_two_roots", "ingest_errors", "epoch_batches"}


def test_no_cross_join_or_row_python_in_any_query(spark):
    """Every registered query plans without cartesian / nested-loop joins and
    without row-at-a-time Python UDFs."""
    from conftest import plan_of
    bad = {}
    for name, fn in QUERIES.items():
        if name in WRITES_OR_TRAINS:
            continue
        plan = plan_of(fn(spark, SF_SMALL))
        found = [op for op in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython") if op in plan]
        if found:
            bad[name] = found
    assert bad == {}


def test_entry_without_the_optional_subpackage(tmp_path):
    """The rest imports and registers its queries when the subpackage and the pipeline are gone."""
    import os
    import shutil
    import subprocess
    import sys
    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{root}/tremor", tmp_path / "tremor", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q)"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True,
                         env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert out.stdout.split() == [str(len(QUERIES)), "False"]
