import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from tremor.session import get_session
    s = get_session("local[4]", shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s


def rows(df, *cols):
    """Collected rows as plain tuples, sorted."""
    cols = cols or df.columns
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
