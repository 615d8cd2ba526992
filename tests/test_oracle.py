"""Every core query against its SQL on the small tables."""

import math
from pathlib import Path

import duckdb
import pytest

from lodestone.plans.registry import all_queries, all_sql

NAMES = sorted(n for n in all_queries() if n in all_sql())


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return repr(v)


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, data, con, name):
    df = all_queries()[name](spark, data)
    cols = sorted(df.columns)
    got = sorted(tuple(_norm(r[c]) for c in cols) for r in df.collect())
    r = con.execute(all_sql()[name])
    at = {d[0]: i for i, d in enumerate(r.description)}
    assert sorted(at) == cols
    want = sorted(tuple(_norm(x[at[c]]) for c in cols) for x in r.fetchall())
    assert got == want
