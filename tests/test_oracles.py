"""Every bound query with SQL, against DuckDB on the smallest tables."""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")

from patchloom.plans import bindings  # noqa: E402

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def shown(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(bindings.ORACLES))
def test_query_equals_sql(spark, con, name):
    df = bindings.QUERIES[name](spark, DATA)
    want = con.sql(bindings.ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    got = sorted(tuple(shown(r[c]) for c in cols) for r in df.collect())
    at = [want.columns.index(c) for c in cols]
    assert got == sorted(tuple(shown(r[i]) for i in at) for r in want.fetchall())


def test_entry_runs(spark):
    import __spark_entry__

    assert set(bindings.ORACLES) <= set(bindings.QUERIES)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def test_entry_without_the_training_data_part(spark, monkeypatch):
    import importlib.util

    import __spark_entry__

    find = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if "llm" in name or name == "corpus_pipeline" else find(name, *a))
    assert set(__spark_entry__.queries()) == set(bindings.QUERIES) and set(__spark_entry__.oracle_sql()) == set(bindings.ORACLES)
