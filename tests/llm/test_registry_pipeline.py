"""The registered queries: names, the SQL ones against DuckDB, and the pipeline's stages on small tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def test_names():
    import __spark_entry__
    from patchloom.llm import registry

    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in registry.QUERIES} == {f"op{i}" for i in range(1, 14)} and "pipeline" in names


def test_sql(spark):
    from patchloom.llm import registry

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    for name, sql in registry.ORACLES.items():
        df, want = registry.QUERIES[name](spark, SF), con.sql(sql)
        cols = sorted(want.columns)
        assert sorted(df.columns) == cols
        at = [want.columns.index(c) for c in cols]
        assert sorted(tuple(map(str, (r[c] for c in cols))) for r in df.collect()) == sorted(tuple(map(str, (r[i] for i in at))) for r in want.fetchall())


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"file://{tmp_path}/{i}")
        new = spark.read.parquet(f"file://{tmp_path}/{i}")
        if i < 4:
            assert new.columns == columns, name
        if i < 3:
            assert new.count() <= n and new.count() > 0.5 * n
            n = new.count()
        docs = new
    assert docs.where("rank = 0").count() > 0
    ran = corpus_pipeline.run(spark, SF)
    assert sorted(ran.columns) == sorted(docs.columns) and ran.count() == docs.count()
