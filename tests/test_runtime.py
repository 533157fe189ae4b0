"""Lineage, shipping and the entry points."""

import importlib

from fieldloom import runtime


def test_materialize_and_discard(spark):
    df = runtime.materialize(spark.range(10), "numbers")
    assert df.count() == 10 and "ExistingRDD" not in df._jdf.queryExecution().toString()
    runtime.discard(df)
    again = runtime.materialize(spark.range(3))
    assert again.count() == 3
    runtime.discard(spark.range(1))  # nothing is behind it


def test_tables_lie_in_the_shared_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(runtime, "shared_dir", lambda s: f"file://{tmp_path}/shared")
    runtime.materialize(spark.range(4), "x").count()
    assert list((tmp_path / "shared" / "fieldloom").iterdir())
    runtime.clear(spark)
    assert not (tmp_path / "shared" / "fieldloom").exists()


def test_ship_twice(spark):
    runtime.ship(spark)
    n = len(runtime._SHIPPED)
    runtime.ship(spark)
    assert len(runtime._SHIPPED) == n


def test_entry_points(spark):
    e = importlib.import_module("__spark_entry__")
    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and {"eval_summary", "p2_found"} <= set(q)
    df = e.entry(spark)
    assert df.columns == ["engine", "scope", "field_name", "count", "cer", "wer", "exact_match_rate"]
