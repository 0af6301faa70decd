"""Every registered query that has SQL, against DuckDB on the smallest tables."""

import inspect
import math
import os

import duckdb
import pytest

from trialspark.operators import rf, tuning
from trialspark.plans import event_queries, flagship, more_queries, table_queries

DIR = "/root/testdata/sf0.001"
ORACLES = {**flagship.ORACLES, **event_queries.ORACLES, **table_queries.ORACLES, **more_queries.ORACLES}
QUERIES = {**flagship.QUERIES, **event_queries.QUERIES, **table_queries.QUERIES, **more_queries.QUERIES}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    return f"{float(v):.8g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    names = sorted(df.columns)
    mine = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    told = duck.execute(f"SELECT {', '.join(f'\"{c}\"' for c in names)} FROM ({ORACLES[name]})").fetchall()
    assert mine == sorted(tuple(plain(v) for v in r) for r in told)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0


def test_resampling_queries_use_all_models_and_the_operators_own_numbers(spark, monkeypatch):
    asked = {}
    for module, name in ((tuning, "selected_models"), (tuning, "model_p"), (rf, "resampled_null")):
        def told(*args, _real=getattr(module, name), _name=name, **options):
            call = inspect.signature(_real).bind(*args, **options)
            call.apply_defaults()
            asked[_name] = call.arguments
            return _real(*args, **options)

        monkeypatch.setattr(module, name, told)
    QUERIES["m13_model_p"](spark, DIR)
    QUERIES["v9_resampled_null"](spark, DIR)
    assert asked["selected_models"]["models"] == tuning.MODELS
    assert (asked["model_p"]["reps"], asked["model_p"]["blocks"], asked["resampled_null"]["reps"]) == (1000, 20, 100)
