"""Every query that has SQL against DuckDB on the same files, and the shape of the others."""

import math
import os

import duckdb
import pytest

from spindrift.plans.oracles import ORACLES
from spindrift.plans.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def same(x, y):
    if isinstance(x, float) and isinstance(y, float):
        return math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-5)
    return x == y


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = [c for c in columns if got.schema[c].dataType.simpleString() not in ("double", "float")] + [c for c in columns if got.schema[c].dataType.simpleString() in ("double", "float")]
    a = sorted((tuple(r) for r in got.select(*key).collect()), key=repr)
    b = sorted(want.select(*[f'"{c}"' for c in key]).fetchall(), key=repr)
    assert len(a) == len(b)
    assert all(same(x, y) for r, s in zip(a, b, strict=True) for x, y in zip(r, s, strict=True))


SIZES = {"ensemble_forecast": 960, "spectral_forecast": 960, "ar24_forecast": 960, "spectral_decompose": 10, "spectral_backtest": 40, "fourier_ablation": 30, "online_observation": 3600, "variance_explained": 10}


@pytest.mark.parametrize("name", sorted(SIZES))
def test_size(spark, name):
    assert QUERIES[name](spark, SF).count() == SIZES[name]


def test_streaming_is_the_replay(spark):
    a, b = (QUERIES[n](spark, SF).select("series_id", "t", "y", "predicted").collect() for n in ("streaming_observation", "online_observation"))
    plain = lambda rows: sorted((r.series_id, r.t, r.y, None if r.predicted is None or math.isnan(r.predicted) else r.predicted) for r in rows)
    assert [x[:3] for x in plain(a)] == [x[:3] for x in plain(b)]
    assert all(x[3] == y[3] or math.isclose(x[3], y[3], rel_tol=1e-9) for x, y in zip(plain(a), plain(b), strict=True))
