"""Every registered query of the engine against its DuckDB twin on the smallest tables."""

from pathlib import Path

import pytest

from bytequarry.plans.queries import ORACLES, QUERIES

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not SF.exists():
        pytest.skip("no tables here")
    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def test_every_query_has_a_twin():
    assert QUERIES.keys() == ORACLES.keys()


def same(v):
    return v if v is None or isinstance(v, str | bool) else round(float(v), 5) if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, duck, name):
    df = QUERIES[name](spark, str(SF))
    cur = duck.execute(ORACLES[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    want = sorted(repr([same(dict(zip(cols, r, strict=True))[c]) for c in sorted(cols)]) for r in cur.fetchall())
    assert sorted(repr([same(r[c]) for c in sorted(cols)]) for r in df.collect()) == want
