"""The opN queries against their DuckDB twins on the smallest tables."""

from pathlib import Path

import pytest

from bytequarry.llm.queries import ORACLES, queries

SF = Path("/root/testdata/sf0.001")


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, name):
    duckdb = pytest.importorskip("duckdb")
    if not SF.exists():
        pytest.skip("no tables here")
    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = queries()[name](spark, str(SF))
    cur = con.execute(ORACLES[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    want = sorted(str([dict(zip(cols, r, strict=True))[c] for c in sorted(cols)]) for r in cur.fetchall())
    assert sorted(str([r[c] for c in sorted(cols)]) for r in df.collect()) == want
