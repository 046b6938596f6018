"""Every registered query against its DuckDB oracle on the smallest tables."""

from __future__ import annotations

import pytest

duckdb = pytest.importorskip("duckdb")

from helpdesk_lake.plans.catalog import load_all  # noqa: E402
from helpdesk_lake.plans.compare import TABLES, digest  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"

REGISTRY = load_all()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(n for n, s in REGISTRY.items() if s.oracle))
def test_query_matches_oracle(spark, con, name):
    spec = REGISTRY[name]
    df = spec.build(spark, SF_SMALL)
    s_cols, s_rows = df.columns, [tuple(r) for r in df.collect()]
    cur = con.execute(spec.oracle)
    o_cols, o_rows = [d[0] for d in cur.description], cur.fetchall()
    assert sorted(s_cols) == sorted(o_cols)
    assert len(s_rows) == len(o_rows)
    assert digest(s_cols, s_rows)[0] == digest(o_cols, o_rows)[0]
