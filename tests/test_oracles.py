"""Every query with SQL gives the same rows as DuckDB does, on the supplied small tables."""

import math
import os

import pytest

from verbatix.plans.catalogue import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def canonical(rows):
    show = lambda v: "null" if v is None or v != v else f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(show(v) for v in r) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    duckdb = pytest.importorskip("duckdb")
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    assert not any(isinstance(v, float) and math.isinf(v) for r in got for v in r)
    if name in ORACLES:
        db = duckdb.connect()
        for t in ("documents", "pages", "benchmark", "conversations", "events"):
            db.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
        rel = db.sql(ORACLES[name])
        assert sorted(rel.columns) == cols
        assert canonical(got) == canonical(db.sql(f"SELECT {', '.join(cols)} FROM ({ORACLES[name]})").fetchall())
