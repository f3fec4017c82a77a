"""Every query with an oracle gives DuckDB's rows on the smallest tables; the others give rows of a stable schema."""

import os
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from tessera.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i].lower())
    plain = lambda x: round(x, 6) if isinstance(x, float) else x
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in got.collect()]
    if name not in registry.ORACLES:
        assert len({f.name for f in got.schema}) == len(got.schema)
        return
    want = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(map(str.lower, names)) == sorted(map(str.lower, got.columns))
    assert _rows(got.columns, rows) == _rows(names, want.fetchall())
