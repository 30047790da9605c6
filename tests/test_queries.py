"""Every query of the library against its SQL, on the smallest tables."""

import duckdb
import pytest

from quarryloom.plans.registry import FLAGSHIP, ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(value):
    if isinstance(value, float):
        return round(value, 5) + 0.0
    return str(value) if hasattr(value, "isoformat") else value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted(map(str, ([plain(r[c]) for c in columns] for r in got.collect())))
    if name in ORACLE_SQL:
        want = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall()
        assert rows == sorted(map(str, ([plain(v) for v in r] for r in want)))
    else:
        assert rows


def test_flagship_is_registered():
    assert FLAGSHIP in QUERIES
