"""Every registered query with an oracle gives the oracle's rows on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

from strataweave.plans.registry import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(x):
    if x is None or isinstance(x, float) and x != x:
        return None
    if isinstance(x, str | bool):
        return str(x)
    if hasattr(x, "__len__"):
        return sorted(map(str, x))
    return round(float(x), 5) if not hasattr(x, "year") else str(x)


def rows(frame, columns):
    frame = frame[columns].astype(object)
    return sorted(str([plain(x) for x in r]) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLES:
        want = duck.execute(ORACLES[name]).df()
        columns = sorted(want.columns)
        assert columns == sorted(got.columns)
        assert rows(got, columns) == rows(want, columns)
    else:
        assert len(got)
