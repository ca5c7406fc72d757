"""Every query of the catalogue against its DuckDB form, over the smallest tables."""

import os

import pandas as pd
import pytest

from genospark.plans.catalog import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")


def plain(x):
    if isinstance(x, float) and x.is_integer():
        return int(x)
    if hasattr(x, "item"):
        return plain(x.item())
    return x


def rows(frame: pd.DataFrame, columns: list[str]) -> list[str]:
    return sorted(str([None if pd.isna(x) else plain(x) for x in r]) for r in frame[columns].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, SMALL).toPandas()
    if name not in ORACLES:
        assert list(found.columns)
        return
    wanted = duck.execute(ORACLES[name]).df()
    columns = sorted(wanted.columns)
    assert sorted(found.columns) == columns
    assert rows(found, columns) == rows(wanted, columns)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
