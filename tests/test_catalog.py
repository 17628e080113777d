"""Every registered query against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from mnemospark.plans import catalog


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def _rows(frame):
    columns = sorted(frame.columns)
    values = frame[columns].astype(object).where(frame[columns].notna(), None)
    clean = lambda v: None if v is None else round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return columns, sorted((tuple(map(clean, r)) for r in values.values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_matches_sql(spark, duck, sf_dir, name):
    mine = catalog.queries()[name](spark, sf_dir).toPandas()
    assert _rows(mine) == _rows(duck.execute(catalog.oracle_sql()[name]).df())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["scene_id", "score"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
