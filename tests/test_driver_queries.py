import duckdb
import pytest
from weftline.plans import driver_queries as D

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(D.queries()))
def test_same_as_sql(spark, db, name):
    df = D.queries()[name](spark, SF)
    cols = sorted(df.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    want = db.sql(D.oracle_sql()[name])
    assert sorted(want.columns) == cols
    a = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key)
    b = sorted(want.project(", ".join(f'"{c}"' for c in cols)).fetchall(), key=key)
    assert len(a) == len(b) and a
    for x, y in zip(a, b, strict=True):
        assert x == y


def test_entry_module_imports():
    import __spark_entry__ as e

    assert set(D.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
