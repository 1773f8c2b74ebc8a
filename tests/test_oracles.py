"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from plumbline.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_says_what_its_sql_says(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = [tuple(r) for r in df.select(*columns).collect()]
    told = db.execute("select " + ", ".join(f'"{c}"' for c in columns) + f" from ({registry.ORACLES[name]}) q").fetchall()
    assert _sorted(found) == _sorted(told)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_model_queries_give_one_finite_prediction_for_each_item(spark, name):
    rows = registry.QUERIES[name](spark, SF).collect()
    assert len(rows) == len({r["item"] for r in rows}) == 100
    assert all(abs(r["p"]) < 100 for r in rows)
