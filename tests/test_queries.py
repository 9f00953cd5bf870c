"""Every query outside the corpus subpackage against its SQL, at the smallest scale."""

import os

import duckdb
import pytest

from lanternq import catalogue

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{FOLDER}/{t}.parquet"
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return db


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)

    def plain(x):
        return round(x, 6) if isinstance(x, float) else x if x is None or isinstance(x, (int, str, bool)) else str(x)

    return sorted((tuple(plain(v[i]) for i in order) for v in values), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, sql, name):
    got = catalogue.queries()[name](spark, FOLDER)
    found = sql.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, found.fetchall())
