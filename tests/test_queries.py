"""Every registered query that SQL can express gives the SQL's rows."""

import os

import duckdb
import pytest

from accord.jobs import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(str(v[k]) for k in order) for v in values), key=repr)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the given tables")
@pytest.mark.parametrize("name", registry.QUERIES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got = registry.QUERIES[name](spark, DIR)
    cursor = con.execute(registry.SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, cursor.fetchall())
