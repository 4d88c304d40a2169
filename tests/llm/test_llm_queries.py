import os

import duckdb
import pytest

from kelpline.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    cur = con.execute(queries.ORACLE[name])
    cols = [d[0] for d in cur.description]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == sorted(map(tuple, cur.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_other_queries_give_distinct_rows(spark, name):
    rows = [str(r) for r in queries.QUERIES[name](spark, "/root/testdata/sf0.001").collect()]
    assert len(rows) == len(set(rows))
