"""The queries of the llm subpackage that have SQL, on the smallest tables."""

import glob
import math
import os

import pytest

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(FOLDER), reason="no test tables")

from seriesmill.llm.queries import QUERIES, SQL  # noqa: E402


def plain(rows, columns):
    one = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else str(v)[:10] if hasattr(v, "year") else v
    return sorted((tuple(one(r[c]) for c in columns) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = plain([r.asDict() for r in df.collect()], columns)
    if name not in SQL:
        return
    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    result = c.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert got == plain([dict(zip(names, r, strict=True)) for r in result.fetchall()], columns)
