import math
import os

import pytest

import __spark_entry__ as entry
from cellweave.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@needs_tables
def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_core_queries_are_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) == set(ORACLES)


def plain(rows, columns):
    def value(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v, 6) + 0.0
        return v

    return sorted((tuple(value(r[c]) for c in columns) for r in rows), key=str)


@needs_tables
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    want = [dict(zip(names, r, strict=True)) for r in want.fetchall()]
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    assert columns == sorted(names)
    got = plain([r.asDict() for r in df.collect()], columns)
    want = plain(want, columns)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        for a, b in zip(g, w, strict=True):
            assert a == b or isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 1e-6 * max(1, abs(b)), (name, g, w)
