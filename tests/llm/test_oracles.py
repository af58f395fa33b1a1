"""The queries of the operators against their SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from pitlake.llm import registry


def canonical(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    one = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted(str([one(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = entry.queries()[name](spark, sf)
    want = con.execute(registry.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(found.columns) == sorted(names)
    assert canonical(map(tuple, found.collect()), found.columns) == canonical(want.fetchall(), names)


def test_every_operator_has_a_query():
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in registry.QUERIES) == 1
