"""Every registered query of the ledger against its DuckDB SQL on the same tables."""

import glob
import math
import os

import duckdb
import pytest

from meterloom.plans.queries import ORACLE_SQL, QUERIES


def rows(names, values):
    order = sorted(range(len(names)), key=lambda k: names[k])
    fixed = lambda x: "nan" if isinstance(x, float) and math.isnan(x) else x
    return [names[k] for k in order], sorted((tuple(fixed(r[k]) for k in order) for r in values), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    mine = rows(got.columns, [tuple(r) for r in got.collect()])
    if name not in ORACLE_SQL:
        assert mine[1]
        return
    db = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    want = db.execute(ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert mine == rows(names, want.fetchall())
