"""Every query that has SQL gives what DuckDB gives, on the smallest tables; others give rows."""

import math
import re
from pathlib import Path

import duckdb
import pytest

from skysift.plans import registry

#: Queries that find too little in tables this small are run on larger ones.
SPARSE = {"stream_detect", "flush_partial"}
SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def plain(x):
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (int, float)):
        return "nan" if math.isnan(x) else round(float(x), 9) + 0.0
    return str(x)


@pytest.fixture(scope="module")
def duck():
    def connect(folder):
        con = duckdb.connect()
        con.execute("set temp_directory = ''")  # nothing is spilled to the working folder
        for p in Path(folder).glob("*.parquet"):
            con.execute(f"create view {p.stem} as select * from '{p}'")
        return con

    return {folder: connect(folder) for folder in (SF, LARGER)}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    folder = LARGER if name in SPARSE else SF
    df = registry.QUERIES[name](spark, folder)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert got or name not in SPARSE
    if name in registry.SQL:
        cur = duck[folder].execute(registry.SQL[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        assert got == sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=repr)
    else:
        assert got


#: Products with a fixed number of rows that constants name, and with a row of totals.
CONSTANT = {"mass_grid", "project_detectors"}


def test_no_nested_loops(spark):
    """Joins on ranges and times stay equi-joins; what a nested loop meets is one row of totals, or constants."""
    for name in sorted(registry.QUERIES.keys() - CONSTANT):
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        for line in plan.splitlines():
            if re.search(r"Join \w+, \(.*[<>]", line):
                assert " = " in line or "<=>" in line or "strategy=broadcast" in line, (name, line)  # a row of totals
        assert "CartesianProduct" not in plan, name
