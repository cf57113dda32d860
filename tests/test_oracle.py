"""Every registered query with an oracle gives what DuckDB gives, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from meterlake.operators import reports
from meterlake.plans.queries import ORACLE_SQL, QUERIES, Tables
from meterlake.schemas import PRICE_KEY

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(v):
    if type(v).__name__ == "Decimal":
        return float(v)
    return None if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_duckdb(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    found = duck.execute(ORACLE_SQL[name])
    cols = [c[0] for c in found.description]
    assert sorted(cols) == sorted(df.columns)
    order = sorted(range(len(cols)), key=cols.__getitem__)
    want = sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=repr)
    got = sorted((tuple(plain(x) for x in r) for r in df.select(*sorted(cols)).collect()), key=repr)
    assert got == want


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
def test_whole_tables_are_covered(spark):
    t = Tables(spark, str(DATA))
    n = t.usage.count()
    assert QUERIES["A22_record_cost_all"](spark, str(DATA)).count() == n > QUERIES["A22_record_cost"](spark, str(DATA)).count()
    for zone in ("la", "kolkata"):
        assert QUERIES[f"G2_local_hourly_{zone}_all"](spark, str(DATA)).agg({"request_count": "sum"}).first()[0] == n
    places = sorted(r["place"] for r in QUERIES["G6_ordered_findings_all"](spark, str(DATA)).collect())
    assert places == list(range(1, t.quotes.select(*PRICE_KEY).distinct().count() + 1))


def test_numbering_over_many_ranges(spark):
    rows = spark.range(1000, 0, -1, 7).selectExpr("nullif(id % 300, 0) AS a", "id AS b")
    got = reports.numbered(rows, [F.col("a").asc_nulls_first(), F.col("b").asc()]).collect()
    want = sorted(((r["a"], r["b"]) for r in rows.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert [(r["a"], r["b"]) for r in sorted(got, key=lambda r: r["place"])] == want and {r["place"] for r in got} == set(range(1, 1001))
