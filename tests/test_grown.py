"""Queries on more or odder rows than the test tables have, against their SQL in DuckDB."""

import duckdb

from annulus.operators import keyspace
from annulus.plans import loads
from annulus.sources import clusters as state


def same_rows(spark, folder, name, **tables):
    """The rows of a query on tables made by SQL, once they equal its own SQL's."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{folder}/{table}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {table} AS FROM '{folder}/{table}.parquet'")
    want = con.execute(loads.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = sorted(map(tuple, loads.queries()[name](spark, str(folder)).select(*[f"`{c}`" for c in columns]).collect()), key=str)
    assert got == sorted(want.fetchall(), key=str)
    return got


def test_whole_stretch(spark, tmp_path):
    """A stretch with more keys, bytes and dead records than a page may have is whole; a page of it keeps its limits."""
    nation = "SELECT i AS n_nationkey, 'NATION_' || i AS n_name FROM range(25) t(i)"
    near = f"('0x' || substr(md5('user:' || i), 1, 15))::BIGINT BETWEEN {loads.FROM - (1 << 50)} AND {loads.FROM + (1 << 55)}"
    events = f"SELECT i AS event_id, TIMESTAMP '2024-01-02 03:04:05' AS ts, i AS user_id, CASE WHEN i % 3 = 0 THEN 'error' ELSE 'purchase' END AS event_type, '{{}}' AS props FROM range(1200000) t(i) WHERE {near}"
    found = same_rows(spark, tmp_path, "one_stretch_page", nation=nation, events=events)
    assert len(found) > 10_000
    records = loads.keyspace.records(spark, str(tmp_path))
    page = keyspace.one_stretch(records, state.ranges(spark, str(tmp_path)), loads.NODE, loads.FROM, 5, 100_000)
    assert sorted(map(tuple, page.collect())) == sorted(sorted(found, key=lambda r: r[1])[:5])


def test_mixes_are_parsed_once(spark, tmp_path):
    """Orders without a customer, or with a remainder below 0, pick no mix; texts are parsed after they are counted, not order by order."""
    orders = "SELECT i AS o_orderkey, CASE WHEN i % 10 < 8 THEN i - 50 END AS o_custkey FROM range(500) t(i)"
    assert sum(r[-1] for r in same_rows(spark, tmp_path, "mix_parse", orders=orders)) == 370
    plan = loads.mix_parse(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    grouped = plan.split("Aggregate [")[1]
    by, below = grouped.split("], [")[0], grouped.partition("\n")[2]
    assert "lambda" in plan and "lambda" not in by + below
