"""Each query against its SQL in DuckDB on the smallest tables."""

import duckdb
import pyarrow.parquet as pq
import pytest

from veil import queries as core

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{data}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query_equals_sql(spark, con, data, name, tmp_path):
    out = core.queries()[name](spark, data).toArrow()
    pq.write_table(out, tmp_path / "out.parquet")
    con.execute(f"create or replace table ours as select * from '{tmp_path}/out.parquet'")
    con.execute(f"create or replace table theirs as {core.oracle_sql()[name]}")
    ours, theirs = (sorted(r[:2] for r in con.execute(f"describe {t}").fetchall()) for t in ("ours", "theirs"))
    assert ours == theirs
    cols = ", ".join(f'"{c}"' for c, _ in ours)
    for a, b in (("ours", "theirs"), ("theirs", "ours")):
        assert con.execute(f"select count(*) from (select {cols} from {a} except all select {cols} from {b})").fetchall() == [(0,)]
