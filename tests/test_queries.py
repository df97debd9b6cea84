"""Every query of the engine against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from tidewright.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _key(row):
    return tuple((x is None, str(x) if isinstance(x, (list, dict)) else (0 if x is None else x)) for x in row)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf_dir, db, name):
    df = catalog.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    found = sorted((tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=_key)
    if name not in catalog.oracle_sql():
        assert columns
        return
    told = db.execute(f"SELECT {', '.join(f'\"{c}\"' for c in columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    told = sorted((tuple(r) for r in told), key=_key)
    assert len(found) == len(told)
    for a, b in zip(found, told, strict=True):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isnan(x) and math.isnan(y)) for x, y in zip(a, b, strict=True)), (a, b)


def test_every_oracle_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


@pytest.mark.parametrize("name, table, columns", [("holidays_intraday", "events", "event_id, ts, 'a' AS event_type, 1.5::DOUBLE AS value"), ("holidays", "orders", "event_id AS o_orderkey, ts AS o_orderdate")], ids=["events", "orders"])
def test_holidays_at_odd_times(spark, tmp_path, name, table, columns):
    """Fractions of a second around midnight, times beyond both ends of the list and between its parts, and none."""
    at = "1600-02-03 00:00:00.000001|1969-12-31 23:59:59.5|1992-06-01 10:00:00|1994-01-01 00:00:00|2010-05-05 00:00:00.25|2024-01-01 00:00:00|2024-01-01 00:00:00.000001|2024-01-14 00:00:00.4|2024-01-14 23:59:59.999999|2024-01-15 00:00:00.999999|2025-12-25 00:00:00.5|2026-12-26 00:00:00|2044-01-25 23:59:59.9|9999-12-31 23:59:59.999999"
    con = duckdb.connect()
    con.execute(f"CREATE TABLE x AS SELECT row_number() OVER () AS event_id, ts FROM (SELECT unnest([{', '.join(f"TIMESTAMP '{t}'" for t in at.split('|'))}, NULL]) AS ts)")
    con.execute(f"COPY (SELECT {columns} FROM x) TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    df = catalog.queries()[name](spark, str(tmp_path))
    told = con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert sorted((tuple(r) for r in df.collect()), key=_key) == sorted(told, key=_key)
    # spelled out, so that no common slip of the two hides: the first microsecond after midnight begins another day
    got = {r[0]: tuple(r)[1:] for r in df.select(df.columns[0], "is_holiday", "days_to_next_holiday", "days_from_last_holiday", "days_to_nearest_holiday").collect()}
    assert got[6] == (1, 0, 0, 0) and got[7] == (1, 13, 0, 0) and got[8] == (0, 0, 13, 0)
    assert got[3] == (0, 577, None, 577) and got[12] == (0, None, 366, 366) and got[15] == (None,) * 4
