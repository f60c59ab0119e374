"""Registered queries against the same SQL in DuckDB on the smallest tables."""

import datetime as dt
import os

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as driver  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables not present")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
KEYS = [
    "uni_3_interval_join",
    "bor_3_summary",
    "dq_7_warnings",
    "fac_momentum_5d",
    "sig_1_percent_rank",
    "val_2_benjamini_hochberg",
    "fam_3_family_verdict",
    "reg_2_last_write_wins",
    "txt_3_holding_period",
    "ide_3_batch_checks",
    "evt_9_ledger_errors",
    "chn_1_verify_chains",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for name in TABLES.split():
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return c


def plain(value):
    if isinstance(value, float):
        return round(value, 9) + 0.0
    return value.isoformat() if isinstance(value, (dt.date, dt.datetime)) else value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_sql(spark, con, key):
    df = driver.queries()[key](spark, FOLDER)
    cursor = con.execute(driver.oracle_sql()[key])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert table(df.columns, df.collect()) == table(columns, cursor.fetchall())


def test_flagship_runs(spark):
    out = driver.entry(spark)
    assert out.columns == ["date", "n_long", "n_short", "raw_return"]
    assert out.count() > 0


def test_every_query_has_sql():
    assert set(driver.queries()) - set(driver.oracle_sql()) <= {k for k in driver.queries() if k.startswith("op") or k == "pipeline"}
