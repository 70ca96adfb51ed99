"""A sample of the queries against their SQL; all of them are compared by the driver."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from barflow import queries as own

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = [
    "ind_snapshot", "ind_rsi", "feat_atr_rsi", "labels", "policy_outcomes", "det_anomalies", "q_issues", "q_report_symbol", "split_purge_embargo", "eval_classification", "bt_losses", "mon_drift", "model_promotions", "dlq_records", "derived_ids", "mon_outcomes",
    "srv_champion", "contract_reasons", "sink_latest", "ops_reconcile", "ops_alert_hold", "stream_rollup",
]


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return v.isoformat() if hasattr(v, "isoformat") else float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = own.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = duck.execute(own.ORACLES[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert got == want


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(own.ORACLES) <= set(own.QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
