"""Registered queries agree with their SQL on the smallest sample."""

import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
# One query per family; tests/oracle_check.py runs all of them at any scale.
NAMES = ["clean_bars", "qc_structural", "qc_reconcile", "rsi", "obv_z", "ema_macd",
         "vix_regime", "sector_loo", "break_mask", "rank_tercile", "asof_pe", "filing_match",
         "statement_pivot", "time_folds", "auc_ap_brier", "calibration", "live_overlay",
         "list_companies", "risk_tier"]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    got = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert got.startswith("ok"), got


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() >= 1


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
