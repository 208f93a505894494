import math
import os
from datetime import datetime
from decimal import Decimal

import pytest

import __spark_entry__ as entry
from ledgerline.plans import report

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
QUERIES, SQL = entry.queries(), entry.oracle_sql()
WHOLE = [n for n in QUERIES if n in SQL and n[0] in "pq"] + [
    "v01_requests_dedup", "v02_window_readings", "v03_request_repositories", "v04_request_costs", "v09_limit_hits_events", "v15_lockout_intervals", "v22_window_peak", "v24_window_reading_pairs", "v26_unattributed_usage",
    "v33_interruptions_by_plan", "v34_burn_rate", "v35_api_list_price", "v40_api_list_price_by_machine", "ref_s04_parsed_lines", "ref_s04_requests", "ref_s08_status_readings", "ref_s09_rate_limit_windows", "ref_a19_verify_totals", "ref_h09_months",
]


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float, Decimal)):
        return None if isinstance(v, float) and math.isnan(v) else round(float(v), 6)
    return v.isoformat() if isinstance(v, datetime) else str(v)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", WHOLE)
def test_same_rows_as_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cur = duck.execute(SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted((tuple(plain(v) for _, v in sorted(zip(names, r, strict=True))) for r in cur.fetchall()), key=str)
    got = sorted((tuple(plain(v) for _, v in sorted(r.asDict().items())) for r in df.collect()), key=str)
    assert got == want


def test_entry_has_rows(spark):
    assert entry.entry(spark).columns == ["raw_line_id"]


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_observed_views_never_reach_prices():
    for view in report.DEPENDS:
        if view not in report.PROJECTED:
            assert not report.reaches(view) & {"prices", "request_costs", "list_price_by_month", "list_price_by_machine"}, view


def test_reports(spark, tmp_path):
    import json

    r = report.Reports(spark, DATA)
    body = json.loads(report.report_json(r, datetime(2024, 1, 20)))
    assert set(body) == {"observed", "projected"} and len(body["observed"]) == 12
    assert r.observed()["by_model"].count() == len(body["observed"]["by_model"])
    at = datetime(2024, 1, 2, 3, 4)
    a, b = report.save(str(tmp_path), "x", "txt", at), report.save(str(tmp_path), "y", "txt", at)
    assert a != b and open(a).read() == "x"
    assert (report.duration(None), report.duration(0), report.duration(90_061)) == ("unknown", "0 s", "1 d 1 h")
