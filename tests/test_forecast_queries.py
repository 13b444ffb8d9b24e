"""The forecast queries on planted events, against a plain simulation."""

from datetime import datetime, timedelta

import pytest

from spendlake.operators import forecast
from spendlake.plans import analysis

EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
AT = lambda day: datetime(2024, 1, 1, 6) + timedelta(days=day)


@pytest.fixture
def folder(spark, tmp_path):
    """User 1 pays a large sum each week and 49 rupees a day; user 2 spends more each day of the week."""
    rows = [(AT(7 * i), 1, 3_000.0, 2) for i in range(3)] + [(AT(i), 1, 49.0, 5) for i in range(30)] + [(AT(i), 2, 10.0 + i * i % 29, 5) for i in range(30)]
    events = [(n, at, user, "purchase", value, f'{{"k": {k}}}') for n, (at, user, value, k) in enumerate(rows)]
    spark.createDataFrame(events, EVENT).write.parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path)


def test_recurring_payments_count_once(spark, folder):
    got = {r.user_id: r for r in analysis.QUERIES["broke_forecast"](spark, folder).collect()}
    pools = {1: [(i % 7, 4_900) for i in range(28)], 2: [(i % 7, 1_000 + i * i % 29 * 100) for i in range(28)]}
    flows = {1: [(d, -1_002) for d in range(7, 46, 7)], 2: []}
    for user, pool in pools.items():
        want = forecast.simulate_one(analysis.START, pool, flows[user], 1, 45, 2_000, 0)
        assert [(getattr(got[user], f"broke_{q}") - analysis.TODAY).days for q in ("p20", "p50", "p80")] == [want[f"days_{q}"] for q in ("p20", "p50", "p80")]
        assert (got[user].prob_broke, got[user].end_p50_paise) == (want["prob_broke"], want["end_p50_paise"])
    assert (got[1].broke_p50 - analysis.TODAY).days == 8


def test_backtest_finds_recurring_payments(spark, folder):
    """User 1: day 8 by the forecast, with the weekly payment as a flow, and day 9 as it came."""
    report = analysis.QUERIES["forecast_backtest"](spark, folder).first()
    assert (report.cases, report.broke_cases, report.mae_days) == (2, 1, 1.0)
