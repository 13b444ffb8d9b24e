"""Forecasts measured on made-up users, and the forecast as it is shown against its parts."""

import math
import os
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from spendlake.operators import forecast, personas

TABLES = "/root/testdata/sf0.001"


def test_accuracy(spark):
    report = personas.backtest(personas.personas(spark, 200)).first()
    assert report.cases == 200 and report.broke_cases > 50
    assert report.accuracy_3d >= 0.678 and report.mae_days <= 4.9 and report.detection_agreement >= 0.85


def test_users_follow_from_seed_and_number(spark):
    few = {tuple(r) for r in personas.personas(spark, 3).collect()}
    more = {tuple(r) for r in personas.personas(spark, 6).repartition(4).where("user_id < 3").collect()}
    assert few == more
    rows = [r for r in few if r[0] == 1]
    assert {r[3] for r in rows} <= {*range(-60, 0), *range(1, 46)} and len({(r[1], r[2]) for r in rows}) == 1
    assert all(r[5] % 100 == 0 for r in rows) and sum(r[4] == "payroll" for r in rows) in (3, 4)
    assert personas.personas(spark, 0).count() == 0


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="the test tables are not here")
def test_answer_is_the_simulation_of_its_parts(spark):
    from spendlake.plans import digests

    money, days, items = digests.built(spark, TABLES)
    today = F.lit(date(2024, 1, 28))
    pools = {r.user_id: [(p.weekday, p.paise) for p in r.pool] for r in forecast.pools(days).collect()}
    flows = {}
    for r in forecast.scheduled(items, today).collect():
        flows.setdefault(r.user_id, []).append((r.ahead, r.paise))
    start = {r.user_id: r for r in money.collect()}
    shown = digests.QUERIES["forecast_answer"](spark, TABLES).collect()
    assert {r.user_id for r in shown} == set(start) and {r.status for r in shown} == {"OK", "NEEDS_BALANCE"}
    for r in shown:
        if r.status == "NEEDS_BALANCE":
            assert start[r.user_id].start_paise is None and r.broke_p50 is None and r.prob_broke is None
            continue
        want = forecast.simulate_one(start[r.user_id].start_paise, pools.get(r.user_id, []), flows.get(r.user_id, []), 0, 45, forecast.RUNS, 0)
        assert (r.prob_broke, r.end_p50_paise, r.days_left_p50) == (want["prob_broke"], want["end_p50_paise"], want["days_p50"])


def plain_run(start, pool, flow, first_weekday, horizon, runs, seed):
    """Run by run: the day on which money is gone, by a plain loop over the same draws."""
    spent = forecast.draws(pool, [(first_weekday + d) % 7 for d in range(horizon)], runs, seed).tolist()
    due = dict(flow)
    days, ends = [], []
    for run in range(runs):
        left, gone = start, None
        for d in range(horizon):
            left += due.get(d + 1, 0) - spent[d][run]
            gone = d + 1 if gone is None and left <= 0 else gone
        days.append(gone)
        ends.append(left)
    ordered = sorted(d or math.inf for d in days)
    at = lambda q: None if ordered[math.floor(q * (runs - 1))] == math.inf else ordered[math.floor(q * (runs - 1))]
    return at(0.2), at(0.5), at(0.8), round(sum(d is not None for d in days) / runs, 4)


def test_simulation_against_plain_loop():
    pool = [(d % 7, 1_000 + d * d % 31 * 70) for d in range(40) if d % 7 != 3]
    for start, flow in ((30_000, []), (30_000, [(4, 40_000), (9, -20_000)]), (0, []), (10**7, [(45, -(10**7))])):
        got = forecast.simulate_one(start, pool, flow, 2, 45, 300, 5)
        assert (got["days_p20"], got["days_p50"], got["days_p80"], got["prob_broke"]) == plain_run(start, pool, flow, 2, 45, 300, 5)
    assert datetime(2024, 1, 28).weekday() == 6
