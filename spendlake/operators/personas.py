"""Made-up users with a known future, to measure forecasts by."""

from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlake.operators import forecast

HISTORY = 60
ROW = "user_id long, today date, start_paise long, ahead int, key string, amount_paise long, category string"


def one(user: int, seed: int, first: date, horizon: int) -> pd.DataFrame:
    """Payments of a user from HISTORY days before to `horizon` days after today, which is within 28 days of `first`.

    Fixed values: salary 25,000 to 90,000 rupees on one of the first five days of a month, rent of 0.2 to 0.4 of
    it two days later, a subscription of 199, 499 or 649 rupees on the 15th, and daily spending that is gamma
    distributed (shape 2) with a mean of 0.012 to 0.03 salaries, 1.6 times that at weekends, in whole rupees.
    The start is 0.1 to 0.9 salaries.
    """
    rng = np.random.default_rng([seed, user])
    salary = 100 * int(rng.integers(25_000, 90_000))
    rent_share, spend_share, start_share = rng.uniform([0.2, 0.012, 0.1], [0.4, 0.03, 0.9])
    subscription, payday = int(rng.choice([19_900, 49_900, 64_900])), int(rng.integers(1, 6))
    today = pd.Timestamp(first) + pd.Timedelta(days=int(rng.integers(0, 28)))
    days = pd.DataFrame({"ahead": [*range(-HISTORY, 0), *range(1, horizon + 1)]})
    at = today + pd.to_timedelta(days["ahead"], unit="D")
    mean = salary * spend_share * np.where(at.dt.weekday >= 5, 1.6, 1.0)
    spent = rng.gamma(2.0, mean / 2) // 100 * 100
    dated = [("payroll", salary, "INCOME", payday), ("rent", -(int(salary * rent_share) // 100 * 100), "RENT", payday + 2), ("subscription", -subscription, "SUBSCRIPTIONS", 15)]
    parts = [days[at.dt.day == on].assign(key=key, amount_paise=paise, category=category) for key, paise, category, on in dated]
    parts.append(days.assign(key="shop" + (days["ahead"] % 9).astype(str), amount_paise=-spent.astype("int64"), category="SHOPPING"))
    rows = pd.concat(parts)
    rows = rows[rows["amount_paise"] != 0]
    return rows.assign(user_id=user, today=today.date(), start_paise=int(salary * start_share))


def personas(spark: SparkSession, n: int, seed: int = 7, first: date = date(2026, 10, 1), horizon: int = forecast.HORIZON) -> DataFrame:
    """A row for each payment of n users (ROW); each user depends on the seed and its number alone."""
    names = [c.split()[0] for c in ROW.split(", ")]

    def run(parts):
        for part in parts:
            for user in part["id"]:
                yield one(int(user), seed, first, horizon)[names]

    return spark.range(n).mapInPandas(run, ROW)


def backtest(rows: DataFrame, horizon: int = forecast.HORIZON, runs: int = forecast.RUNS) -> DataFrame:
    """The report of forecasts from each user's history against the future as it came; items that repeat are found in the history."""
    cases = rows.select("user_id", "today", "start_paise").distinct()
    past = rows.where("ahead < 0").select("user_id", F.concat_ws("-", "user_id", "ahead", "key").alias("id"), "key", "amount_paise", F.date_add("today", F.col("ahead")).alias("day"), "category")
    items, explained = forecast.recurring(past)
    spends = past.where("amount_paise < 0").join(explained, ["user_id", "id"], "left_anti").groupBy("user_id", "day").agg((-F.sum("amount_paise")).alias("paise"))
    every = cases.select("user_id", F.explode(F.sequence(F.date_sub("today", HISTORY), F.date_sub("today", 1))).alias("day"))
    days = every.join(spends, ["user_id", "day"], "left").select("user_id", "day", F.weekday("day").alias("weekday"), F.create_map(F.lit("SHOPPING"), F.coalesce("paise", F.lit(0)).cast("long")).alias("by_category"))
    due = forecast.scheduled(items.join(cases.select("user_id", "today"), "user_id"), F.col("today"), horizon)
    flow = due.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ahead", "paise"))).alias("flow"))
    ready = cases.join(forecast.pools(days), "user_id", "left").join(flow, "user_id", "left")
    predicted = forecast.forecast(ready, horizon, runs).select(F.col("user_id").alias("case_id"), F.datediff("broke_p50", "today").alias("predicted_days"))
    future = rows.where("ahead > 0").groupBy(F.col("user_id").alias("case_id"), "start_paise", "ahead").agg(F.sum("amount_paise").alias("paise"))
    actual = cases.select(F.col("user_id").alias("case_id")).join(forecast.first_broke(future), "case_id", "left")
    return forecast.backtest(predicted, actual, horizon)
