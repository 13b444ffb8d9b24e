"""Triggers over payments as window functions, in event time."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendlake.functions.text import is_person_vpa
from spendlake.functions.times import iso_week_key, ist_month
from spendlake.operators.spending import is_spend

FREQUENCY = 3
THRESHOLDS = (80, 100)


def frequent(txns: DataFrame) -> DataFrame:
    """Payments that are at least the third at the same payee within seven days, persons aside."""
    rows = txns.where(is_spend(False) & F.col("merchant_raw").isNotNull() & ~is_person_vpa(F.col("merchant_raw")))
    count = F.expr("count(1) OVER (PARTITION BY user_id, merchant_raw ORDER BY txn_time RANGE BETWEEN INTERVAL '6 23:59:59.999999' DAY TO SECOND PRECEDING AND CURRENT ROW)")
    key = F.concat(F.lit("freq:"), F.col("merchant_raw"), F.lit(":"), iso_week_key(F.col("txn_time")))
    return rows.withColumn("n", count).where(F.col("n") >= FREQUENCY).select("id", "user_id", "merchant_raw", "category", "n", key.alias("dedupe_key"))


def budget_crossings(txns: DataFrame, budgets: DataFrame) -> DataFrame:
    """Payments that take a category's spending of the IST month across 80 or 100 percent of its limit; the highest share crossed."""
    rows = txns.where(is_spend(False)).withColumn("month", ist_month(F.col("txn_time"))).join(budgets, ["user_id", "category"])
    so_far = Window.partitionBy("user_id", "category", "month").orderBy("txn_time").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("after", F.sum("amount_paise").over(so_far)).withColumn("before", F.col("after") - F.col("amount_paise"))
    limit = F.col("monthly_limit_paise")
    crossed = [F.when((F.col("before") * 100 < t * limit) & (t * limit <= F.col("after") * 100), t) for t in THRESHOLDS]
    return rows.withColumn("crossed", F.greatest(*crossed)).where("crossed IS NOT NULL").select("id", "user_id", "category", "month", F.col("after").alias("spent_paise"), "crossed")


def moved_earlier(forecasts: DataFrame, days: int = 3) -> DataFrame:
    """Forecasts whose broke date lies at least `days` before the one of the user's forecast before."""
    order = Window.partitionBy("user_id").orderBy("computed_at", "id")
    rows = forecasts.withColumn("previous", F.lag("broke_p50").over(order))
    return rows.withColumn("days_earlier", F.datediff("previous", "broke_p50")).where(F.col("days_earlier") >= days).select("id", "user_id", "broke_p50", "previous", "days_earlier")


def commitment_progress(txns: DataFrame, commitments: DataFrame) -> DataFrame:
    """For each commitment (user_id, target, due_at): the user's debits at payees that contain the target."""
    hit = F.contains(F.lower("merchant_raw"), F.lower("target")) & (F.col("direction") == "DEBIT")
    return commitments.join(txns, "user_id", "left").groupBy("user_id", "target", "due_at").agg(F.count_if(hit).alias("n"))
