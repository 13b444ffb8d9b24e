"""The same operators on streams.

A batch of a stream is written under its own number, so that a batch that runs again after a failure replaces
what it had written; what a stream has seen is kept in Spark's state store, under the checkpoint of the query.
"""

from collections.abc import Callable
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spendlake.functions.times import ist_day
from spendlake.operators.parsing import parse
from spendlake.operators.spending import is_spend

IST = timedelta(hours=5, minutes=30)
#: How long after its event time a repeated event is still known.
REPEATS = "48 hours"


def once_each(events: DataFrame, key: str = "event_id", at: str = "posted_at", within: str | None = REPEATS) -> DataFrame:
    """events without repeats of a key: for good, or within a time, after which its state goes."""
    if within is None:
        return events.dropDuplicates([key])
    return events.withWatermark(at, within).dropDuplicatesWithinWatermark([key])


def daily_spending(payments: DataFrame, late: str = "2 days") -> DataFrame:
    """user_id, IST day, total and count of a stream of payments (txn_time timestamp); a day is final once the watermark has passed it."""
    rows = payments.where(is_spend(False)).withWatermark("txn_time", late)
    shifted = F.window(F.col("txn_time"), "1 day", startTime="18 hours 30 minutes")  # an IST day starts at 18:30 UTC
    out = rows.groupBy("user_id", shifted.alias("w")).agg(F.sum("amount_paise").alias("total_paise"), F.count(F.lit(1)).alias("n"))
    return out.select("user_id", ist_day(F.col("w.start").cast("timestamp_ntz")).alias("day"), "total_paise", "n")


def spending_rate(payments: DataFrame, late: str = "1 hour") -> DataFrame:
    """user_id, payee and count over sliding seven-day windows, moved on by a day."""
    rows = payments.where(is_spend(False)).withWatermark("txn_time", late)
    return rows.groupBy("user_id", "merchant_raw", F.window("txn_time", "7 days", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", "merchant_raw", F.col("w.start").alias("since"), F.col("w.end").alias("until"), "n")


def written_once(stream: DataFrame, folder: str, checkpoint: str, change: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Writes change(batch) of each batch to `folder`/batch=N, replacing what an earlier try of the batch left; runs until the input is used up."""

    def write(batch: DataFrame, number: int) -> None:
        change(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def parse_stream(events: DataFrame, rules: DataFrame, good: str, bad: str, checkpoint: str) -> StreamingQuery:
    """Parses a stream of messages: payments to `good`, messages that no tier can read to `bad` (dead letters), one parse for both."""

    def write(batch: DataFrame, number: int) -> None:
        parsed = parse(batch, rules).persist()
        parsed.where("outcome = 'PARSED'").write.mode("overwrite").parquet(f"{good}/batch={number}")
        parsed.where("outcome = 'FAILED'").write.mode("overwrite").parquet(f"{bad}/batch={number}")
        parsed.unpersist()

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_budget(payments: DataFrame, limits: DataFrame, thresholds: tuple[int, ...] = (80, 100), late: str = "7 days") -> DataFrame:
    """user_id, category, month, crossed and spent_paise whenever a payment of the stream takes a budget across a share of its limit.

    limits (static): user_id, category, monthly_limit_paise. What is spent is kept for each user, category and
    month; batches count in order of arrival, late payments too, and within a batch payments count by time. A
    month's state goes when the watermark (the latest payment less `late`) has passed its end; payments that are
    later than that are left out.
    """
    import pandas as pd

    from spendlake.functions.times import ist_month

    timed = payments.withColumn("__at", F.col("txn_time").cast("timestamp")).withWatermark("__at", late)
    rows = timed.where(is_spend(False)).withColumn("month", ist_month(F.col("txn_time").cast("timestamp_ntz"))).join(limits, ["user_id", "category"])
    user = payments.schema["user_id"].dataType.simpleString()

    def step(key, parts, state):
        if state.hasTimedOut:
            state.remove()
            return
        spent = state.get[0] if state.exists else 0
        out = []
        batch = pd.concat(parts).sort_values(["txn_time", "id"])  # what one trigger brings of one budget
        for amount, limit in zip(batch["amount_paise"].tolist(), batch["monthly_limit_paise"].tolist(), strict=True):
            before, spent = spent, spent + amount
            crossed = [t for t in thresholds if before * 100 < t * limit <= spent * 100]
            if crossed:
                out.append((*key, max(crossed), spent))
        state.update((spent,))
        following = (key[2].replace(day=1) + timedelta(days=32)).replace(day=1)
        ends = datetime(following.year, following.month, following.day, tzinfo=UTC) - IST
        state.setTimeoutTimestamp(max(int(ends.timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["user_id", "category", "month", "crossed", "spent_paise"])

    grouped = rows.select("user_id", "category", "month", "id", "txn_time", "__at", "amount_paise", "monthly_limit_paise").groupBy("user_id", "category", "month")
    return grouped.applyInPandasWithState(step, f"user_id {user}, category string, month date, crossed int, spent_paise long", "spent long", "append", "EventTimeTimeout")
