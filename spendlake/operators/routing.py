"""What follows from an event: parser or cash parser, cash ledger, and tasks for triggers. Ids follow from ids, so work done again changes nothing."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlake.functions.ids import derived, derived_hex
from spendlake.functions.times import iso_week_key
from spendlake.operators.cash import parse_cash_line
from spendlake.operators.triggers import budget_crossings, frequent

# Kinds of raw events by what reads them, and hours until a task is too late.
BANK_TYPES, CASH_TEXT_TYPES = ("RAW_NOTIFICATION", "RAW_SMS"), ("MANUAL_TEXT", "WIDGET_TAP")
DEADLINE_HOURS, REVIEW_DEADLINE_HOURS = 2, 6
REVIEW_WEEKDAY, REVIEW_MINUTE = 6, 11 * 60


def routed(events: DataFrame) -> DataFrame:
    """events (raw_type, …) with route: PARSER, CASH or SKIPPED; unknown and null kinds are skipped."""
    route = F.when(F.col("raw_type").isin(*BANK_TYPES), "PARSER").when(F.col("raw_type").isin(*CASH_TEXT_TYPES), "CASH").otherwise("SKIPPED")
    return events.withColumn("route", route)


def cash_events(events: DataFrame) -> DataFrame:
    """Cash events (event_id, user_id, causation_id, occurred_at, entry_type, amount_paise, category, note) of the texts that are routed to cash and hold exactly one amount."""
    rows = routed(events).where("route = 'CASH'").withColumn("e", parse_cash_line(F.coalesce("text", F.lit("")))).where("e IS NOT NULL")
    return rows.select(derived(F.lit("cash"), F.col("event_id")).alias("event_id"), "user_id", F.col("event_id").alias("causation_id"), F.col("posted_at").alias("occurred_at"), "e.entry_type", "e.amount_paise", "e.category", "e.note")


def ledger(cash: DataFrame, stored: DataFrame) -> DataFrame:
    """stored ledger and a row for each cash event that it lacks; an event that comes twice has one row."""
    rows = cash.select(derived_hex("c_", F.lit("cash"), F.col("event_id")).alias("id"), "user_id", "entry_type", "amount_paise", "category", "note", "occurred_at").dropDuplicates(["id"])
    return stored.unionByName(rows.join(stored.select("id"), "id", "left_anti").select(stored.columns))


def changelog_events(changelog: DataFrame) -> DataFrame:
    """What is published of each version of a payment: an id by payment and version, the same however often it is published."""
    return changelog.withColumn("event_id", derived(F.lit("clean"), F.col("payment").cast("string"), F.col("version").cast("string"))).dropDuplicates(["event_id"])


def atm_events(payments: DataFrame) -> DataFrame:
    """A cash event for each successful withdrawal at a machine; its id follows from the payment, so merges repeat it."""
    rows = payments.where("kind = 'ATM_WITHDRAWAL' AND status = 'SUCCESS'")
    return rows.select(derived(F.lit("atm"), F.col("id")).alias("event_id"), "user_id", F.lit("ATM_WITHDRAWAL").alias("entry_type"), "amount_paise", F.col("txn_time").alias("occurred_at"), F.col("id").alias("related_transaction_id")).dropDuplicates(["event_id"])


def tasks(txns: DataFrame, budgets: DataFrame, moved: DataFrame, now) -> DataFrame:
    """The tasks that payments and forecasts give rise to, one for each user and dedupe_key: task_id, user_id, trigger, goal, dedupe_key, priority and deadline.

    moved: id, user_id, broke_p50, days_earlier of forecasts whose broke date moved earlier.
    """
    crossed = budget_crossings(txns, budgets)
    month = F.date_format("month", "yyyy-MM")
    kinds = [
        crossed.select("user_id", F.lit("BUDGET").alias("trigger"), F.concat("category", F.lit(" budget "), "crossed", F.lit("% used")).alias("goal"), F.concat_ws(":", F.lit("budget"), "category", month, F.col("crossed").cast("string")).alias("dedupe_key"), F.lit("HIGH").alias("priority")),
        frequent(txns).select("user_id", F.lit("FREQUENCY").alias("trigger"), F.concat(F.lit("Frequent spending at "), "merchant_raw").alias("goal"), "dedupe_key", F.lit("NORMAL").alias("priority")),
        moved.select("user_id", F.lit("BROKE_DATE_MOVED").alias("trigger"), F.concat(F.lit("Broke date moved "), "days_earlier", F.lit(" days earlier, to around "), F.col("broke_p50").cast("string")).alias("goal"), F.concat(F.lit("broke:"), F.col("broke_p50").cast("string")).alias("dedupe_key"), F.lit("HIGH").alias("priority")),
    ]
    rows = kinds[0].union(kinds[1]).union(kinds[2])
    first = rows.groupBy("user_id", "dedupe_key").agg(F.min(F.struct("trigger", "goal", "priority")).alias("t"))
    return first.select(task_id().alias("task_id"), "user_id", "t.trigger", "t.goal", "dedupe_key", "t.priority", (now + F.expr(f"INTERVAL {DEADLINE_HOURS} HOURS")).alias("deadline"))


def task_id():
    return derived_hex("at_", F.lit("task"), F.col("user_id").cast("string"), F.col("dedupe_key"))


def weekly_reviews(users: DataFrame, published: DataFrame, now) -> DataFrame:
    """From eleven on Sundays (IST), a review task for each user who hasn't had the ISO week's. published: user_id, dedupe_key."""
    from spendlake.functions.times import minute_of_day, to_ist

    week = iso_week_key(now)
    open_now = users.where((F.weekday(to_ist(now)) == REVIEW_WEEKDAY) & (minute_of_day(now) >= REVIEW_MINUTE)).select("user_id", F.concat(F.lit("weekly:"), week).alias("dedupe_key")).distinct()
    new = open_now.join(published.select("user_id", "dedupe_key"), ["user_id", "dedupe_key"], "left_anti")
    return new.select(task_id().alias("task_id"), "user_id", F.lit("WEEKLY_REVIEW").alias("trigger"), F.concat(F.lit("Weekly review for week "), week).alias("goal"), "dedupe_key", F.lit("LOW").alias("priority"), (now + F.expr(f"INTERVAL {REVIEW_DEADLINE_HOURS} HOURS")).alias("deadline"))


def undo_latest(ledger_: DataFrame, undoing: DataFrame, now, hours: int = 24) -> DataFrame:
    """ledger without the newest entry of the last hours of each undoing user (user_id)."""
    recent = ledger_.where(F.col("occurred_at") >= now - F.expr(f"INTERVAL {hours} HOURS")).join(undoing.select("user_id").distinct(), "user_id", "left_semi")
    last = recent.groupBy("user_id").agg(F.max_by("id", F.struct("occurred_at", "id")).alias("id")).select("id")
    return ledger_.join(last, "id", "left_anti")
