"""Whole summaries of a user's week and day, lists of alerts and commitments, settings and the outbox."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlake.functions.money import format_inr
from spendlake.functions.times import ist_day, ist_week
from spendlake.operators.spending import is_spend

TOP = 3


def merchant_label(named: DataFrame) -> Column:
    """The merchant's name, else the payee's string, else `unknown`."""
    return F.coalesce("merchant_name", "merchant_raw", F.lit("unknown"))


def summaries(spends: DataFrame, label: Column, cash: DataFrame, period) -> DataFrame:
    """user_id, period, total_paise, n, categories, top and cash_paise of each user and period with spending or cash spending.

    categories (category, paise) by falling sum, at most one for each category; top (name, paise, n) the TOP
    names by falling sum, ties by name. Sums are aggregated by name and category before anything is ranked.
    """
    rows = spends.select("user_id", period(F.col("txn_time")).alias("period"), "category", label.alias("name"), "amount_paise")
    keys = ["user_id", "period"]
    by_category = rows.groupBy(*keys, "category").agg(F.sum("amount_paise").alias("paise"), F.count(F.lit(1)).alias("n"))
    falling = lambda name: F.struct((-F.col("paise")).alias("order"), F.col(name).alias("name"), F.col("n").alias("n"))
    listed = lambda c: F.transform(F.array_sort(c), lambda x: F.struct(x["name"].alias("name"), (-x["order"]).alias("paise"), x["n"].alias("n")))
    whole = by_category.groupBy(*keys).agg(F.sum("paise").alias("total_paise"), F.sum("n").alias("n"), listed(F.collect_list(falling("category"))).alias("categories"))
    by_name = rows.groupBy(*keys, "name").agg(F.sum("amount_paise").alias("paise"), F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("paise"), "name"))
    top = by_name.withColumn("place", place).where(F.col("place") <= TOP).groupBy(*keys).agg(listed(F.collect_list(falling("name"))).alias("top"))
    spent = cash.where("entry_type = 'CASH_SPEND'").groupBy("user_id", period(F.col("occurred_at")).alias("period")).agg(F.sum("amount_paise").alias("cash_paise"))
    out = whole.join(top, keys).join(spent, keys, "full")
    none = F.array().cast("array<struct<name: string, paise: bigint, n: bigint>>")
    return out.select(*keys, *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total_paise", "n", "cash_paise")), *(F.coalesce(c, none).alias(c) for c in ("categories", "top")))


def weeks(txns: DataFrame, merchants: DataFrame, cash: DataFrame) -> DataFrame:
    """The week of each user: dates (IST, Monday to Sunday), spending, count, categories, TOP merchants, cash spending, and the spending of the week before.

    txns: user_id, merchant_id, merchant_raw and payments' columns; merchants: id, name; cash: the ledger.
    """
    named = txns.where(is_spend()).join(merchants.select(F.col("id").alias("merchant_id"), F.col("name").alias("merchant_name")), "merchant_id", "left")
    out = summaries(named, merchant_label(named), cash, ist_week)
    before = Window.partitionBy("user_id").orderBy(F.unix_date("period")).rangeBetween(-7, -7)
    return out.withColumn("previous_paise", F.coalesce(F.sum("total_paise").over(before), F.lit(0))).withColumnRenamed("period", "week").withColumn("week_end", F.date_add("week", 6))


def days(txns: DataFrame, cash: DataFrame) -> DataFrame:
    """The day of each user: spending (of any direction), count, TOP payees and cash spending, and the cash in hand now."""
    from spendlake.operators.cash import balances

    out = summaries(txns.where(is_spend(False)), F.coalesce("merchant_raw", F.lit("unknown")), cash, ist_day).drop("categories").withColumnRenamed("period", "day")
    return out.join(balances(cash).select("user_id", "in_hand_paise"), "user_id", "left").na.fill(0, ["in_hand_paise"])


def recent_payments(txns: DataFrame, now, days_back: int = 7, limit: int = 20, merchant: str | None = None, category: str | None = None) -> DataFrame:
    """Each user's newest payments of the last days, without account numbers; merchant is a payee's exact string."""
    rows = txns.where((F.col("txn_time") >= now - F.expr(f"INTERVAL {days_back} DAYS")) & (F.col("txn_time") <= now))
    for column, value in (("merchant_raw", merchant), ("category", category)):
        rows = rows if value is None else rows.where(F.col(column) == value)
    newest = Window.partitionBy("user_id").orderBy(F.desc("txn_time"), F.desc("id"))
    shown = ["user_id", "id", "amount_paise", "direction", "kind", "status", F.coalesce("merchant_raw", F.lit("unknown")).alias("merchant"), "category", ist_day(F.col("txn_time")).alias("day")]
    return rows.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= limit).select(*shown, "place")


def recent_alerts(alerts: DataFrame, now, days_back: int = 7, limit: int = 10) -> DataFrame:
    """Each user's newest alerts sent in the last days."""
    newest = Window.partitionBy("user_id").orderBy(F.desc("sent_at"), "id")
    rows = alerts.where((F.col("status") == "SENT") & (F.col("sent_at") >= now - F.expr(f"INTERVAL {days_back} DAYS")))
    return rows.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= limit)


def commitments(memories: DataFrame) -> DataFrame:
    """Each user's active commitments, the one due first in front, those without a date last, then by age."""
    order = Window.partitionBy("user_id").orderBy(F.col("due_at").asc_nulls_last(), "created_at", "id")
    return memories.where("kind = 'COMMITMENT' AND status = 'ACTIVE'").withColumn("place", F.row_number().over(order))


def refund_cases(cases: DataFrame, limit: int = 50) -> DataFrame:
    """Facts of each user's newest refund cases: amount also as text, missing compensation as 0, and whether a complaint is drafted."""
    newest = Window.partitionBy("user_id").orderBy(F.desc("opened_at"), F.desc("id"))
    owed = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("compensation_owed_paise", "compensation_received_paise")]
    facts = ["user_id", "id", "case_type", "state", "amount_paise", format_inr(F.col("amount_paise")).alias("amount_text"), "reference_id", "opened_at", "deadline_at", "reversed_at", *owed, (F.coalesce("complaint_draft", F.lit("")) != "").alias("has_draft")]
    return cases.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= limit).select(*facts, "place")


def latest_entry(ledger: DataFrame, since) -> DataFrame:
    """The newest cash entry of each user since a time."""
    return ledger.where(F.col("occurred_at") >= since).groupBy("user_id").agg(F.max_by("id", F.struct("occurred_at", "id")).alias("id"))


def replace_budgets(stored: DataFrame, new: DataFrame, users: DataFrame) -> DataFrame:
    """stored budgets with all those of `users` (user_id) replaced by the new ones; a user without new ones has none. Of a category given twice the larger limit stands."""
    own = new.join(users.select("user_id").distinct(), "user_id", "left_semi").groupBy("user_id", "category").agg(F.max("monthly_limit_paise").alias("monthly_limit_paise"))
    return stored.join(users.select("user_id").distinct(), "user_id", "left_anti").select(own.columns).unionByName(own)


def settings(users: DataFrame, budgets: DataFrame) -> DataFrame:
    """users with budgets (category, monthly_limit_paise) by category, as an array that may be empty."""
    own = budgets.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("category", "monthly_limit_paise"))).alias("budgets"))
    none = F.array().cast("array<struct<category: string, monthly_limit_paise: bigint>>")
    return users.join(own, "user_id", "left").withColumn("budgets", F.coalesce("budgets", none))


# What a cash entry typed into the form must keep to.
MAX_AGE_DAYS, MAX_SKEW_MINUTES, MAX_ENTRY_PAISE, MAX_NOTE = 30, 5, 10_000_000, 100
TYPED = ("CASH_SPEND", "CASH_RECEIVED", "ATM_WITHDRAWAL")


def entry_fault(now) -> Column:
    """The first rule that a cash entry (entry_type, amount_paise, note, occurred_at) breaks; null if none."""
    return (
        F.when(~F.coalesce(F.col("entry_type").isin(*TYPED), F.lit(False)), "ENTRY_TYPE")
        .when(~F.coalesce((F.col("amount_paise") > 0) & (F.col("amount_paise") <= MAX_ENTRY_PAISE), F.lit(False)), "AMOUNT")
        .when(F.length("note") > MAX_NOTE, "NOTE")
        .when(~F.coalesce((F.col("occurred_at") >= now - F.expr(f"INTERVAL {MAX_AGE_DAYS} DAYS")) & (F.col("occurred_at") <= now + F.expr(f"INTERVAL {MAX_SKEW_MINUTES} MINUTES")), F.lit(False)), "OCCURRED_AT")
    )


BATCH = 100


def pending(outbox: DataFrame, batches: int = 10) -> DataFrame:
    """The rows of each device that its next upload takes: unsent ones by posted_at, in batches of BATCH, at most `batches`. outbox: device, id, posted_at, status, attempts."""
    order = Window.partitionBy("device").orderBy("posted_at", "id")
    rows = outbox.where("status <> 'SENT'").withColumn("place", F.row_number().over(order)).where(F.col("place") <= BATCH * batches)
    return rows.withColumn("batch", F.floor((F.col("place") - 1) / BATCH).cast("int")).drop("place")


def settled(outbox: DataFrame, results: DataFrame) -> DataFrame:
    """outbox after results (id, result) of an upload: SENT if accepted or a duplicate; other rows that were tried count an attempt."""
    done = F.coalesce(F.col("result").isin("ACCEPTED", "DUPLICATE"), F.lit(False))
    rows = outbox.join(results.select("id", "result").dropDuplicates(["id"]), "id", "left")
    out = rows.withColumn("status", F.when(done, "SENT").otherwise(F.col("status"))).withColumn("attempts", F.col("attempts") + (F.col("result").isNotNull() & ~done).cast("int"))
    return out.select(outbox.columns)
