"""Summaries, lists and pages of payments. Every operator keeps user_id as a key."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlake.functions.categories import is_essential
from spendlake.functions.times import ist_day, ist_month, ist_week


def is_spend(debits_only: bool = True) -> Column:
    """Successful spending. Daily summaries and budgets look at all directions."""
    spend = (F.col("kind") == "SPEND") & (F.col("status") == "SUCCESS")
    return spend & (F.col("direction") == "DEBIT") if debits_only else spend


def label(name: str = "merchant_raw") -> Column:
    return F.coalesce(F.col(name), F.lit("unknown"))


def spend_total(txns: DataFrame, start, end) -> DataFrame:
    """Spending of each user in [start, end); users without spending have 0."""
    inside = is_spend() & (F.col("txn_time") >= start) & (F.col("txn_time") < end)
    return txns.groupBy("user_id").agg(F.coalesce(F.sum(F.when(inside, F.col("amount_paise"))), F.lit(0)).cast("long").alias("total_paise"))


def weekly_summary(txns: DataFrame) -> DataFrame:
    """Spending of each user and IST week (Monday to Sunday), beside the week before."""
    weeks = txns.where(is_spend()).groupBy("user_id", ist_week(F.col("txn_time")).alias("week")).agg(F.sum("amount_paise").alias("total_paise"), F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("user_id").orderBy("week")
    before = F.when(F.lag("week").over(order) == F.date_sub("week", 7), F.lag("total_paise").over(order))
    return weeks.withColumn("previous_paise", F.coalesce(before, F.lit(0)).cast("long"))


def weekly_by(txns: DataFrame, key: str) -> DataFrame:
    return txns.where(is_spend()).groupBy("user_id", ist_week(F.col("txn_time")).alias("week"), label(key).alias(key)).agg(F.sum("amount_paise").alias("total_paise"), F.count(F.lit(1)).alias("n"))


def top_merchants(txns: DataFrame, n: int = 3) -> DataFrame:
    """The n payees of each user and week with the largest sums; ties by name."""
    order = Window.partitionBy("user_id", "week").orderBy(F.desc("total_paise"), "merchant_raw")
    return weekly_by(txns, "merchant_raw").withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def daily_summary(txns: DataFrame) -> DataFrame:
    return txns.where(is_spend(False)).groupBy("user_id", ist_day(F.col("txn_time")).alias("day")).agg(F.sum("amount_paise").alias("total_paise"), F.count(F.lit(1)).alias("n"))


def budget_usage(txns: DataFrame, budgets: DataFrame) -> DataFrame:
    """Each budget and IST month with spending in it: what is spent, and the whole percent of the limit."""
    spent = txns.where(is_spend(False)).groupBy("user_id", "category", ist_month(F.col("txn_time")).alias("month")).agg(F.sum("amount_paise").alias("spent_paise"))
    used = budgets.join(spent, ["user_id", "category"], "left")
    percent = F.expr("coalesce(spent_paise, 0) * 100 div monthly_limit_paise")
    return used.select("user_id", "category", "month", "monthly_limit_paise", F.coalesce("spent_paise", F.lit(0)).cast("long").alias("spent_paise"), percent.alias("percent_used"))


def top_categories(txns: DataFrame, n: int = 5) -> DataFrame:
    """The n categories of each user with the largest sums, and the daily average over the days with payments."""
    days = txns.where(is_spend()).groupBy("user_id").agg(F.countDistinct(ist_day(F.col("txn_time"))).alias("days"))
    totals = txns.where(is_spend()).groupBy("user_id", "category").agg(F.sum("amount_paise").alias("total_paise"))
    order = Window.partitionBy("user_id").orderBy(F.desc("total_paise"), "category")
    return totals.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).join(days, "user_id").select("user_id", "category", "place", "total_paise", F.expr("total_paise div greatest(1, days)").alias("daily_avg_paise"))


def essential_split(txns: DataFrame) -> DataFrame:
    return txns.where(is_spend()).groupBy("user_id", "category", is_essential(F.col("category")).alias("essential")).agg(F.sum("amount_paise").alias("total_paise"), F.count(F.lit(1)).alias("n"))


def recent(txns: DataFrame, n: int = 20, category: str | None = None) -> DataFrame:
    """The newest n payments of each user."""
    rows = txns if category is None else txns.where(F.col("category") == category)
    order = Window.partitionBy("user_id").orderBy(F.desc("txn_time"), F.desc("id"))
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def page(txns: DataFrame, limit: int, before: tuple | None = None) -> DataFrame:
    """A page of payments, newest first: the limit and one row more, after the row at `before` (txn_time, id)."""
    rows = txns
    if before:
        at, last = before
        rows = rows.where((F.col("txn_time") < at) | ((F.col("txn_time") == at) & (F.col("id") < last)))
    return rows.orderBy(F.desc("txn_time"), F.desc("id")).limit(limit + 1)


def user_pages(txns: DataFrame, limit: int, cursors: DataFrame | None = None) -> DataFrame:
    """A page of each user's payments, newest first: the limit and one row more, after the user's cursor (user_id, cursor) if there is one. A cursor that can't be read starts anew."""
    rows = txns
    if cursors is not None:
        ends = cursors.select("user_id", decoded(F.col("cursor")).alias("__end"))
        after = (F.col("txn_time") < F.col("__end.txn_time")) | ((F.col("txn_time") == F.col("__end.txn_time")) & (F.col("id") < F.col("__end.id")))
        rows = txns.join(ends, "user_id", "left").where(F.col("__end.id").isNull() | after).drop("__end")
    order = Window.partitionBy("user_id").orderBy(F.desc("txn_time"), F.desc("id"))
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit + 1)


TIME_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def cursor(txn_time: Column, row_id: Column) -> Column:
    """URL-safe base64 of where a page ended: time in microseconds and id."""
    return F.translate(F.base64(F.encode(F.concat_ws("|", F.date_format(txn_time, TIME_FORMAT), row_id), "UTF-8")), "+/", "-_")


def decoded(text: Column) -> Column:
    """Struct of txn_time and id that a cursor stands for; null if it is none."""
    plain = F.decode(F.try_to_binary(F.translate(text, "-_", "+/"), F.lit("base64")), "UTF-8")
    at = F.to_timestamp_ntz(F.substring_index(plain, "|", 1), F.lit(TIME_FORMAT))
    known = plain.rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d\.\d{6}\|.")
    return F.when(known, F.struct(at.alias("txn_time"), F.substr(plain, F.instr(plain, "|") + 1).alias("id")))


def clean_payload(txns: DataFrame, sources: DataFrame, merchants: DataFrame) -> DataFrame:
    """Payments with their merchant's name and the sorted ids of the events they come from."""
    ids = sources.groupBy(F.col("transaction_id").alias("id")).agg(F.sort_array(F.collect_list("raw_event_id")).alias("source_ids"))
    names = merchants.select(F.col("id").alias("merchant_id"), F.col("name").alias("merchant_name"))
    return txns.join(ids, "id", "left").join(names, "merchant_id", "left")


def latest(rows: DataFrame, key: str, order: str, tiebreak: str) -> DataFrame:
    """The latest row of each key, by one aggregation."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(order, tiebreak)).alias("row")).select(key, *(F.col(f"row.{c}").alias(c) for c in rest))
