"""The engine's logical tables, bound to the star-schema test tables.

Every amount is in whole paise, every time is UTC wall time without zone. The SQL twins (`*_SQL`) are common
table expressions with the same rows.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlake.functions.categories import CATEGORIES

#: Payee strings as messages spell them, by `k % 12`.
PAYEES = ["SWIGGY.STORES@icici", "zomato@hdfcbank", "Rebel Foods Pvt Ltd", "H&M India", "p12ab34cd@ybl", "The Coffee Co", "AMAZON PAY INDIA", "metro rail", "Big Basket", "12345@ybl", "swigy stores", "Zomatto Limited"]


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str], place: Column) -> Column:
    """values[place], place counting from 0."""
    return F.element_at(F.array(*map(F.lit, values)), place.cast("int") + 1)


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payments_of(table(spark, sf_dir, "events"))


def payments_of(events: DataFrame) -> DataFrame:
    """A payment for each event: sign-ups are income, errors are failed debits."""
    e = events.withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return e.select(
        F.concat(F.lit("t_"), "event_id").alias("id"),
        F.col("event_id").alias("seq"),
        "user_id",
        F.round(F.col("value") * 100).cast("long").alias("amount_paise"),
        F.col("ts").alias("txn_time"),
        F.when(F.col("event_type") == "signup", "CREDIT").otherwise("DEBIT").alias("direction"),
        F.when(F.col("event_type") == "error", "FAILED").otherwise("SUCCESS").alias("status"),
        F.when(F.col("event_type") == "signup", "INCOME").otherwise("SPEND").alias("kind"),
        pick(PAYEES, F.col("k") % 12).alias("merchant_raw"),
        pick(CATEGORIES, F.col("k") % 16).alias("category"),
        (F.col("event_id") % 2).cast("string").alias("account_hint"),
        "k",
    )


TXN_SQL = f"""txn AS (
  SELECT 't_' || event_id AS id, event_id AS seq, user_id, CAST(round(value * 100) AS BIGINT) AS amount_paise, ts AS txn_time,
    CASE event_type WHEN 'signup' THEN 'CREDIT' ELSE 'DEBIT' END AS direction,
    CASE event_type WHEN 'error' THEN 'FAILED' ELSE 'SUCCESS' END AS status,
    CASE event_type WHEN 'signup' THEN 'INCOME' ELSE 'SPEND' END AS kind,
    {sql_list(PAYEES)}[k % 12 + 1] AS merchant_raw, {sql_list(CATEGORIES)}[k % 16 + 1] AS category,
    CAST(event_id % 2 AS VARCHAR) AS account_hint, k
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events))"""


def cash_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every payment, as a cash entry."""
    t = transactions(spark, sf_dir)
    kinds = ["ATM_WITHDRAWAL", "CASH_RECEIVED", "CASH_SPEND", "UNACCOUNTED"]
    return t.select(F.concat(F.lit("c_"), "seq").alias("id"), "user_id", pick(kinds, F.col("seq") % 4).alias("entry_type"), "amount_paise", "category", F.when(F.col("k") % 3 > 0, F.concat(F.lit("note "), F.col("k") % 7)).alias("note"), F.col("txn_time").alias("occurred_at"))


CASH_SQL = """cash AS (
  SELECT 'c_' || seq AS id, user_id, ['ATM_WITHDRAWAL', 'CASH_RECEIVED', 'CASH_SPEND', 'UNACCOUNTED'][seq % 4 + 1] AS entry_type,
    amount_paise, category, CASE WHEN k % 3 > 0 THEN 'note ' || (k % 7) END AS note, txn_time AS occurred_at
  FROM txn)"""


def budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A monthly limit for the first four categories that a user spends on."""
    return transactions(spark, sf_dir).where("k % 16 < 4").select("user_id", "category").distinct().withColumn("monthly_limit_paise", F.lit(50_000).cast("long"))


BUDGET_SQL = "budget AS (SELECT DISTINCT user_id, category, CAST(50000 AS BIGINT) AS monthly_limit_paise FROM txn WHERE k % 16 < 4)"


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every payment's alert; an alert's reaction, where there is one, by `k`."""
    t = transactions(spark, sf_dir)
    return t.select(F.concat(F.lit("a_"), "seq").alias("id"), "user_id", pick(["ROAST", "NUDGE", "SUMMARY", "CONFIRMATION"], F.col("k") % 4).alias("alert_type"), F.when(F.col("k") % 10 == 0, "SUPPRESSED").otherwise("SENT").alias("status"), F.col("txn_time").alias("sent_at"), F.when(F.col("k") % 5 < 3, pick(["LIKED", "NOT_FAIR", "MUTE"], F.col("k") % 5 % 3)).alias("reaction"), "category")


ALERT_SQL = """alert AS (
  SELECT 'a_' || seq AS id, user_id, ['ROAST', 'NUDGE', 'SUMMARY', 'CONFIRMATION'][k % 4 + 1] AS alert_type,
    CASE WHEN k % 10 = 0 THEN 'SUPPRESSED' ELSE 'SENT' END AS status, txn_time AS sent_at,
    CASE WHEN k % 5 < 3 THEN ['LIKED', 'NOT_FAIR', 'MUTE'][k % 5 % 3 + 1] END AS reaction, category
  FROM txn)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bank or wallet message for each payment, in one of eight wordings."""
    t = transactions(spark, sf_dir)
    rupees = F.format_string("%d.%02d", F.floor(F.col("amount_paise") / 100), F.col("amount_paise") % 100)
    ref = F.lpad(F.col("seq").cast("string"), 12, "7")
    words = [
        F.concat(F.lit("Rs."), rupees, F.lit(" debited from a/c XX"), F.lpad(F.col("k").cast("string"), 4, "0"), F.lit(" to VPA "), F.regexp_replace("merchant_raw", "[^A-Za-z0-9@]", ""), F.lit(" on 03-10. UPI Ref "), ref),
        F.concat(F.lit("INR "), rupees, F.lit(" credited to a/c XX1234 by "), F.col("merchant_raw"), F.lit(". Ref "), ref),
        F.concat(F.lit("Your OTP is "), F.col("seq"), F.lit(" for Rs."), rupees),
        F.concat(F.lit("Get up to Rs."), rupees, F.lit(" off, apply now")),
        F.concat(F.lit("Avl Bal: Rs."), rupees),
        F.concat(F.col("merchant_raw"), F.lit(" has requested money Rs "), rupees),
        F.concat(F.lit("Payment of Rs."), rupees, F.lit(" to "), F.col("merchant_raw"), F.lit(" failed")),
        F.lit("Hello there"),
    ]
    body = F.element_at(F.array(*words), (F.col("seq") % 8).cast("int") + 1)
    return t.select(F.concat(F.lit("e_"), "seq").alias("event_id"), "user_id", pick(["AX-HDFCBK", "VM-SBIUPI-S", "JD-ICICIB"], F.col("seq") % 3).alias("sender"), F.when(F.col("seq") % 4 == 0, "com.phonepe.app").alias("source_app"), body.alias("text"), F.col("txn_time").alias("posted_at"), "amount_paise", "seq", "k")


MESSAGE_SQL = r"""rupee AS (SELECT *, (amount_paise // 100) || '.' || lpad(CAST(amount_paise % 100 AS VARCHAR), 2, '0') AS r, lpad(CAST(seq AS VARCHAR), 12, '7') AS ref FROM txn),
message AS (
  SELECT 'e_' || seq AS event_id, user_id, ['AX-HDFCBK', 'VM-SBIUPI-S', 'JD-ICICIB'][seq % 3 + 1] AS sender, CASE WHEN seq % 4 = 0 THEN 'com.phonepe.app' END AS source_app,
    CASE seq % 8
      WHEN 0 THEN 'Rs.' || r || ' debited from a/c XX' || lpad(CAST(k AS VARCHAR), 4, '0') || ' to VPA ' || regexp_replace(merchant_raw, '[^A-Za-z0-9@]', '', 'g') || ' on 03-10. UPI Ref ' || ref
      WHEN 1 THEN 'INR ' || r || ' credited to a/c XX1234 by ' || merchant_raw || '. Ref ' || ref
      WHEN 2 THEN 'Your OTP is ' || seq || ' for Rs.' || r
      WHEN 3 THEN 'Get up to Rs.' || r || ' off, apply now'
      WHEN 4 THEN 'Avl Bal: Rs.' || r
      WHEN 5 THEN merchant_raw || ' has requested money Rs ' || r
      WHEN 6 THEN 'Payment of Rs.' || r || ' to ' || merchant_raw || ' failed'
      ELSE 'Hello there' END AS text,
    txn_time AS posted_at, amount_paise, seq, k
  FROM rupee)"""
