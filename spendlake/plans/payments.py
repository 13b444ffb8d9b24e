"""Queries on payments, cash and triggers."""

from datetime import datetime

from pyspark.sql import functions as F

from spendlake.operators import cash, policy, spending, triggers
from spendlake.sources import tables as t

WEEK = "CAST(date_trunc('week', txn_time + INTERVAL 330 MINUTE) AS DATE)"
DAY = "CAST(txn_time + INTERVAL 330 MINUTE AS DATE)"
MONTH = "CAST(date_trunc('month', txn_time + INTERVAL 330 MINUTE) AS DATE)"
SPEND = "kind = 'SPEND' AND status = 'SUCCESS' AND direction = 'DEBIT'"
ANY_SPEND = "kind = 'SPEND' AND status = 'SUCCESS'"
START, END = datetime(2024, 1, 8), datetime(2024, 1, 22)


def fake_forecasts(spark, sf_dir):
    """A forecast for every payment, the broke date by `k`."""
    rows = t.transactions(spark, sf_dir)
    return rows.select(F.concat(F.lit("f_"), "seq").alias("id"), "user_id", F.col("txn_time").alias("computed_at"), F.expr("date_add(cast(txn_time as date), cast(k % 45 as int))").alias("broke_p50"))


FORECAST_SQL = "fc AS (SELECT 'f_' || seq AS id, user_id, txn_time AS computed_at, CAST(txn_time AS DATE) + CAST(k % 45 AS INTEGER) AS broke_p50 FROM txn)"

QUERIES = {
    "spend_total": lambda s, d: spending.spend_total(t.transactions(s, d), F.lit(START).cast("timestamp_ntz"), F.lit(END).cast("timestamp_ntz")),
    "weekly_summary": lambda s, d: spending.weekly_summary(t.transactions(s, d)),
    "weekly_by_category": lambda s, d: spending.weekly_by(t.transactions(s, d), "category"),
    "top_merchants_week": lambda s, d: spending.top_merchants(t.transactions(s, d)),
    "daily_summary": lambda s, d: spending.daily_summary(t.transactions(s, d)),
    "month_budget_usage": lambda s, d: spending.budget_usage(t.transactions(s, d), t.budgets(s, d)),
    "top_categories": lambda s, d: spending.top_categories(t.transactions(s, d)),
    "essential_split": lambda s, d: spending.essential_split(t.transactions(s, d)),
    "recent_transactions": lambda s, d: spending.recent(t.transactions(s, d), 20).drop("k"),
    "txn_page_keyset": lambda s, d: spending.page(t.transactions(s, d), 50, (F.lit(END).cast("timestamp_ntz"), F.lit("t_5"))).select("id", "user_id", "txn_time", spending.cursor(F.col("txn_time"), F.col("id")).alias("cursor")),
    "txn_cursor_decode": lambda s, d: t.transactions(s, d).select("id", spending.cursor(F.col("txn_time"), F.col("id")).alias("cursor")).select("id", spending.decoded(F.col("cursor")).alias("at")).select("id", "at.txn_time", F.col("at.id").alias("row_id")),
    "user_page": lambda s, d: spending.user_pages(t.transactions(s, d), 10, t.transactions(s, d).groupBy("user_id").agg(F.max("txn_time").alias("txn_time")).select("user_id", spending.cursor(F.col("txn_time"), F.lit("t_5")).alias("cursor"))).select("id", "user_id", "txn_time", "place"),
    "clean_payload": lambda s, d: spending.clean_payload(
        t.transactions(s, d).select("id", "user_id", "amount_paise", (F.col("seq") % 40 + 1).alias("merchant_id")),
        t.transactions(s, d).where("seq % 3 > 0").select(F.col("id").alias("transaction_id"), F.explode(F.expr("transform(sequence(1L, seq % 3), i -> concat('e', seq % 7 + i))")).alias("raw_event_id")),
        t.table(s, d, "supplier").where("s_suppkey <= 30").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")),
    ).withColumn("source_ids", F.array_join("source_ids", ",")),
    "latest_forecast_row": lambda s, d: spending.latest(fake_forecasts(s, d), "user_id", "computed_at", "id"),
    "cash_balance": lambda s, d: cash.balances(t.cash_ledger(s, d)),
    "cash_habits": lambda s, d: cash.habits(t.cash_ledger(s, d)),
    "cash_breakdowns": lambda s, d: cash.breakdowns(cash.unaccounted(t.cash_ledger(s, d)), cash.habits(t.cash_ledger(s, d))).select("id", F.to_json("ways").alias("ways")),
    "due_summaries": lambda s, d: policy.due_summaries(t.transactions(s, d).select("user_id").distinct().select("user_id", (F.col("user_id") % 24 * 60).cast("int").alias("quiet_start"), F.lit(480).alias("quiet_end")), spending.daily_summary(t.transactions(s, d)), t.alerts(s, d).where("user_id % 5 = 0").select("user_id", F.lit("daily:2024-01-20").alias("dedupe_key")).distinct(), F.lit(datetime(2024, 1, 20, 15, 45)).cast("timestamp_ntz")),
    "cash_logged_since": lambda s, d: cash.unaccounted(t.cash_ledger(s, d)),
    "feedback_histogram": lambda s, d: t.alerts(s, d).where(F.col("reaction").isNotNull() & (F.col("sent_at") >= F.lit(START).cast("timestamp_ntz"))).groupBy("user_id", "reaction").agg(F.count(F.lit(1)).alias("n")),
    "frequency_trigger": lambda s, d: triggers.frequent(t.transactions(s, d)),
    "budget_crossing": lambda s, d: triggers.budget_crossings(t.transactions(s, d), t.budgets(s, d)),
    "forecast_moved": lambda s, d: triggers.moved_earlier(fake_forecasts(s, d)),
    "commitment_progress": lambda s, d: triggers.commitment_progress(t.transactions(s, d), t.budgets(s, d).select("user_id").distinct().select("user_id", F.lit("coffee").alias("target"), F.lit(20240131).alias("due_at"))),
}


def with_txn(body: str, *more: str) -> str:
    return f"WITH {', '.join([t.TXN_SQL, *more])} {body}"


def way(*parts: str) -> str:
    """SQL of a JSON list of categories and amounts, given in turn."""
    each = [f"""'{{"category":"' || {c} || '","amount_paise":' || ({a}) || '}}'""" for c, a in zip(parts[::2], parts[1::2], strict=True)]
    return "'[' || " + " || ',' || ".join(each) + " || ']'"


ORACLE_SQL = {
    "spend_total": with_txn(f"SELECT user_id, CAST(coalesce(sum(amount_paise) FILTER ({SPEND} AND txn_time >= TIMESTAMP '2024-01-08' AND txn_time < TIMESTAMP '2024-01-22'), 0) AS BIGINT) AS total_paise FROM txn GROUP BY user_id"),
    "weekly_summary": with_txn(
        f""", w AS (SELECT user_id, {WEEK} AS week, CAST(sum(amount_paise) AS BIGINT) AS total_paise, count(*) AS n FROM txn WHERE {SPEND} GROUP BY ALL)
        SELECT w.*, coalesce(p.total_paise, 0) AS previous_paise FROM w LEFT JOIN w p ON p.user_id = w.user_id AND p.week = w.week - 7"""
    ).replace(" , w AS", ", w AS"),
    "weekly_by_category": with_txn(f"SELECT user_id, {WEEK} AS week, category, CAST(sum(amount_paise) AS BIGINT) AS total_paise, count(*) AS n FROM txn WHERE {SPEND} GROUP BY ALL"),
    "top_merchants_week": with_txn(
        f"""SELECT *, row_number() OVER (PARTITION BY user_id, week ORDER BY total_paise DESC, merchant_raw) AS place
        FROM (SELECT user_id, {WEEK} AS week, merchant_raw, CAST(sum(amount_paise) AS BIGINT) AS total_paise, count(*) AS n FROM txn WHERE {SPEND} GROUP BY ALL) QUALIFY place <= 3"""
    ),
    "daily_summary": with_txn(f"SELECT user_id, {DAY} AS day, CAST(sum(amount_paise) AS BIGINT) AS total_paise, count(*) AS n FROM txn WHERE {ANY_SPEND} GROUP BY ALL"),
    "month_budget_usage": with_txn(
        f"""SELECT user_id, category, month, monthly_limit_paise, coalesce(spent, 0) AS spent_paise, coalesce(spent, 0) * 100 // monthly_limit_paise AS percent_used FROM budget
        LEFT JOIN (SELECT user_id, category, {MONTH} AS month, CAST(sum(amount_paise) AS BIGINT) AS spent FROM txn WHERE {ANY_SPEND} GROUP BY ALL) USING (user_id, category)""",
        t.BUDGET_SQL,
    ),
    "top_categories": with_txn(
        f"""SELECT user_id, category, place, total_paise, total_paise // greatest(1, days) AS daily_avg_paise FROM (
          SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY total_paise DESC, category) AS place FROM (SELECT user_id, category, CAST(sum(amount_paise) AS BIGINT) AS total_paise FROM txn WHERE {SPEND} GROUP BY ALL) QUALIFY place <= 5)
        JOIN (SELECT user_id, count(DISTINCT {DAY}) AS days FROM txn WHERE {SPEND} GROUP BY ALL) USING (user_id)"""
    ),
    "essential_split": with_txn(f"SELECT user_id, category, category IN ('GROCERIES', 'TRANSPORT', 'BILLS_UTILITIES', 'RENT', 'HEALTH', 'EDUCATION') AS essential, CAST(sum(amount_paise) AS BIGINT) AS total_paise, count(*) AS n FROM txn WHERE {SPEND} GROUP BY ALL"),
    "recent_transactions": with_txn("SELECT * EXCLUDE (k), row_number() OVER (PARTITION BY user_id ORDER BY txn_time DESC, id DESC) AS place FROM txn QUALIFY place <= 20"),
    "txn_page_keyset": with_txn("SELECT id, user_id, txn_time, replace(replace(base64(encode(strftime(txn_time, '%Y-%m-%d %H:%M:%S.%f') || '|' || id)), '+', '-'), '/', '_') AS cursor FROM txn WHERE (txn_time, id) < (TIMESTAMP '2024-01-22', 't_5') ORDER BY txn_time DESC, id DESC LIMIT 51"),
    "txn_cursor_decode": with_txn("SELECT id, txn_time, id AS row_id FROM txn"),
    "user_page": with_txn(
        """SELECT id, user_id, txn_time, row_number() OVER (PARTITION BY user_id ORDER BY txn_time DESC, id DESC) AS place FROM txn JOIN (SELECT user_id, max(txn_time) AS last FROM txn GROUP BY ALL) USING (user_id)
        WHERE (txn_time, id) < (last, 't_5') QUALIFY place <= 11"""
    ),
    "clean_payload": with_txn(
        """SELECT seq % 40 + 1 AS merchant_id, id, user_id, amount_paise, CASE seq % 3 WHEN 1 THEN 'e' || (seq % 7 + 1) WHEN 2 THEN 'e' || (seq % 7 + 1) || ',e' || (seq % 7 + 2) END AS source_ids, s_name AS merchant_name
        FROM txn LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey <= 30) ON s_suppkey = seq % 40 + 1"""
    ),
    "latest_forecast_row": with_txn("SELECT user_id, id, computed_at, broke_p50 FROM fc QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY computed_at DESC, id DESC) = 1", FORECAST_SQL),
    "cash_balance": with_txn(
        """SELECT user_id, balance_paise, greatest(0, balance_paise) AS in_hand_paise, greatest(0, -balance_paise) AS over_logged_paise FROM (
        SELECT user_id, CAST(sum(CASE WHEN entry_type IN ('ATM_WITHDRAWAL', 'CASH_RECEIVED') THEN amount_paise ELSE -amount_paise END) AS BIGINT) AS balance_paise FROM cash GROUP BY user_id)""",
        t.CASH_SQL,
    ),
    "cash_habits": with_txn(
        """SELECT user_id, category, n, median_paise, total_paise, array_to_string(notes[1:3], ', ') AS notes, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, category) AS place FROM (
        SELECT user_id, category, count(*) AS n, CAST(trunc(median(amount_paise)) AS BIGINT) AS median_paise, CAST(sum(amount_paise) AS BIGINT) AS total_paise, coalesce(list_sort(list_distinct(list(note))), []) AS notes
        FROM cash WHERE entry_type = 'CASH_SPEND' GROUP BY ALL) QUALIFY place <= 6""",
        t.CASH_SQL,
    ),
    "cash_breakdowns": with_txn(
        f"""SELECT id, '[' || {way("c[1]", "t")} || CASE WHEN len(c) >= 2 THEN ',' || {way("c[1]", "b1", "c[2]", "t - b1")} ELSE '' END
          || CASE WHEN len(c) >= 3 THEN ',' || {way("c[1]", "d1", "c[2]", "d2", "c[3]", "t - d1 - d2")} WHEN other IS NOT NULL THEN ',' || {way("other", "t")} ELSE '' END || ']' AS ways
        FROM (SELECT *, least(t - d1 - 1000, greatest(1000, t * w[2] // (w[1] + w[2] + w[3]) // 1000 * 1000)) AS d2 FROM (
          SELECT *, least(t - 1000, greatest(1000, t * w[1] // (w[1] + w[2]) // 1000 * 1000)) AS b1, least(t - 2000, greatest(1000, t * w[1] // (w[1] + w[2] + w[3]) // 1000 * 1000)) AS d1 FROM (
            SELECT a.id, t, coalesce(c, usual) AS c, coalesce(w, [1, 1, 1]) AS w, list_filter(usual, lambda u: NOT list_contains(coalesce(c, usual), u))[1] AS other FROM (
              SELECT a.id, a.user_id, ['DINING_OUT', 'TRANSPORT', 'SHOPPING'] AS usual, greatest(0, a.amount_paise - CAST(coalesce(sum(b.amount_paise), 0) AS BIGINT)) AS t
              FROM cash a LEFT JOIN cash b ON a.user_id = b.user_id AND b.occurred_at >= a.occurred_at AND b.entry_type IN ('CASH_SPEND', 'UNACCOUNTED') WHERE a.entry_type = 'ATM_WITHDRAWAL' GROUP BY a.id, a.user_id, a.amount_paise) a
            LEFT JOIN (SELECT user_id, list(category ORDER BY place) AS c, list(total ORDER BY place) AS w FROM (
              SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, category) AS place FROM (SELECT user_id, category, count(*) AS n, CAST(sum(amount_paise) AS BIGINT) AS total FROM cash WHERE entry_type = 'CASH_SPEND' GROUP BY ALL)
              QUALIFY place <= 6) WHERE total > 0 GROUP BY user_id) h ON h.user_id = a.user_id WHERE t >= 5000)))""",
        t.CASH_SQL,
    ),
    "due_summaries": with_txn(
        f"""SELECT u.user_id, 'daily:2024-01-20' AS dedupe_key, coalesce(total_paise, 0) AS total_paise, coalesce(n, 0) AS n FROM (SELECT DISTINCT user_id FROM txn) u
        LEFT JOIN (SELECT user_id, CAST(sum(amount_paise) AS BIGINT) AS total_paise, count(*) AS n FROM txn WHERE {ANY_SPEND} AND {DAY} = DATE '2024-01-20' GROUP BY user_id) s ON s.user_id = u.user_id
        WHERE NOT (CASE WHEN u.user_id % 24 * 60 <= 480 THEN 1275 >= u.user_id % 24 * 60 AND 1275 < 480 ELSE 1275 >= u.user_id % 24 * 60 OR 1275 < 480 END) AND NOT (u.user_id % 5 = 0 AND u.user_id IN (SELECT user_id FROM alert))""",
        t.ALERT_SQL,
    ),
    "cash_logged_since": with_txn(
        """SELECT a.id, a.user_id, a.amount_paise, CAST(coalesce(sum(b.amount_paise), 0) AS BIGINT) AS logged_paise, greatest(0, a.amount_paise - CAST(coalesce(sum(b.amount_paise), 0) AS BIGINT)) AS unaccounted_paise
        FROM cash a LEFT JOIN cash b ON a.user_id = b.user_id AND b.occurred_at >= a.occurred_at AND b.entry_type IN ('CASH_SPEND', 'UNACCOUNTED') WHERE a.entry_type = 'ATM_WITHDRAWAL' GROUP BY a.id, a.user_id, a.amount_paise""",
        t.CASH_SQL,
    ),
    "feedback_histogram": with_txn("SELECT user_id, reaction, count(*) AS n FROM alert WHERE reaction IS NOT NULL AND sent_at >= TIMESTAMP '2024-01-08' GROUP BY ALL", t.ALERT_SQL),
    "frequency_trigger": with_txn(
        """SELECT id, user_id, merchant_raw, category, n, 'freq:' || merchant_raw || ':' || isoyear(txn_time + INTERVAL 330 MINUTE) || '-W' || lpad(CAST(weekofyear(txn_time + INTERVAL 330 MINUTE) AS VARCHAR), 2, '0') AS dedupe_key FROM (
        SELECT *, count(*) OVER (PARTITION BY user_id, merchant_raw ORDER BY txn_time RANGE BETWEEN INTERVAL '6 days 23:59:59.999999' PRECEDING AND CURRENT ROW) AS n
        FROM txn WHERE kind = 'SPEND' AND status = 'SUCCESS' AND NOT regexp_matches(merchant_raw, '(?i)^p[0-9a-f]{8}@[a-z0-9]+$')) WHERE n >= 3"""
    ),
    "budget_crossing": with_txn(
        f"""SELECT id, user_id, category, month, after AS spent_paise, CAST(CASE WHEN b < 100 * l AND 100 * l <= a THEN 100 ELSE 80 END AS INTEGER) AS crossed FROM (
        SELECT *, after * 100 AS a, (after - amount_paise) * 100 AS b, monthly_limit_paise AS l FROM (
          SELECT *, CAST(sum(amount_paise) OVER (PARTITION BY user_id, category, month ORDER BY txn_time RANGE UNBOUNDED PRECEDING) AS BIGINT) AS after FROM (SELECT *, {MONTH} AS month FROM txn WHERE {ANY_SPEND}) JOIN budget USING (user_id, category)))
        WHERE (b < 80 * l AND 80 * l <= a) OR (b < 100 * l AND 100 * l <= a)""",
        t.BUDGET_SQL,
    ),
    "forecast_moved": with_txn(
        """SELECT id, user_id, broke_p50, previous, CAST(previous - broke_p50 AS INTEGER) AS days_earlier FROM (
        SELECT *, lag(broke_p50) OVER (PARTITION BY user_id ORDER BY computed_at, id) AS previous FROM fc) WHERE previous - broke_p50 >= 3""",
        FORECAST_SQL,
    ),
    "commitment_progress": with_txn("SELECT u.user_id, 'coffee' AS target, 20240131 AS due_at, count(*) FILTER (contains(lower(merchant_raw), 'coffee') AND direction = 'DEBIT') AS n FROM (SELECT DISTINCT user_id FROM budget) u LEFT JOIN txn USING (user_id) GROUP BY u.user_id", t.BUDGET_SQL),
}
