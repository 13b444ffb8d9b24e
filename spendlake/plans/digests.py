"""Queries on whole summaries, lists, settings, memories and forecasts' inputs."""

from datetime import date, datetime

from pyspark.sql import functions as F

from spendlake.functions import commitments, grounding, messages, money
from spendlake.operators import datasets, digests, forecast, ingest, memory
from spendlake.plans import texts
from spendlake.plans.payments import DAY, WEEK, with_txn
from spendlake.sources import tables as t

NOW = datetime(2024, 1, 28, 12)


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def with_merchants(s, d):
    """Payments of which every other payee is a known merchant."""
    return t.transactions(s, d).withColumn("merchant_id", F.when(F.col("k") % 2 == 0, F.col("k") % 12 + 1))


def suppliers(s, d):
    return t.table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))


def joined(column: str, *fields: str):
    """The structs of an array as text."""
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", *(x[f].cast("string") for f in fields))), ",").alias(column)


def memories(s, d):
    """Embeddings as memories of users of fifty; every third is a commitment, of which some have a date."""
    e = t.table(s, d, "embeddings")
    i = F.col("vec_id")
    return e.select(
        i.alias("id"), F.floor(i / memory.KEPT).alias("user_id"), F.when(i % 3 == 0, "COMMITMENT").otherwise("FACT").alias("kind"), "embedding", (i % 10 / 10.0).alias("confidence"), F.date_sub(F.to_date(now()), (i % 200).cast("int")).alias("last_used_at"),
        F.when(i % 9 == 0, "FORGOTTEN").otherwise("ACTIVE").alias("status"), F.when(i % 4 > 0, F.date_add(F.to_date(now()), (i % 31).cast("int"))).alias("due_at"), F.date_sub(F.to_date(now()), (i % 17).cast("int")).alias("created_at"),
    )


def new_memories(s, d):
    """One new memory for each user: the vector of one that is there for some, turned around for others; some replace a memory, of another user too."""
    e = memories(s, d).where(F.col("id") % memory.KEPT == 1)
    vector = F.when(F.col("user_id") % 2 == 0, F.col("embedding")).otherwise(F.transform("embedding", lambda x: -x))
    replaces = F.when(F.col("user_id") % 3 == 0, F.col("id") + 1).when(F.col("user_id") % 3 == 1, F.col("id") + memory.KEPT)
    return e.select((F.col("id") + 10_000_000).alias("id"), "user_id", "kind", vector.alias("embedding"), F.lit(0.95).alias("confidence"), F.to_date(now()).alias("last_used_at"), F.lit("ACTIVE").alias("status"), F.lit(None).cast("date").alias("due_at"), F.to_date(now()).alias("created_at"), replaces.alias("replaces"))


def typed_entries(s, d):
    rows = t.transactions(s, d)
    kind = t.pick(["CASH_SPEND", "CASH_RECEIVED", "ATM_WITHDRAWAL", "UNACCOUNTED"], F.col("k") % 4)
    return rows.select("id", kind.alias("entry_type"), (F.col("amount_paise") * (F.col("k") - 10)).alias("amount_paise"), F.repeat(F.lit("n"), (F.col("k") * 2).cast("int")).alias("note"), F.col("txn_time").alias("occurred_at"))


def outbox(s, d):
    """Messages of five devices, some sent."""
    rows = t.transactions(s, d)
    return rows.select((F.col("seq") % 5).alias("device"), "id", F.col("txn_time").alias("posted_at"), F.when(F.col("k") % 3 == 0, "SENT").otherwise("PENDING").alias("status"), (F.col("k") % 4).cast("int").alias("attempts"))


def upload_results(s, d):
    return t.transactions(s, d).where("seq % 2 = 0").select("id", t.pick(["ACCEPTED", "DUPLICATE", "REJECTED"], F.col("k") % 3).alias("result"))


def stated(s, d):
    """Payments; messages of every other user state the balance after some."""
    return t.transactions(s, d).withColumn("balance_after_paise", F.when((F.col("k") % 6 == 0) & (F.col("user_id") % 2 == 0), F.col("amount_paise") * 7))


def given(s, d):
    """Balances that every fifth user gives."""
    return t.transactions(s, d).where("user_id % 5 = 0").select("user_id").distinct().withColumn("bank_paise", F.lit(123_456).cast("long"))


def built(s, d):
    return forecast.built(stated(s, d), t.cash_ledger(s, d), now(), given(s, d))


def old_forecasts(s, d):
    """Forecasts of past payments; those of every third user are from within the last hour, and some have no date."""
    rows = t.transactions(s, d).where(F.col("txn_time") <= now())
    at = F.when(F.col("user_id") % 3 == 0, now() - F.expr("INTERVAL 30 MINUTES")).otherwise(F.col("txn_time"))
    return rows.select("user_id", F.concat(F.lit("f_"), "seq").alias("id"), at.alias("computed_at"), F.when(F.col("k") % 4 > 0, F.expr("date_add(date'2024-02-01', cast(k % 40 as int))")).alias("broke_p50"), F.lit(45).alias("horizon_days"))


def new_forecasts(s, d):
    users = t.transactions(s, d).select("user_id").distinct()
    return users.select("user_id", F.concat(F.lit("n_"), "user_id").alias("id"), F.when(F.col("user_id") % 7 > 0, F.expr("date_add(date'2024-01-29', cast(user_id % 30 as int))")).alias("broke_p50"))


def stated_numbers(s, d):
    """A line with an amount, a count with a unit and a day, of which some are wrong."""
    rows = t.transactions(s, d)
    rupees = F.format_string("%d.%02d", F.floor(F.col("amount_paise") / 100), F.col("amount_paise") % 100)
    line = F.concat(F.lit("₹"), rupees, F.lit(" on "), F.col("k") + F.when(F.col("k") % 5 == 0, 1).otherwise(0), F.lit(" orders, "), F.col("seq"), F.lit("k left, the "), F.col("k") % 28 + 1, F.lit("th"))
    return rows.select("id", line.alias("line"), F.array("amount_paise").alias("paise"), F.array("k", F.col("seq") * 1000, F.col("k") % 28 + 1).alias("counts"))


def results(s, d):
    """What tools say of a payment: nested, with a share, a date and a text; some are no JSON."""
    rows = t.transactions(s, d)
    body = F.concat(F.lit('{"spentPaise": '), "amount_paise", F.lit(', "items": [{"n": '), "k", F.lit(', "share": 0.25, "ok": true}, {"n": null}], "day": "'), F.to_date("txn_time"), F.lit('", "note": "about '), F.col("seq"), F.lit('k on the 3rd"}'))
    return rows.select("id", F.array(body, F.when(F.col("k") % 2 == 0, "not json")).alias("results"))


def cases(s, d):
    """A refund case for each failed payment."""
    rows = t.transactions(s, d).where("status = 'FAILED'")
    day = F.expr("INTERVAL 5 DAYS")
    return rows.select(F.concat(F.lit("rc_"), "seq").alias("id"), "user_id", F.lit("FAILED_DEBITED").alias("case_type"), t.pick(["OPEN", "CLOSED"], F.col("k") % 2).alias("state"), "amount_paise", F.col("seq").cast("string").alias("reference_id"), F.col("txn_time").alias("opened_at"), (F.col("txn_time") + day).alias("deadline_at"), F.when(F.col("k") % 2 == 1, F.col("txn_time") + day).alias("reversed_at"), F.when(F.col("k") % 3 == 0, F.lit(10_000)).alias("compensation_owed_paise"), F.lit(None).cast("long").alias("compensation_received_paise"), F.when(F.col("k") % 4 == 0, "Dear bank").when(F.col("k") % 4 == 1, "").alias("complaint_draft"))


def manifests(s, d):
    """Builds of models, two for each version."""
    return t.table(s, d, "part").select(F.concat(F.lit("v"), F.floor(F.col("p_partkey") / 2)).alias("version"), F.lit("Q4_K").alias("quant"), F.col("p_name").alias("sha256"))


def registered(s, d):
    rows = t.table(s, d, "part").where("p_partkey % 5 = 0")
    return rows.select(F.concat(F.lit("parser-v"), "p_partkey", F.lit("-q4_k")).alias("id"), F.lit("PARSER").alias("kind"), F.lit("ACTIVE").alias("status"), F.lit(True).alias("gate_passed"), F.lit("old").alias("sha256"))


def day_texts(s, d):
    from spendlake.operators.cash import balances

    rows = digests.days(t.transactions(s, d), t.cash_ledger(s, d)).join(balances(t.cash_ledger(s, d)).select("user_id", "balance_paise"), "user_id", "left")
    return rows.select("user_id", "day", messages.day_text(F.col("day"), F.col("total_paise"), F.col("n"), F.col("cash_paise"), F.col("top"), F.coalesce("balance_paise", F.lit(0))).alias("text"))


def forecast_labels(s, d):
    rows = t.transactions(s, d)
    early, late = (F.when(F.col("k") % m > 0, F.expr(f"date_add(date'2024-01-28', cast(k % {m} as int))")) for m in (20, 40))
    return rows.select("id", messages.broke_range(early, late, F.to_date(now()), F.lit(45)).alias("text"))


def distilled(s, d):
    rows = t.messages(s, d)
    return rows.select("event_id", F.when(F.col("k") % 9 > 0, t.pick(["a", "b"], F.col("k") % 2)).alias("first_label"), F.when(F.col("k") % 11 > 0, t.pick(["a", "b"], F.col("k") % 4 % 2)).alias("second_label"))


def models(s, d):
    """Models of 25 kinds, some of each kind active."""
    k = F.col("p_partkey")
    kind = F.concat(F.lit("kind"), k % 25)
    return t.table(s, d, "part").select(F.concat(kind, F.lit("-"), k).alias("id"), kind.alias("kind"), F.when(k % 7 == 0, "ACTIVE").otherwise("SHADOW").alias("status"), (k % 2 == 1).alias("gate_passed"))


QUERIES = {
    "paise_to_rupees": lambda s, d: t.transactions(s, d).select("id", money.paise_to_rupees(F.col("amount_paise") * (F.col("seq") - 500)).alias("rupees")),
    "numbers_in_text": lambda s, d: stated_numbers(s, d).select("id", F.array_join(grounding.numbers(F.col("line")).cast("array<string>"), ",").alias("numbers")),
    "ungrounded_numbers": lambda s, d: stated_numbers(s, d).select("id", F.array_join(grounding.ungrounded(F.col("line"), grounding.allowed_values(F.col("paise"), F.col("counts"))).cast("array<string>"), ",").alias("wrong")),
    "allowed_from_results": lambda s, d: results(s, d).select("id", F.array_join(F.array_sort(grounding.allowed_from_results(F.col("results"))).cast("array<string>"), ",").alias("allowed")),
    "insert_new": lambda s, d: ingest.insert_new(t.transactions(s, d).where("seq % 3 = 0").select("id", F.lit("old").alias("mark")), t.transactions(s, d).where("seq % 2 = 0").select("id", F.lit("new").alias("mark")), ["id"]),
    "promote_model": lambda s, d: ingest.promote(ingest.promote(models(s, d), "kind3-53"), "kind2-52"),
    "register_model": lambda s, d: ingest.register(registered(s, d), manifests(s, d)),
    "refund_cases": lambda s, d: digests.refund_cases(cases(s, d), 3),
    "memory_writes": lambda s, d: memory.written(texts.promises(s, d).join(t.transactions(s, d).select("id", "user_id"), "id"), t.alerts(s, d), F.lit(date(2026, 2, 1))),
    "day_texts": day_texts,
    "cash_logged_texts": lambda s, d: t.cash_ledger(s, d).select("id", messages.logged_text(F.col("entry_type"), F.col("amount_paise"), F.col("note"), F.col("category")).alias("text")),
    "forecast_labels": forecast_labels,
    "undo_cash": lambda s, d: ingest.undo_cash(t.cash_ledger(s, d), t.cash_ledger(s, d).where("user_id % 3 = 0").select(F.expr("case when amount_paise % 2 = 0 then id else substring(id, 3) end").alias("id"))).select("id"),
    "commitment_due_at": lambda s, d: memories(s, d).select("id", commitments.due_at(F.col("due_at")).alias("due")),
    "review_queue": lambda s, d: datasets.unreviewed(datasets.review_queue(distilled(s, d)), t.messages(s, d).where("seq % 5 = 0").select("event_id")).select("event_id", "reason"),
    "leaking_templates": lambda s, d: datasets.leaking(t.transactions(s, d).select(F.concat(F.lit("T"), F.col("seq") % 97).alias("template"), t.pick(["train", "val"], (F.col("seq") % 97 + F.floor(F.col("seq") / 970)).cast("int") % 2).alias("split"))),
    "weekly_digest": lambda s, d: digests.weeks(with_merchants(s, d), suppliers(s, d), t.cash_ledger(s, d)).select("user_id", "week", "week_end", "total_paise", "n", "cash_paise", "previous_paise", joined("categories", "name", "paise"), joined("top", "name", "paise", "n")),
    "daily_digest": lambda s, d: digests.days(t.transactions(s, d), t.cash_ledger(s, d)).select("user_id", "day", "total_paise", "n", "cash_paise", "in_hand_paise", joined("top", "name", "paise")),
    "recent_payments": lambda s, d: digests.recent_payments(t.transactions(s, d), now(), 14, 5, category="SHOPPING"),
    "recent_alerts": lambda s, d: digests.recent_alerts(t.alerts(s, d), now(), 14).select("id", "user_id", "alert_type", "place"),
    "commitment_list": lambda s, d: digests.commitments(memories(s, d)).select("id", "user_id", "place"),
    "latest_cash_entry": lambda s, d: digests.latest_entry(t.cash_ledger(s, d), F.lit(datetime(2024, 1, 10)).cast("timestamp_ntz")),
    "replace_budgets": lambda s, d: digests.replace_budgets(t.budgets(s, d), t.budgets(s, d).where("user_id % 3 = 0 AND category > 'G'").withColumn("monthly_limit_paise", F.lit(7).cast("long")), t.budgets(s, d).where("user_id % 3 = 0").select("user_id")),
    "settings": lambda s, d: digests.settings(t.transactions(s, d).select("user_id").distinct(), t.budgets(s, d)).select("user_id", joined("budgets", "category", "monthly_limit_paise")),
    "cash_entry_fault": lambda s, d: typed_entries(s, d).select("id", digests.entry_fault(now()).alias("fault")),
    "outbox_pending": lambda s, d: digests.pending(outbox(s, d), 3).select("device", "id", "batch"),
    "outbox_settled": lambda s, d: digests.settled(outbox(s, d), upload_results(s, d)).select("id", "status", "attempts"),
    "memory_search_kind": lambda s, d: memory.search(memories(s, d), memories(s, d).where("id % 100 = 0").select(F.col("id").alias("query_id"), "user_id", "embedding"), F.to_date(now()), kinds=["COMMITMENT"]),
    "memory_counts": lambda s, d: memory.active_counts(memories(s, d)),
    "memory_update": lambda s, d: memory.updated(memories(s, d), memories(s, d).where("id % 7 = 0").select("id", (F.col("user_id") + F.when(F.col("id") % 21 == 0, 1).otherwise(0)).alias("user_id"), F.when(F.col("id") % 2 == 0, 0.5).alias("confidence"), F.when(F.col("id") % 5 == 0, "DONE").alias("status"))).select("id", "status", "confidence"),
    "memory_forget_own": lambda s, d: memory.forgotten(memories(s, d), memories(s, d).where("id % 7 = 0").select("id", (F.col("user_id") + F.when(F.col("id") % 21 == 0, 1).otherwise(0)).alias("user_id"))).select("id", "status"),
    "memory_remember": lambda s, d: memory.remember(memories(s, d), new_memories(s, d), F.to_date(now()), 30).select("id", "user_id", "status", F.round("confidence", 6).alias("confidence")),
    "forecast_money": lambda s, d: built(s, d)[0],
    "forecast_spending": lambda s, d: built(s, d)[1].select("user_id", "day", "weekday", forecast.total(F.col("by_category"), {}).alias("paise")),
    "forecast_items": lambda s, d: built(s, d)[2],
    "forecast_answer": lambda s, d: forecast.answers(stated(s, d), t.cash_ledger(s, d), now(), given(s, d)).withColumn("top_categories", F.to_json("top_categories")),
    "refresh_due": lambda s, d: forecast.due_for_refresh(t.transactions(s, d).select("user_id"), old_forecasts(s, d), now()),
    "refresh_moved": lambda s, d: forecast.movements(old_forecasts(s, d), new_forecasts(s, d)),
}

SPEND = "kind = 'SPEND' AND status = 'SUCCESS'"


def digest_sql(period: str, cash_period: str, spend: str, name: str, categories: bool) -> str:
    """Sums of a period as common table expressions, and the rows with spending or cash spending."""
    return f"""spent AS (SELECT user_id, {period} AS p, category, {name} AS name, amount_paise FROM txn LEFT JOIN supplier ON k % 2 = 0 AND s_suppkey = k % 12 + 1 WHERE {spend}),
    cashed AS (SELECT user_id, {cash_period} AS p, CAST(sum(amount_paise) AS BIGINT) AS cash FROM cash WHERE entry_type = 'CASH_SPEND' GROUP BY ALL),
    cats AS (SELECT user_id, p, string_agg(category || ':' || v, ',' ORDER BY v DESC, category) AS categories FROM (SELECT user_id, p, category, CAST(sum(amount_paise) AS BIGINT) AS v FROM spent GROUP BY ALL) GROUP BY ALL),
    tops AS (SELECT user_id, p, string_agg(name || ':' || v{" || ':' || n" if categories else ""}, ',' ORDER BY v DESC, name) AS top FROM (SELECT * FROM (SELECT user_id, p, name, CAST(sum(amount_paise) AS BIGINT) AS v, count(*) AS n FROM spent GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY user_id, p ORDER BY v DESC, name) <= 3) GROUP BY ALL),
    whole AS (SELECT user_id, p, CAST(sum(amount_paise) AS BIGINT) AS total, count(*) AS n FROM spent GROUP BY ALL),
    digest AS (SELECT user_id, p, coalesce(total, 0) AS total_paise, coalesce(n, 0) AS n, coalesce(cash, 0) AS cash_paise, coalesce(categories, '') AS categories, coalesce(top, '') AS top FROM whole FULL JOIN cashed USING (user_id, p) LEFT JOIN cats USING (user_id, p) LEFT JOIN tops USING (user_id, p))"""


CASH_DAY = DAY.replace("txn_time", "occurred_at")
MEMORY_SQL = """memory AS (SELECT vec_id AS id, vec_id // 50 AS user_id, CASE WHEN vec_id % 3 = 0 THEN 'COMMITMENT' ELSE 'FACT' END AS kind, embedding, CAST((vec_id % 10) / 10.0 AS DOUBLE) AS confidence, pow(0.5, (vec_id % 200) / 60.0) AS recency, CASE WHEN vec_id % 9 = 0 THEN 'FORGOTTEN' ELSE 'ACTIVE' END AS status,
  CASE WHEN vec_id % 4 > 0 THEN DATE '2024-01-28' + CAST(vec_id % 31 AS INTEGER) END AS due_at, DATE '2024-01-28' - CAST(vec_id % 17 AS INTEGER) AS created_at FROM embeddings)"""
OLD_SQL = "old AS (SELECT user_id, 'f_' || seq AS id, CASE WHEN user_id % 3 = 0 THEN TIMESTAMP '2024-01-28 11:30:00' ELSE txn_time END AS computed_at, CASE WHEN k % 4 > 0 THEN DATE '2024-02-01' + CAST(k % 40 AS INTEGER) END AS broke_p50 FROM txn WHERE txn_time <= TIMESTAMP '2024-01-28 12:00:00')"
LIVE_SQL = """live AS (SELECT *, CAST(txn_time + INTERVAL 330 MINUTE AS DATE) AS day, CASE WHEN k % 6 = 0 AND user_id % 2 = 0 THEN amount_paise * 7 END AS stated FROM txn WHERE status = 'SUCCESS' AND txn_time <= TIMESTAMP '2024-01-28 12:00:00'),
given AS (SELECT DISTINCT user_id, CAST(123456 AS BIGINT) AS g FROM txn WHERE user_id % 5 = 0)"""
PAYEE_KEY = "CASE WHEN {0} <> '' THEN {0} ELSE '?' || id END"
#: Payments of the last ninety days by payee, and what of them repeats.
REPEAT_SQL = """past AS (SELECT user_id, id, {key} AS key, CASE direction WHEN 'CREDIT' THEN amount_paise ELSE -amount_paise END AS a, day, category FROM live WHERE kind IN ('SPEND', 'INCOME')),
mid AS (SELECT user_id, key, a > 0 AS income, CAST(trunc(median(a)) AS BIGINT) AS m FROM past WHERE a <> 0 GROUP BY ALL HAVING count(*) >= 2),
same AS (SELECT p.*, mid.income, day - lag(day) OVER (PARTITION BY p.user_id, p.key, mid.income ORDER BY day, id) AS gap FROM past p JOIN mid ON p.user_id = mid.user_id AND p.key = mid.key AND (p.a > 0) = mid.income WHERE a <> 0 AND abs(a - m) * 100 <= 10 * abs(m)),
item AS (SELECT user_id, key, income, CAST(trunc(median(a)) AS BIGINT) AS amount_paise, max(day) AS last, arg_max(category, (day, id)) AS category, CASE WHEN count(*) >= 3 AND bool_and(abs(gap - 7) <= 3) THEN 7 WHEN count(*) >= 2 AND bool_and(abs(gap - 30) <= 3) THEN 30 END AS step FROM same GROUP BY ALL),
due AS (SELECT user_id, key, income, amount_paise, CAST(last + step AS DATE) AS next_date, CAST(step AS INTEGER) AS interval_days, category FROM item WHERE step IS NOT NULL),
explained AS (SELECT s.user_id, s.id FROM same s JOIN due USING (user_id, key, income))"""


def repeat_sql() -> str:
    from spendlake.plans.texts import KEY_SQL

    return REPEAT_SQL.format(key=PAYEE_KEY.format(f"({KEY_SQL})"))


def inr(paise: str) -> str:
    """SQL of an amount above 0 in Indian grouping."""
    whole = f"CAST(({paise}) // 100 AS VARCHAR)"
    return f"('₹' || CASE WHEN length({whole}) <= 3 THEN {whole} ELSE reverse(substr(reverse({whole}), 1, 3) || regexp_replace(substr(reverse({whole}), 4), '(..?)', ',\\1', 'g')) END || '.' || lpad(CAST(({paise}) % 100 AS VARCHAR), 2, '0'))"


NUMBERS_SQL = "n AS (SELECT id, CAST(amount_paise / 100.0 AS DECIMAL(30, 4)) AS a, CAST(k + CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END AS DECIMAL(30, 4)) AS b, CAST(seq * 1000 AS DECIMAL(30, 4)) AS c, CAST(k % 28 + 1 AS DECIMAL(30, 4)) AS d, [CAST(amount_paise / 100.0 AS DECIMAL(30, 4)), CAST(round_even(CAST(amount_paise AS DOUBLE) / 100, 0) AS DECIMAL(30, 4)), k, seq * 1000, k % 28 + 1] AS ok FROM txn)"
ORACLE_SQL = {
    "paise_to_rupees": with_txn("SELECT id, CAST(amount_paise * (seq - 500) / 100.0 AS DECIMAL(20, 2)) AS rupees FROM txn"),
    "numbers_in_text": with_txn("SELECT id, a || ',' || b || ',' || c || ',' || d AS numbers FROM n", NUMBERS_SQL),
    "ungrounded_numbers": with_txn("SELECT id, array_to_string(list_transform(list_filter([a, b, c, d], lambda v: NOT list_contains(ok, v) AND NOT list_contains(ok, CAST(round_even(CAST(v AS DOUBLE), 0) AS DECIMAL(30, 4)))), lambda v: CAST(v AS VARCHAR)), ',') AS wrong FROM n", NUMBERS_SQL),
    "allowed_from_results": with_txn(
        """SELECT id, array_to_string(list_transform(list_sort(list_distinct(list_transform([amount_paise / 100.0, round_even(CAST(amount_paise AS DOUBLE) / 100, 0), k, 0, 25, day(txn_time), month(txn_time), year(txn_time), year(txn_time), seq * 1000, 3] || list_transform(regexp_extract_all(strftime(txn_time, '%m-%d'), '[0-9]+'), lambda x: CAST(x AS DOUBLE)), lambda v: CAST(v AS DECIMAL(30, 4))))), lambda v: CAST(v AS VARCHAR)), ',') AS allowed FROM txn"""
    ),
    "insert_new": with_txn("SELECT id, CASE WHEN seq % 3 = 0 THEN 'old' ELSE 'new' END AS mark FROM txn WHERE seq % 3 = 0 OR seq % 2 = 0"),
    "promote_model": "SELECT 'kind' || p_partkey % 25 || '-' || p_partkey AS id, 'kind' || p_partkey % 25 AS kind, CASE WHEN p_partkey = 53 THEN 'ACTIVE' WHEN p_partkey % 7 > 0 THEN 'SHADOW' WHEN p_partkey % 25 = 3 THEN 'RETIRED' ELSE 'ACTIVE' END AS status, p_partkey % 2 = 1 AS gate_passed FROM part",
    "register_model": """SELECT 'parser-v' || p_partkey || '-q4_k' AS id, 'PARSER' AS kind, 'ACTIVE' AS status, true AS gate_passed, 'old' AS sha256 FROM part WHERE p_partkey % 5 = 0
      UNION ALL SELECT 'parser-v' || v || '-q4_k', 'PARSER', 'CANDIDATE', false, min(p_name) FROM (SELECT p_partkey // 2 AS v, p_name FROM part) WHERE v % 5 > 0 GROUP BY v""",
    "refund_cases": with_txn(
        """SELECT user_id, 'rc_' || seq AS id, 'FAILED_DEBITED' AS case_type, ['OPEN', 'CLOSED'][k % 2 + 1] AS state, amount_paise, '₹' || CASE WHEN length(w) <= 3 THEN w ELSE reverse(substr(reverse(w), 1, 3) || regexp_replace(substr(reverse(w), 4), '(..?)', ',\\1', 'g')) END || '.' || lpad(CAST(amount_paise % 100 AS VARCHAR), 2, '0') AS amount_text,
          CAST(seq AS VARCHAR) AS reference_id, txn_time AS opened_at, txn_time + INTERVAL 5 DAY AS deadline_at, CASE WHEN k % 2 = 1 THEN txn_time + INTERVAL 5 DAY END AS reversed_at, CAST(CASE WHEN k % 3 = 0 THEN 10000 ELSE 0 END AS BIGINT) AS compensation_owed_paise, CAST(0 AS BIGINT) AS compensation_received_paise, k % 4 = 0 AS has_draft,
          row_number() OVER (PARTITION BY user_id ORDER BY txn_time DESC, 'rc_' || seq DESC) AS place FROM (SELECT *, CAST(amount_paise // 100 AS VARCHAR) AS w FROM txn) WHERE status = 'FAILED' QUALIFY place <= 3"""
    ),
    "memory_writes": with_txn(
        """SELECT id AS source, user_id, 'COMMITMENT' AS kind, ['Please limit coffee to ' || (k % 30) || ' times a week till 5 mar', 'no food delivery this month until 31 feb', 'sirf chai 2 baar ek hafte', NULL, 'stop shoes for a week by ' || (k % 28 + 1) || 'jan'][seq % 5 + 1] AS content, 0.9::DOUBLE AS confidence,
          CASE seq % 5 WHEN 0 THEN TIMESTAMP '2026-03-05 18:29:00' WHEN 4 THEN CAST(make_date(2027, 1, CAST(k % 28 + 1 AS INTEGER)) AS TIMESTAMP) + INTERVAL '18 hours 29 minutes' END AS due_at FROM txn WHERE seq % 5 <> 3
        UNION ALL SELECT id, user_id, 'PREFERENCE', 'Finds roasts about ' || lower(replace(category, '_', ' ')) || ' not fair', 0.8, NULL FROM alert WHERE reaction = 'NOT_FAIR'""",
        t.ALERT_SQL,
    ),
    "day_texts": with_txn(
        f"""SELECT user_id, p AS day, '📊 Today, ' || strftime(p, '%-d %b') || chr(10) || CASE WHEN n = 0 AND cash_paise = 0 THEN 'No spends recorded today. 🙌' ELSE 'Spent ' || {inr("total_paise")} || ' in ' || n || ' payment' || CASE n WHEN 1 THEN '' ELSE 's' END || CASE WHEN cash_paise > 0 THEN ' + ' || {inr("cash_paise")} || ' cash' ELSE '' END END
          || CASE WHEN names <> '' THEN chr(10) || 'Top: ' || names ELSE '' END || chr(10) || CASE WHEN b >= 0 THEN 'Cash in hand: ' || {inr("b")} ELSE 'You logged ' || {inr("-b")} || ' more than tracked cash' END AS text FROM (
          SELECT *, coalesce((SELECT CAST(sum(CASE WHEN entry_type IN ('ATM_WITHDRAWAL', 'CASH_RECEIVED') THEN amount_paise ELSE -amount_paise END) AS BIGINT) FROM cash c WHERE c.user_id = digest.user_id), 0) AS b, array_to_string(list_transform(list_filter(string_split(top, ','), lambda x: x <> ''), lambda x: regexp_replace(x, ':[0-9]+$', '') || ' ' || {inr("CAST(regexp_extract(x, '[0-9]+$') AS BIGINT)")}), ', ') AS names FROM digest)""",
        t.CASH_SQL, digest_sql(DAY, CASH_DAY, SPEND, "coalesce(merchant_raw, 'unknown')", False),
    ),
    "cash_logged_texts": with_txn(
        f"""SELECT id, '✅ Logged ' || CASE entry_type WHEN 'CASH_SPEND' THEN 'cash spend' WHEN 'CASH_RECEIVED' THEN 'cash received' WHEN 'ATM_WITHDRAWAL' THEN 'ATM withdrawal' ELSE 'unaccounted cash' END || ' ' || {inr("amount_paise")} || coalesce(' · ' || note, '')
          || CASE WHEN category = 'CASH_UNCATEGORIZED' THEN '' ELSE ' (' || lower(replace(category, '_', ' ')) || ')' END AS text FROM cash""",
        t.CASH_SQL,
    ),
    "forecast_labels": with_txn(
        """SELECT id, CASE WHEN a = b THEN a ELSE a || ' – ' || b END AS text FROM (SELECT id, CASE WHEN k % 20 > 0 THEN strftime(DATE '2024-01-28' + CAST(k % 20 AS INTEGER), '%-d %b') ELSE 'after 13 Mar' END AS a, CASE WHEN k % 40 > 0 THEN strftime(DATE '2024-01-28' + CAST(k % 40 AS INTEGER), '%-d %b') ELSE 'after 13 Mar' END AS b FROM txn)"""
    ),
    "undo_cash": with_txn("SELECT id FROM cash WHERE user_id % 3 > 0", t.CASH_SQL),
    "commitment_due_at": f"WITH {MEMORY_SQL} SELECT id, CAST(due_at AS TIMESTAMP) + INTERVAL '18 hours 29 minutes' AS due FROM memory",
    "review_queue": with_txn(
        """SELECT event_id, reason FROM (SELECT 'e_' || seq AS event_id, seq, CASE WHEN k % 9 = 0 OR k % 11 = 0 THEN 'FAILED' WHEN k % 2 <> k % 4 % 2 THEN 'DISAGREE' WHEN CAST('0x' || substr(sha256('e_' || seq), 1, 8) AS BIGINT) % 10000 < 1000 THEN 'SAMPLE' END AS reason FROM txn)
        WHERE reason IS NOT NULL AND seq % 5 > 0"""
    ),
    "leaking_templates": with_txn("SELECT template, count(DISTINCT split) AS splits FROM (SELECT 'T' || (seq % 97) AS template, (seq % 97 + seq // 970) % 2 AS split FROM txn) GROUP BY template HAVING count(DISTINCT split) > 1"),
    "weekly_digest": with_txn(
        "SELECT user_id, p AS week, CAST(p + 6 AS DATE) AS week_end, total_paise, n, cash_paise, coalesce(CAST(sum(total_paise) OVER (PARTITION BY user_id ORDER BY p RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 7 DAY PRECEDING) AS BIGINT), 0) AS previous_paise, categories, top FROM digest",
        t.CASH_SQL, digest_sql(WEEK, WEEK.replace("txn_time", "occurred_at"), f"{SPEND} AND direction = 'DEBIT'", "coalesce(s_name, merchant_raw, 'unknown')", True),
    ),
    "daily_digest": with_txn(
        "SELECT user_id, p AS day, total_paise, n, cash_paise, coalesce(in_hand, 0) AS in_hand_paise, top FROM digest LEFT JOIN (SELECT user_id, greatest(0, CAST(sum(CASE WHEN entry_type IN ('ATM_WITHDRAWAL', 'CASH_RECEIVED') THEN amount_paise ELSE -amount_paise END) AS BIGINT)) AS in_hand FROM cash GROUP BY user_id) USING (user_id)",
        t.CASH_SQL, digest_sql(DAY, CASH_DAY, SPEND, "coalesce(merchant_raw, 'unknown')", False),
    ),
    "recent_payments": with_txn(f"SELECT user_id, id, amount_paise, direction, kind, status, coalesce(merchant_raw, 'unknown') AS merchant, category, {DAY} AS day, row_number() OVER (PARTITION BY user_id ORDER BY txn_time DESC, id DESC) AS place FROM txn WHERE category = 'SHOPPING' AND txn_time BETWEEN TIMESTAMP '2024-01-14 12:00:00' AND TIMESTAMP '2024-01-28 12:00:00' QUALIFY place <= 5"),
    "recent_alerts": with_txn("SELECT id, user_id, alert_type, row_number() OVER (PARTITION BY user_id ORDER BY sent_at DESC, id) AS place FROM alert WHERE status = 'SENT' AND sent_at >= TIMESTAMP '2024-01-14 12:00:00' QUALIFY place <= 10", t.ALERT_SQL),
    "commitment_list": f"WITH {MEMORY_SQL} SELECT id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY due_at ASC NULLS LAST, created_at, id) AS place FROM memory WHERE kind = 'COMMITMENT' AND status = 'ACTIVE'",
    "latest_cash_entry": with_txn("SELECT user_id, arg_max(id, (occurred_at, id)) AS id FROM cash WHERE occurred_at >= TIMESTAMP '2024-01-10' GROUP BY user_id", t.CASH_SQL),
    "replace_budgets": with_txn("SELECT user_id, category, CASE WHEN user_id % 3 = 0 THEN 7 ELSE monthly_limit_paise END AS monthly_limit_paise FROM budget WHERE user_id % 3 > 0 OR category > 'G'", t.BUDGET_SQL),
    "settings": with_txn("SELECT user_id, coalesce(b, '') AS budgets FROM (SELECT DISTINCT user_id FROM txn) LEFT JOIN (SELECT user_id, string_agg(category || ':' || monthly_limit_paise, ',' ORDER BY category) AS b FROM budget GROUP BY user_id) USING (user_id)", t.BUDGET_SQL),
    "cash_entry_fault": with_txn(
        """SELECT id, CASE WHEN k % 4 = 3 THEN 'ENTRY_TYPE' WHEN a <= 0 OR a > 10000000 THEN 'AMOUNT' WHEN k * 2 > 100 THEN 'NOTE' WHEN txn_time < TIMESTAMP '2023-12-29 12:00:00' OR txn_time > TIMESTAMP '2024-01-28 12:05:00' THEN 'OCCURRED_AT' END AS fault FROM (SELECT *, amount_paise * (k - 10) AS a FROM txn)"""
    ),
    "outbox_pending": with_txn("SELECT seq % 5 AS device, id, CAST((row_number() OVER (PARTITION BY seq % 5 ORDER BY txn_time, id) - 1) // 100 AS INTEGER) AS batch FROM txn WHERE k % 3 > 0 QUALIFY batch < 3"),
    "outbox_settled": with_txn("SELECT id, CASE WHEN k % 3 = 0 OR (seq % 2 = 0 AND k % 3 < 2) THEN 'SENT' ELSE 'PENDING' END AS status, CAST(k % 4 + CASE WHEN seq % 2 = 0 AND k % 3 = 2 THEN 1 ELSE 0 END AS INTEGER) AS attempts FROM txn"),
    "memory_search_kind": f"""WITH {MEMORY_SQL},
      near AS (SELECT q.id AS query_id, m.id, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(m.embedding AS DOUBLE[])), 6) AS near, m.recency, m.confidence FROM memory q JOIN memory m USING (user_id) WHERE q.id % 100 = 0 AND m.status = 'ACTIVE' AND m.kind = 'COMMITMENT'
        QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY near DESC, m.id) <= 20)
      SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS place, id, score FROM (SELECT query_id, id, round(near * recency * confidence, 6) AS score FROM near) QUALIFY place <= 10""",
    "memory_counts": f"WITH {MEMORY_SQL} SELECT user_id, count(*) FILTER (status = 'ACTIVE') AS n FROM memory GROUP BY user_id",
    "memory_update": f"WITH {MEMORY_SQL} SELECT id, CASE WHEN own AND id % 5 = 0 THEN 'DONE' ELSE status END AS status, CASE WHEN own AND id % 2 = 0 THEN 0.5::DOUBLE ELSE confidence END AS confidence FROM (SELECT *, id % 7 = 0 AND id % 21 > 0 AND status = 'ACTIVE' AS own FROM memory)",
    "memory_forget_own": f"WITH {MEMORY_SQL} SELECT id, CASE WHEN id % 7 = 0 AND id % 21 > 0 THEN 'FORGOTTEN' ELSE status END AS status FROM memory",
    "memory_remember": f"""WITH {MEMORY_SQL},
      fresh AS (SELECT id + 10000000 AS id, user_id, kind, CASE WHEN user_id % 2 = 0 THEN CAST(embedding AS DOUBLE[]) ELSE list_transform(CAST(embedding AS DOUBLE[]), lambda x: -x) END AS e, CASE user_id % 3 WHEN 0 THEN id + 1 END AS replaces FROM memory WHERE id % 50 = 1),
      old AS (SELECT * REPLACE (CASE WHEN id IN (SELECT replaces FROM fresh) THEN 'FORGOTTEN' ELSE status END AS status) FROM memory),
      near AS (SELECT f.id AS new_id, arg_max(o.id, (dot, o.id)) AS id FROM (SELECT f.id AS fid, o.id AS oid, list_dot_product(f.e, CAST(o.embedding AS DOUBLE[])) AS dot FROM fresh f JOIN old o ON f.user_id = o.user_id AND f.kind = o.kind AND o.status = 'ACTIVE') p JOIN fresh f ON f.id = fid JOIN old o ON o.id = oid WHERE dot >= 0.9 GROUP BY f.id),
      whole AS (
        SELECT id, user_id, status, CASE WHEN id IN (SELECT id FROM near) THEN least(1.0, greatest(confidence, 0.95) + 0.1) ELSE confidence END AS confidence, recency FROM old
        UNION ALL SELECT id, user_id, 'ACTIVE', 0.95, 1.0 FROM fresh WHERE id NOT IN (SELECT new_id FROM near))
      SELECT id, user_id, CASE WHEN status = 'ACTIVE' AND row_number() OVER (PARTITION BY user_id, status = 'ACTIVE' ORDER BY round(CAST(confidence AS DOUBLE) * recency, 9) DESC, id) > 30 THEN 'FORGOTTEN' ELSE status END AS status, round(CAST(confidence AS DOUBLE), 6) AS confidence FROM whole""",
    "forecast_money": with_txn(
        """SELECT user_id, CASE WHEN bank_paise IS NULL THEN 'NEEDS_BALANCE' ELSE 'OK' END AS status, bank_paise, cash_paise, bank_paise + cash_paise AS start_paise, CASE WHEN bank_paise IS NOT NULL THEN fresh END AS fresh FROM (
          SELECT u.user_id, coalesce(g, bank) AS bank_paise, coalesce(cash, 0) AS cash_paise, g IS NOT NULL OR coalesce(b.fresh, false) AS fresh FROM (SELECT user_id FROM live UNION SELECT user_id FROM given) u LEFT JOIN given USING (user_id)
          LEFT JOIN (SELECT user_id, CAST(sum(b + after) AS BIGINT) AS bank, min(t) >= TIMESTAMP '2024-01-25 12:00:00' AS fresh FROM (
            SELECT a.user_id, a.b, a.t, coalesce((SELECT sum(CASE x.direction WHEN 'CREDIT' THEN x.amount_paise ELSE -x.amount_paise END) FROM live x WHERE x.user_id = a.user_id AND x.account_hint = a.account_hint AND x.txn_time > a.t), 0) AS after
            FROM (SELECT user_id, account_hint, arg_max(stated, (txn_time, id)) AS b, max(txn_time) AS t FROM live WHERE stated IS NOT NULL GROUP BY ALL) a) GROUP BY user_id) b USING (user_id)
          LEFT JOIN (SELECT user_id, greatest(0, CAST(sum(CASE WHEN entry_type IN ('ATM_WITHDRAWAL', 'CASH_RECEIVED') THEN amount_paise ELSE -amount_paise END) AS BIGINT)) AS cash FROM cash GROUP BY user_id) USING (user_id))""",
        t.CASH_SQL, LIVE_SQL,
    ),
    "forecast_spending": with_txn(
        f"""SELECT d.user_id, d.day, CAST(isodow(d.day) - 1 AS INTEGER) AS weekday, CAST(coalesce(paise, 0) AS BIGINT) AS paise FROM (
          SELECT user_id, CAST(unnest(generate_series(greatest(min(day), DATE '2024-01-28' - 60), DATE '2024-01-27', INTERVAL 1 DAY)) AS DATE) AS day FROM live WHERE day < DATE '2024-01-28' GROUP BY user_id) d
        LEFT JOIN (SELECT user_id, day, sum(amount_paise) AS paise FROM (
          SELECT user_id, day, amount_paise FROM live WHERE {SPEND} AND direction = 'DEBIT' AND (user_id, id) NOT IN (SELECT (user_id, id) FROM explained)
          UNION ALL SELECT user_id, {CASH_DAY}, amount_paise FROM cash WHERE entry_type = 'CASH_SPEND') GROUP BY ALL) USING (user_id, day)""",
        t.CASH_SQL, LIVE_SQL, repeat_sql(),
    ),
    "forecast_items": with_txn("SELECT user_id, key, amount_paise, next_date, interval_days, category FROM due", LIVE_SQL, repeat_sql()),
    "refresh_due": with_txn("SELECT user_id FROM (SELECT DISTINCT user_id FROM txn) WHERE user_id NOT IN (SELECT user_id FROM old WHERE computed_at > TIMESTAMP '2024-01-28 11:00:00')", OLD_SQL),
    "refresh_moved": with_txn(
        """SELECT user_id, 'n_' || user_id AS id, new AS broke_p50, b AS previous, CAST(coalesce(b, seen + 46) - new AS INTEGER) AS days_earlier FROM (SELECT DISTINCT user_id, DATE '2024-01-29' + CAST(user_id % 30 AS INTEGER) AS new FROM txn WHERE user_id % 7 > 0)
        JOIN (SELECT user_id, broke_p50 AS b, CAST(computed_at AS DATE) AS seen FROM old QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY computed_at DESC, id DESC) = 1) USING (user_id) WHERE coalesce(b, seen + 46) - new >= 3""",
        OLD_SQL,
    ),
}
