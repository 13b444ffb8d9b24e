"""Queries on routing, tasks, tiers of parsing and models' answers."""

from datetime import datetime

from pyspark.sql import functions as F

from spendlake.functions import grounding
from spendlake.functions.ids import NAMESPACE
from spendlake.operators import merging, parsing, routing, tiers, triggers
from spendlake.plans import flows
from spendlake.plans.payments import FORECAST_SQL, MONTH, fake_forecasts, with_txn
from spendlake.sources import tables as t
from spendlake.sources.seeds import seed_rules

SUNDAY = datetime(2024, 1, 28, 6)


def sunday():
    return F.lit(SUNDAY).cast("timestamp_ntz")


def raw_events(s, d):
    """Raw events of five kinds: messages, texts typed by hand, and some that nothing reads."""
    rows = t.transactions(s, d)
    kinds = ["RAW_NOTIFICATION", "MANUAL_TEXT", "RAW_SMS", "WIDGET_TAP", "HEARTBEAT"]
    words = t.pick(["vada pav", "from mom", "atm", "auto 20"], F.col("k") % 4)
    return rows.select(F.concat(F.lit("e_"), "seq").alias("event_id"), "user_id", t.pick(kinds, F.col("seq") % 5).alias("raw_type"), F.concat(F.floor(F.col("amount_paise") / 100) + 1, F.lit(" "), words).alias("text"), F.col("txn_time").alias("posted_at"))


def stored_ledger(s, d):
    """Some cash events are in the ledger already."""
    return routing.ledger(routing.cash_events(raw_events(s, d)).where("amount_paise % 3 = 0"), empty_ledger(s))


def empty_ledger(s):
    return s.createDataFrame([], "id string, user_id bigint, entry_type string, amount_paise bigint, category string, note string, occurred_at timestamp_ntz")


def payments(s, d):
    """Payments as they are after merging."""
    return t.transactions(s, d).withColumn("kind", F.when(F.col("k") % 10 == 0, "ATM_WITHDRAWAL").otherwise(F.col("kind")))


def moved(s, d):
    return triggers.moved_earlier(fake_forecasts(s, d))


def shadowed(s, d):
    """Messages with two tiers' extractions that differ by `k`."""
    rows = t.transactions(s, d)
    rupees = F.format_string("%d.%02d", F.floor(F.col("amount_paise") / 100), F.col("amount_paise") % 100)
    x = lambda wanted, amount: F.struct(wanted.alias("is_transaction"), amount.alias("amount"), F.lit("DEBIT").alias("direction"), F.lit("UPI").alias("channel"), F.lit("SUCCESS").alias("status"), F.lit(None).cast("string").alias("merchant_raw"), F.lit(None).cast("string").alias("counterparty_vpa"), F.lit(None).cast("string").alias("reference_id"), F.lit(None).cast("string").alias("account_hint"), F.lit(None).cast("string").alias("balance_after"), F.lit(None).cast("int").alias("promised_refund_days"))
    k = F.col("k")
    first = F.when(k % 9 > 0, x(k % 4 > 0, rupees))
    second = F.when(k % 6 > 0, x(k % 5 > 0, F.when(k % 7 == 0, "1.01").otherwise(rupees)))
    return rows.select(F.concat(F.lit("e_"), "seq").alias("event_id"), F.concat(F.lit("Rs."), rupees, F.lit(" debited")).alias("text"), first.alias("a"), second.alias("b"))


def model_answers(s, d):
    """What a model may answer: fenced, with camel or snake names, numbers, blanks, unknown values, and broken."""
    rows = t.transactions(s, d)
    rupees = F.format_string("%d.%02d", F.floor(F.col("amount_paise") / 100), F.col("amount_paise") % 100)
    forms = [
        F.concat(F.lit('{"isTransaction": true, "amount": '), rupees, F.lit(', "direction": "DEBIT", "channel": "UPI", "referenceId": '), F.col("seq"), F.lit("}")),
        F.concat(F.lit('```json\n{"is_transaction": true, "amount": "'), rupees, F.lit('", "direction": "CREDIT", "channel": "PIGEON", "merchant_raw": " ", "extra": [1]}\n```')),
        F.lit('{"isTransaction": false}'),
        F.lit('{"isTransaction": true, "direction": "SIDEWAYS"}'),
        F.lit("no idea"),
        F.concat(F.lit('{"isTransaction": true, "status": "PENDING", "merchantRaw": "Café", "promisedRefundDays": '), F.col("k") % 9, F.lit("}")),
        F.lit('{"amount": "5"}'),
    ]
    return rows.select("id", F.element_at(F.array(*forms), (F.col("seq") % 7).cast("int") + 1).alias("answer"))


def flat(x):
    return [x[c].alias(c) for c in ("is_transaction", "amount", "direction", "channel", "status", "merchant_raw", "reference_id", "promised_refund_days")]


def stored_rules(s, d):
    """Rules of senders: every third of them a candidate, every fourth disabled."""
    n = F.col("p_partkey")
    status = F.when(n % 4 == 3, "DISABLED").when(n % 3 == 2, "CANDIDATE").otherwise("ACTIVE")
    return t.table(s, d, "part").select(F.concat(F.lit("r_"), n).alias("id"), F.upper("p_brand").alias("sender_key"), status.alias("status"), (n * 37 % 101).alias("created_at"))


def changelog(s, d):
    """Versions of payments, published again for some."""
    rows = t.transactions(s, d).select(F.col("seq").alias("payment"), F.explode(F.sequence(F.lit(1), (F.col("k") % 3 + 1).cast("int"))).alias("version"))
    return rows.union(rows.where("payment % 4 = 0"))


QUERIES = {
    "event_route": lambda s, d: routing.routed(raw_events(s, d)).groupBy("route").agg(F.count(F.lit(1)).alias("n")),
    "cash_events": lambda s, d: routing.cash_events(raw_events(s, d)),
    "cash_ledger_write": lambda s, d: routing.ledger(routing.cash_events(raw_events(s, d)), stored_ledger(s, d)),
    "undo_latest": lambda s, d: routing.undo_latest(t.cash_ledger(s, d), t.transactions(s, d).where("user_id % 2 = 0").select("user_id"), F.lit(datetime(2024, 1, 20)).cast("timestamp_ntz")).select("id"),
    "atm_cash_events": lambda s, d: routing.atm_events(payments(s, d)),
    "changelog_ids": lambda s, d: routing.changelog_events(changelog(s, d)),
    "payment_ids": lambda s, d: t.messages(s, d).select("event_id", merging.payment_id(F.col("event_id")).alias("payment_id")),
    "agent_tasks": lambda s, d: routing.tasks(t.transactions(s, d), t.budgets(s, d), moved(s, d), sunday()),
    "weekly_review_tasks": lambda s, d: routing.weekly_reviews(t.transactions(s, d).select("user_id"), t.transactions(s, d).where("user_id % 4 = 0").select("user_id", F.lit("weekly:2024-W04").alias("dedupe_key")).distinct(), sunday()),
    "shadow_records": lambda s, d: tiers.shadow_records(shadowed(s, d), "a", "b", 0.3),
    "outcome_counts": lambda s, d: tiers.outcome_counts(parsing.parse(flows.bank_messages(s, d), parsing.rule_table(s, seed_rules()))),
    "answer_decode": lambda s, d: model_answers(s, d).select("id", tiers.decoded(F.col("answer")).alias("x")).select("id", F.col("x").isNotNull().alias("valid"), *flat(F.col("x"))),
    "canonical_json": lambda s, d: model_answers(s, d).select("id", tiers.canonical(tiers.decoded(F.col("answer"))).alias("json")),
    "rules_for_sender": lambda s, d: parsing.rules_for(stored_rules(s, d)),
    "allowed_numbers": lambda s, d: t.transactions(s, d).select("id", F.array_join(F.array_sort(grounding.allowed_values(F.array("amount_paise"), F.array("k"), F.array(F.to_date("txn_time")))).cast("array<string>"), ",").alias("allowed")),
    "sender_samples": lambda s, d: parsing.samples(t.messages(s, d), t.messages(s, d).where("seq % 2 = 0").select("event_id", F.concat(F.lit("t_"), "seq").alias("transaction_id")), t.transactions(s, d).select("id", t.pick(["TEACHER_LLM", "RULE"], F.col("k") % 2).alias("parse_method")), 50).select("sender_key", "event_id", "place"),
}


def uuid5_sql(name: str) -> str:
    h = f"sha1(unhex('{NAMESPACE.replace('-', '')}') || encode({name}))"
    return f"(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || translate(substr({h}, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr({h}, 18, 3) || '-' || substr({h}, 21, 12))"


def hex_sql(name: str) -> str:
    return f"replace({uuid5_sql(name)}, '-', '')"


RAW_SQL = """raw AS (SELECT 'e_' || seq AS event_id, user_id, ['RAW_NOTIFICATION', 'MANUAL_TEXT', 'RAW_SMS', 'WIDGET_TAP', 'HEARTBEAT'][seq % 5 + 1] AS raw_type, (amount_paise // 100 + 1) * 100 AS p, k % 4 AS w, txn_time FROM txn)"""
CASH_EVENT_SQL = f"""event AS (
  SELECT {uuid5_sql("'cash/' || event_id")} AS event_id, user_id, event_id AS causation_id, txn_time AS occurred_at, ['CASH_SPEND', 'CASH_RECEIVED', 'ATM_WITHDRAWAL'][w + 1] AS entry_type, p AS amount_paise,
    CASE WHEN w = 0 THEN 'DINING_OUT' END AS category, ['vada pav', 'from mom', 'atm'][w + 1] AS note FROM raw WHERE raw_type IN ('MANUAL_TEXT', 'WIDGET_TAP') AND w < 3)"""
#: Fields of the two tiers and what the checks find: amounts other than the text's and answers that are no payment.
SHADOW_SQL = """tier AS (SELECT 'e_' || seq AS event_id, k % 9 > 0 AS has_a, k % 4 > 0 AS pay_a, k % 6 > 0 AS has_b, k % 5 > 0 AS pay_b, k % 7 = 0 AND amount_paise <> 101 AS other_b FROM txn)"""
ANSWER_SQL = """answer AS (SELECT id, seq % 7 AS f, seq, k, (amount_paise // 100) || '.' || lpad(CAST(amount_paise % 100 AS VARCHAR), 2, '0') AS r FROM txn),
x AS (SELECT id, f IN (0, 1, 2, 5) AS valid, CASE WHEN f IN (0, 1, 5) THEN true WHEN f = 2 THEN false END AS is_transaction, CASE f WHEN 0 THEN rtrim(rtrim(r, '0'), '.') WHEN 1 THEN r END AS amount, CASE f WHEN 0 THEN 'DEBIT' WHEN 1 THEN 'CREDIT' END AS direction,
  CASE WHEN f = 0 THEN 'UPI' WHEN f IN (1, 2, 5) THEN 'UNKNOWN' END AS channel, CASE WHEN f IN (0, 1, 2) THEN 'SUCCESS' WHEN f = 5 THEN 'PENDING' END AS status, CASE WHEN f = 5 THEN 'Café' END AS merchant_raw, CASE WHEN f = 0 THEN CAST(seq AS VARCHAR) END AS reference_id, CASE WHEN f = 5 THEN CAST(k % 9 AS INTEGER) END AS promised_refund_days FROM answer)"""
TEXT = "coalesce('\"' || {0} || '\"', 'null')"


ORACLE_SQL = {
    "event_route": with_txn("SELECT CASE WHEN raw_type LIKE 'RAW%' THEN 'PARSER' WHEN raw_type = 'HEARTBEAT' THEN 'SKIPPED' ELSE 'CASH' END AS route, count(*) AS n FROM raw GROUP BY ALL", RAW_SQL),
    "cash_events": with_txn("SELECT * FROM event", RAW_SQL, CASH_EVENT_SQL),
    "cash_ledger_write": with_txn(f"SELECT 'c_' || {hex_sql(chr(39) + 'cash/' + chr(39) + ' || event_id')} AS id, user_id, entry_type, amount_paise, category, note, occurred_at FROM event", RAW_SQL, CASH_EVENT_SQL),
    "undo_latest": with_txn("SELECT id FROM cash WHERE id NOT IN (SELECT arg_max(id, (occurred_at, id)) FROM cash WHERE user_id % 2 = 0 AND occurred_at >= TIMESTAMP '2024-01-19' GROUP BY user_id)", t.CASH_SQL),
    "atm_cash_events": with_txn(f"SELECT {uuid5_sql(chr(39) + 'atm/' + chr(39) + ' || id')} AS event_id, user_id, 'ATM_WITHDRAWAL' AS entry_type, amount_paise, txn_time AS occurred_at, id AS related_transaction_id FROM txn WHERE k % 10 = 0 AND status = 'SUCCESS'"),
    "changelog_ids": with_txn(f"SELECT seq AS payment, v AS version, {uuid5_sql(chr(39) + 'clean/' + chr(39) + ' || seq || ' + chr(39) + '/' + chr(39) + ' || v')} AS event_id FROM (SELECT seq, CAST(unnest(range(1, k % 3 + 2)) AS INTEGER) AS v FROM txn)"),
    "payment_ids": with_txn(f"SELECT event_id, 't_' || {hex_sql(chr(39) + 'txn/' + chr(39) + ' || event_id')} AS payment_id FROM message", t.MESSAGE_SQL),
    "agent_tasks": with_txn(
        f"""SELECT 'at_' || {hex_sql("'task/' || user_id || '/' || dedupe_key")} AS task_id, user_id, r[1] AS trigger, r[2] AS goal, dedupe_key, r[3] AS priority, TIMESTAMP '2024-01-28 08:00:00' AS deadline FROM (
          SELECT user_id, dedupe_key, min((trigger, goal, priority)) AS r FROM (
            SELECT user_id, 'BUDGET' AS trigger, category || ' budget ' || c || '% used' AS goal, 'budget:' || category || ':' || strftime(month, '%Y-%m') || ':' || c AS dedupe_key, 'HIGH' AS priority FROM (
              SELECT *, CASE WHEN b < 100 * l AND 100 * l <= a THEN 100 WHEN b < 80 * l AND 80 * l <= a THEN 80 END AS c FROM (SELECT *, after * 100 AS a, (after - amount_paise) * 100 AS b, monthly_limit_paise AS l FROM (
                SELECT *, CAST(sum(amount_paise) OVER (PARTITION BY user_id, category, month ORDER BY txn_time RANGE UNBOUNDED PRECEDING) AS BIGINT) AS after FROM (SELECT *, {MONTH} AS month FROM txn WHERE kind = 'SPEND' AND status = 'SUCCESS') JOIN budget USING (user_id, category)))) WHERE c IS NOT NULL
            UNION ALL SELECT user_id, 'FREQUENCY', 'Frequent spending at ' || merchant_raw, 'freq:' || merchant_raw || ':' || isoyear(txn_time + INTERVAL 330 MINUTE) || '-W' || lpad(CAST(weekofyear(txn_time + INTERVAL 330 MINUTE) AS VARCHAR), 2, '0'), 'NORMAL' FROM (
              SELECT *, count(*) OVER (PARTITION BY user_id, merchant_raw ORDER BY txn_time RANGE BETWEEN INTERVAL '6 days 23:59:59.999999' PRECEDING AND CURRENT ROW) AS n FROM txn WHERE kind = 'SPEND' AND status = 'SUCCESS' AND NOT regexp_matches(merchant_raw, '(?i)^p[0-9a-f]{{8}}@[a-z0-9]+$')) WHERE n >= 3
            UNION ALL SELECT user_id, 'BROKE_DATE_MOVED', 'Broke date moved ' || e || ' days earlier, to around ' || broke_p50, 'broke:' || broke_p50, 'HIGH' FROM (SELECT *, lag(broke_p50) OVER (PARTITION BY user_id ORDER BY computed_at, id) - broke_p50 AS e FROM fc) WHERE e >= 3) GROUP BY ALL)""",
        t.BUDGET_SQL, FORECAST_SQL,
    ),
    "weekly_review_tasks": with_txn(f"SELECT 'at_' || {hex_sql(chr(39) + 'task/' + chr(39) + ' || user_id || ' + chr(39) + '/weekly:2024-W04' + chr(39))} AS task_id, user_id, 'WEEKLY_REVIEW' AS trigger, 'Weekly review for week 2024-W04' AS goal, 'weekly:2024-W04' AS dedupe_key, 'LOW' AS priority, TIMESTAMP '2024-01-28 12:00:00' AS deadline FROM (SELECT DISTINCT user_id FROM txn) WHERE user_id % 4 > 0"),
    "shadow_records": with_txn(
        f"""SELECT {uuid5_sql("'shadow/' || event_id")} AS id, event_id AS raw_event_id, CASE WHEN NOT has_a THEN 'FAILED' WHEN pay_a THEN 'TRANSACTION' ELSE 'NOT_TRANSACTION' END AS "first",
          CASE WHEN NOT has_b THEN 'FAILED' WHEN NOT pay_b THEN 'NOT_TRANSACTION' WHEN other_b THEN 'FAILED' ELSE 'TRANSACTION' END AS second,
          CASE WHEN NOT has_a OR NOT has_b THEN has_a = has_b WHEN NOT pay_a OR NOT pay_b THEN pay_a = pay_b ELSE NOT other_b END AS agreement
        FROM tier WHERE CAST('0x' || substr(sha256(event_id), 1, 8) AS BIGINT) % 10000 < 3000""",
        SHADOW_SQL,
    ),
    "outcome_counts": f"SELECT outcome, CASE outcome WHEN 'PARSED' THEN 'RULE' WHEN 'NOT_TRANSACTION' THEN NULL ELSE reason END AS detail, count(*) AS n FROM ({flows.ORACLE_SQL['rule_extract']}) GROUP BY ALL",
    "answer_decode": with_txn("SELECT * FROM x", ANSWER_SQL),
    "canonical_json": with_txn(
        "SELECT id, CASE WHEN valid THEN '{\"isTransaction\":' || is_transaction || ',\"amount\":' || " + TEXT.format("amount") + " || ',\"direction\":' || " + TEXT.format("direction") + " || ',\"channel\":\"' || channel || '\",\"status\":\"' || status || '\",\"merchantRaw\":' || " + TEXT.format("merchant_raw")
        + " || ',\"counterpartyVpa\":null,\"referenceId\":' || " + TEXT.format("reference_id") + " || ',\"accountHint\":null,\"balanceAfter\":null,\"promisedRefundDays\":' || coalesce(CAST(promised_refund_days AS VARCHAR), 'null') || '}' END AS json FROM x",
        ANSWER_SQL,
    ),
    "rules_for_sender": """SELECT sender_key, rule_id, status, row_number() OVER (PARTITION BY sender_key ORDER BY status, created_at, rule_id) AS place FROM (
        SELECT upper(p_brand) AS sender_key, 'r_' || p_partkey AS rule_id, CASE WHEN p_partkey % 4 = 3 THEN 'DISABLED' WHEN p_partkey % 3 = 2 THEN 'CANDIDATE' ELSE 'ACTIVE' END AS status, p_partkey * 37 % 101 AS created_at FROM part)
        WHERE status <> 'DISABLED'""",
    "allowed_numbers": with_txn(
        """SELECT id, array_to_string(list_transform(list_sort(list_distinct([CAST(amount_paise / 100.0 AS DECIMAL(30, 4)), CAST(round_even(CAST(amount_paise AS DOUBLE) / 100, 0) AS DECIMAL(30, 4)), CAST(k AS DECIMAL(30, 4)), CAST(day(txn_time) AS DECIMAL(30, 4)), CAST(month(txn_time) AS DECIMAL(30, 4)), CAST(year(txn_time) AS DECIMAL(30, 4))])), lambda v: CAST(v AS VARCHAR)), ',') AS allowed FROM txn"""
    ),
    "sender_samples": with_txn(
        "SELECT key AS sender_key, event_id, row_number() OVER (PARTITION BY key ORDER BY posted_at DESC, event_id) AS place FROM (SELECT *, upper(regexp_extract(trim(sender), '[^-]*$')) AS key FROM message WHERE seq % 2 = 0 AND k % 2 = 0) QUALIFY place <= 50", t.MESSAGE_SQL
    ),
}
