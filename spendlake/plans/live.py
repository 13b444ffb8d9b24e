"""Queries on what streams do: reports merged live, and watches for what didn't come."""

import uuid
from datetime import datetime

from pyspark.sql import Observation
from pyspark.sql import functions as F

from spendlake.operators import analyst, cash, induction, merging, parsing, plugins, tiers, watches
from spendlake.plans import flows
from spendlake.plans.payments import fake_forecasts, with_txn
from spendlake.sources import tables as t
from spendlake.streaming import merging as live

UNTIL = datetime(2024, 1, 28)
DAYS = lambda n: F.make_dt_interval(n.cast("int"))


def refund_payments(s, d):
    """Payments that fail, hang or promise a refund by their event; money back for half of those, by reference or amount, in time or late; and compensation for some."""
    rows = t.transactions(s, d)
    k = F.col("k")
    base = rows.select(
        "id", "user_id", "amount_paise", "direction",
        F.when((F.col("direction") == "CREDIT") & (k % 5 == 0), "REFUND_INITIATED").when(F.col("status") == "FAILED", "FAILED").when(k % 9 == 0, "PENDING").otherwise("SUCCESS").alias("status"),
        F.when(k % 10 == 0, "CARD").otherwise("UPI").alias("channel"), "merchant_raw", F.when(k % 7 > 0, F.concat(F.lit("R"), "seq")).alias("reference_id"), F.when(k % 7 < 3, k % 7).cast("int").alias("promised_refund_days"), "txn_time", "k",
    )
    broken = base.where("status <> 'SUCCESS'").withColumn("direction", F.lit("CREDIT")).withColumn("status", F.lit("SUCCESS"))
    by_reference = broken.where("k % 4 = 0").withColumn("id", F.concat(F.lit("r"), "id")).withColumn("amount_paise", F.col("amount_paise") + 1).withColumn("txn_time", F.col("txn_time") + DAYS(k % 9))
    by_amount = broken.where("k % 4 = 1").withColumn("id", F.concat(F.lit("a"), "id")).withColumn("reference_id", F.lit(None).cast("string")).withColumn("txn_time", F.col("txn_time") + DAYS(k % 40))
    extra = broken.where("k % 8 = 0").withColumn("id", F.concat(F.lit("x"), "id")).withColumn("reference_id", F.lit("")).withColumn("amount_paise", (F.lit(10_000) * (1 + k % 4)).cast("long")).withColumn("txn_time", F.col("txn_time") + DAYS(k % 9 + k % 10))
    return base.union(by_reference).union(by_amount).union(extra).drop("k")


REFUND_SQL = """pay0 AS (
  SELECT id, user_id, amount_paise, direction, CASE WHEN direction = 'CREDIT' AND k % 5 = 0 THEN 'REFUND_INITIATED' WHEN status = 'FAILED' THEN 'FAILED' WHEN k % 9 = 0 THEN 'PENDING' ELSE 'SUCCESS' END AS status,
    CASE WHEN k % 10 = 0 THEN 'CARD' ELSE 'UPI' END AS channel, merchant_raw, CASE WHEN k % 7 > 0 THEN 'R' || seq END AS reference_id, CASE WHEN k % 7 < 3 THEN k % 7 END AS promised, txn_time, k FROM txn),
pay AS (
  SELECT id, user_id, amount_paise, direction, status, channel, merchant_raw, reference_id, promised, txn_time FROM pay0
  UNION ALL SELECT 'r' || id, user_id, amount_paise + 1, 'CREDIT', 'SUCCESS', channel, merchant_raw, reference_id, promised, txn_time + to_days(CAST(k % 9 AS INTEGER)) FROM pay0 WHERE status <> 'SUCCESS' AND k % 4 = 0
  UNION ALL SELECT 'a' || id, user_id, amount_paise, 'CREDIT', 'SUCCESS', channel, merchant_raw, NULL, promised, txn_time + to_days(CAST(k % 40 AS INTEGER)) FROM pay0 WHERE status <> 'SUCCESS' AND k % 4 = 1
  UNION ALL SELECT 'x' || id, user_id, 10000 * (1 + k % 4), 'CREDIT', 'SUCCESS', channel, merchant_raw, '', promised, txn_time + to_days(CAST(k % 9 + k % 10 AS INTEGER)) FROM pay0 WHERE status <> 'SUCCESS' AND k % 8 = 0),
known AS (SELECT * FROM pay WHERE txn_time <= TIMESTAMP '2024-01-28'),
came AS (SELECT user_id, amount_paise, reference_id, txn_time AS came_at FROM known WHERE direction = 'CREDIT' AND status = 'SUCCESS'),
opened AS (
  SELECT *, CASE WHEN direction = 'DEBIT' AND channel = 'UPI' AND status IN ('FAILED', 'PENDING') THEN CASE WHEN regexp_matches(trim(merchant_raw), '(?i)^p[0-9a-f]{8}@[a-z0-9]+$') THEN 'UPI_P2P_FAILED' ELSE 'UPI_P2M_FAILED' END WHEN status = 'REFUND_INITIATED' THEN 'ECOM_REFUND' END AS case_type
  FROM known),
kase AS (
  SELECT id, user_id, case_type, amount_paise, reference_id, txn_time AS opened_at, CAST(CASE case_type WHEN 'ECOM_REFUND' THEN 0 ELSE 10000 END AS BIGINT) AS per_day_paise,
    txn_time + to_days(CAST(CASE case_type WHEN 'UPI_P2P_FAILED' THEN 1 WHEN 'UPI_P2M_FAILED' THEN 5 ELSE coalesce(promised, 7) END AS INTEGER)) AS deadline_at
  FROM opened WHERE case_type IS NOT NULL),
paid AS (
  SELECT k.*, (SELECT min(came_at) FROM came c WHERE c.user_id = k.user_id AND c.came_at >= opened_at AND (c.amount_paise = k.amount_paise AND c.came_at <= opened_at + INTERVAL 30 DAY OR c.reference_id = k.reference_id AND k.reference_id <> '' AND c.came_at <= opened_at + INTERVAL 90 DAY)) AS paid_at
  FROM kase k),
owed AS (
  SELECT *, coalesce(greatest(0, CAST(ceil((epoch_us(paid_at) - epoch_us(deadline_at)) / 86400000000.0) AS INTEGER)), 0) AS days_late FROM paid),
settled AS (
  SELECT o.*, days_late * per_day_paise AS owed_paise, (SELECT min(came_at) FROM came c WHERE c.user_id = o.user_id AND days_late * per_day_paise > 0 AND c.amount_paise = days_late * per_day_paise AND c.came_at >= paid_at AND c.came_at <= paid_at + INTERVAL 7 DAY) AS compensated_at
  FROM owed o)"""

QUERIES = {
    "missing_cash": lambda s, d: watches.missing_cash(t.cash_ledger(s, d), F.lit(UNTIL).cast("timestamp_ntz")),
    "refund_states": lambda s, d: watches.refund_states(refund_payments(s, d), F.lit(UNTIL).cast("timestamp_ntz")),
}


def dedup_stream(s, d):
    """The payments that a stream of the events' reports has come to; its state and changelog lie in the shared folder."""
    from spendlake.sources.scratch import shared_dir

    base = f"{shared_dir(s)}/stream-{uuid.uuid4().hex}"
    flows.reports(s, d).write.parquet(f"{base}/in")
    schema = s.read.parquet(f"{base}/in").schema
    live.merge(s.readStream.schema(schema).parquet(f"{base}/in"), f"{base}/out", f"{base}/check").awaitTermination()
    return merging.latest(s.read.parquet(f"{base}/out")).select("payment", "version", "kind", "status", "category", "reference_id", "account_hint")


def taught_messages(s, d):
    """Bank messages with what a teacher read in them."""
    rows = flows.bank_messages(s, d).join(t.transactions(s, d).select("seq", "k", "amount_paise", F.col("merchant_raw").alias("payee")), "seq")
    n, rupees = F.col("seq") % 3, F.format_string("%d.%02d", F.floor(F.col("amount_paise") / 100), F.col("amount_paise") % 100)
    vpa, name = F.concat(F.regexp_replace("payee", "[^A-Za-z0-9]", ""), F.lit("@upi")), F.trim(F.regexp_replace("payee", "[^A-Za-z0-9 ]", ""))
    truth = F.struct(
        F.lit(True).alias("is_transaction"), rupees.alias("amount"), F.when(n == 1, "CREDIT").otherwise("DEBIT").alias("direction"), t.pick(["UPI", "NETBANKING", "CARD"], n).alias("channel"), F.lit("SUCCESS").alias("status"),
        F.when(n == 0, vpa).otherwise(name).alias("merchant_raw"), F.when(n == 0, vpa).alias("counterparty_vpa"), F.when(n == 0, F.lpad(F.col("seq").cast("string"), 12, "7")).alias("reference_id"),
        F.lpad(F.col("k").cast("string"), 4, "0").alias("account_hint"), F.when(n == 1, (F.col("seq") * 10).cast("string")).alias("balance_after"), F.lit(None).cast("int").alias("promised_refund_days"),
    )
    return rows.select("event_id", "user_id", "sender", "source_app", "text", "posted_at", "seq", truth.alias("truth"))


def rules_learnt(s, d):
    """What rules learnt from every second message read in the others, banks that no seed rule knows among them."""
    rows = taught_messages(s, d)
    rules = induction.learnt(rows.where("seq % 2 = 0"), status="ACTIVE")
    read = parsing.parse(rows.where("seq % 2 = 1").drop("truth"), rules)
    return read.select("event_id", "outcome", "amount_paise", "direction", "channel", "merchant_raw", "reference_id", "account_hint", "balance_after_paise")


def rule_attempts(s, d):
    """Attempts at a rule for each sender and wording, one for each message; those that are far enough apart are ready."""
    rows = taught_messages(s, d).select(F.concat_ws("|", F.element_at(F.split("sender", "-"), -1), (F.col("seq") % 3).cast("string")).alias("template"), F.col("posted_at").alias("at"), "event_id")
    return induction.cooled(rows).where("ready").drop("ready")


STATEMENT = """WITH monthly AS (
  SELECT user_id, coalesce(merchant, 'unknown') AS merchant, date_trunc('MONTH', txn_time_ist) AS month, sum(amount_rupees) AS total_rupees, count(*) AS n
  FROM v_transactions WHERE status = 'SUCCESS' AND direction = 'DEBIT' AND category IN (SELECT category FROM v_budgets) GROUP BY ALL)
SELECT user_id, merchant, CAST(month AS DATE) AS month, total_rupees, n, rank() OVER (PARTITION BY user_id ORDER BY total_rupees DESC) AS place FROM monthly ORDER BY user_id, merchant, month"""


def analysts_views(s, d):
    merchants = t.table(s, d, "supplier").where("s_suppkey % 3 > 0").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return analyst.views(t.transactions(s, d).withColumn("merchant_id", F.col("k") + 1), merchants, t.cash_ledger(s, d), t.budgets(s, d), fake_forecasts(s, d))


def tool_calls(s, d):
    """Every user's cash balance as an agent with a grant gets it from a tool, and one without gets none."""
    ledger = t.cash_ledger(s, d)
    analyst.register_tools(s, {"cash_balance": cash.balances(ledger)}, analyst.grants(s))
    ledger.select("user_id").distinct().createOrReplaceTempView("tool_callers")
    calls = [f"SELECT '{agent}' AS agent, b.* FROM tool_callers c, LATERAL cash_balance('{agent}', c.user_id) b" for agent in ("coach", "refund_advocate")]
    return s.sql(" UNION ALL ".join(calls))


def reader():
    """A stand-in for a model: reads amounts of messages, and fails on every seventh reference or number at a message's end."""
    import re

    names = [f.split(":")[0].strip() for f in parsing.EXTRACTION[7:-1].split(",")]

    def ask(texts):
        out = []
        for text in texts:
            if int(re.findall(r"\d+", text)[-1]) % 7 == 0:
                raise RuntimeError("out of order")
            amount = re.search(r"(?:Rs\.|INR )([\d.]+\d)", text).group(1)
            out.append(dict.fromkeys(names) | {"is_transaction": True, "amount": amount, "direction": "CREDIT" if "credited" in text else "DEBIT"})
        return out

    return ask


def parse_plugins(s, d):
    """Bank messages by rules, and by a model where no rule is; the model fails on some."""
    read = plugins.parse(flows.bank_messages(s, d), parsing.rule_table(s, flows.seed_rules()), {"SERVER_MODEL": reader})
    return read.select("event_id", "outcome", "reason", "parse_method", "amount_paise", "direction")


def topic_round_trip(s, d):
    """Payments through a topic keyed by user: each as it is read back, and its place among its user's records."""
    from pyspark.sql import Window

    from spendlake.sources import topics
    from spendlake.sources.scratch import shared_dir

    topics.register(s)
    path = f"{shared_dir(s)}/topic-{uuid.uuid4().hex}"
    topics.publish(t.transactions(s, d).select("user_id", "seq", "amount_paise", "merchant_raw"), path, "user_id", "seq")
    body = F.from_json("value", "user_id long, seq long, amount_paise long, merchant_raw string")
    rows = s.read.format("topic").load(path).select("key", "partition", "offset", body.alias("b"))
    place = F.row_number().over(Window.partitionBy("key").orderBy("partition", "offset"))
    return rows.select(F.col("b.seq").alias("seq"), F.col("b.user_id").alias("user_id"), F.col("b.amount_paise").alias("amount_paise"), F.col("b.merchant_raw").alias("merchant_raw"), place.alias("place"))


def observed_outcomes(s, d):
    """Outcomes of messages, counted while the parsed messages were written."""
    from spendlake.sources.scratch import shared_dir

    seen = Observation()
    parsed = parsing.parse(t.messages(s, d), parsing.rule_table(s, flows.seed_rules()))
    tiers.observed(parsed, seen).write.parquet(f"{shared_dir(s)}/parsed-{uuid.uuid4().hex}")
    return s.createDataFrame([(*k, n) for k, n in tiers.counted(seen.get).items()], "outcome string, detail string, n long")


QUERIES |= {"observed_outcomes": observed_outcomes, "parse_plugins": parse_plugins, "topic_round_trip": topic_round_trip}
QUERIES |= {"analyst_sql": lambda s, d: analyst.run(s, STATEMENT, analysts_views(s, d), most=1 << 30), "tool_calls": tool_calls}
QUERIES |= {"dedup_stream": dedup_stream, "rules_learnt": rules_learnt, "rule_attempts": rule_attempts}

ORACLE_SQL = {
    "observed_outcomes": with_txn(
        """SELECT CASE WHEN f IN (2, 3, 4, 5, 7) THEN 'DROPPED' ELSE 'FAILED' END AS outcome, CASE f WHEN 2 THEN 'OTP' WHEN 3 THEN 'PROMO' WHEN 4 THEN 'BALANCE_ONLY' WHEN 5 THEN 'COLLECT_REQUEST' WHEN 7 THEN 'NO_AMOUNT' ELSE 'NO_TIER' END AS detail, count(*) AS n
        FROM (SELECT seq % 8 AS f FROM txn) GROUP BY ALL"""
    ),
    "topic_round_trip": with_txn("SELECT seq, user_id, amount_paise, merchant_raw, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS place FROM txn"),
    "parse_plugins": with_txn(
        """SELECT event_id, CASE WHEN known OR read THEN 'PARSED' ELSE 'FAILED' END AS outcome, CASE WHEN NOT known AND NOT read THEN 'RUNTIMEERROR' END AS reason, CASE WHEN known THEN 'RULE' WHEN read THEN 'SERVER_MODEL' END AS parse_method,
          CASE WHEN known OR read THEN amount_paise END AS amount_paise, CASE WHEN known OR read THEN ['DEBIT', 'CREDIT', 'DEBIT'][seq % 3 + 1] END AS direction
        FROM (SELECT *, CASE seq % 3 WHEN 0 THEN CAST(ref AS BIGINT) WHEN 1 THEN seq * 10 ELSE 5 END % 7 > 0 AS read FROM bank)""",
        flows.BANK_SQL,
    ),
    "analyst_sql": with_txn(
        f""", v_transactions AS (SELECT id, user_id, txn_time + INTERVAL 330 MINUTE AS txn_time_ist, CAST(amount_paise / 100 AS DECIMAL(12, 2)) AS amount_rupees, direction, status, category,
          (SELECT min(s_name) FROM supplier WHERE s_suppkey = k + 1 AND s_suppkey % 3 > 0) AS merchant FROM txn), v_budgets AS (SELECT * FROM budget) {STATEMENT.replace("WITH monthly", ", monthly")}""",
        t.BUDGET_SQL,
    ).replace(" ,", ","),
    "tool_calls": with_txn(
        """SELECT 'coach' AS agent, user_id, balance_paise, greatest(0, balance_paise) AS in_hand_paise, greatest(0, -balance_paise) AS over_logged_paise FROM (
        SELECT user_id, CAST(sum(CASE WHEN entry_type IN ('ATM_WITHDRAWAL', 'CASH_RECEIVED') THEN amount_paise ELSE -amount_paise END) AS BIGINT) AS balance_paise FROM cash GROUP BY user_id)""",
        t.CASH_SQL,
    ),
    "rules_learnt": with_txn(
        """, keyed AS (SELECT *, CASE WHEN known THEN 'own' ELSE 'NOBANK' END AS sender_key FROM bank),
        taught AS (SELECT DISTINCT sender_key, f FROM (SELECT sender_key, seq % 3 AS f FROM keyed WHERE seq % 2 = 0 GROUP BY user_id, sender_key, seq % 3, CASE WHEN seq % 3 > 0 THEN name END HAVING count(*) > 1))
        SELECT event_id, CASE WHEN ok THEN 'PARSED' ELSE 'FAILED' END AS outcome, CASE WHEN ok THEN amount_paise END AS amount_paise, CASE WHEN ok THEN CASE f WHEN 1 THEN 'CREDIT' ELSE 'DEBIT' END END AS direction,
          CASE WHEN ok THEN ['UPI', 'NETBANKING', 'CARD'][f + 1] ELSE 'UNKNOWN' END AS channel, CASE WHEN ok THEN CASE f WHEN 0 THEN vpa || '@upi' ELSE trim(name) END END AS merchant_raw,
          CASE WHEN ok AND f = 0 THEN ref END AS reference_id, CASE WHEN ok THEN acct END AS account_hint, CASE WHEN ok AND f = 1 THEN seq * 1000 END AS balance_after_paise
        FROM (SELECT k.*, k.seq % 3 AS f, t.f IS NOT NULL AS ok FROM keyed k LEFT JOIN taught t ON t.sender_key = k.sender_key AND t.f = k.seq % 3 WHERE k.seq % 2 = 1)""",
        flows.BANK_SQL,
    ).replace(" ,", ","),
    "rule_attempts": """WITH RECURSIVE keyed AS (
      SELECT CASE WHEN event_id % 11 = 0 THEN 'NOBANK' ELSE ['HDFCBK', 'SBIINB', 'ICICIT'][event_id % 3 + 1] END || '|' || event_id % 3 AS template, ts AS at_, 'e_' || event_id AS event_id FROM events),
    ready AS (
      SELECT template, min(at_) AS at_ FROM keyed GROUP BY template
      UNION ALL SELECT r.template, min(k.at_) FROM ready r JOIN keyed k ON k.template = r.template AND k.at_ >= r.at_ + INTERVAL 6 HOUR GROUP BY r.template)
    SELECT template, at_ AS "at", event_id FROM ready JOIN keyed USING (template, at_)""",
    "missing_cash": with_txn(
        """SELECT id, user_id, amount_paise, logged_paise, occurred_at + INTERVAL 72 HOUR AS due_at FROM (
        SELECT *, CAST(coalesce(sum(CASE WHEN entry_type IN ('CASH_SPEND', 'UNACCOUNTED') THEN amount_paise END) OVER (PARTITION BY user_id ORDER BY occurred_at RANGE BETWEEN CURRENT ROW AND INTERVAL 72 HOUR FOLLOWING), 0) AS BIGINT) AS logged_paise FROM cash)
        WHERE entry_type = 'ATM_WITHDRAWAL' AND logged_paise * 100 < amount_paise * 60 AND occurred_at + INTERVAL 72 HOUR <= TIMESTAMP '2024-01-28'""",
        t.CASH_SQL,
    ),
    "refund_states": with_txn(
        """SELECT id, user_id, case_type, amount_paise, reference_id, opened_at, deadline_at, per_day_paise, paid_at, days_late, owed_paise, compensated_at,
          CASE WHEN paid_at IS NULL THEN CASE WHEN TIMESTAMP '2024-01-28' <= deadline_at THEN 'WAITING' WHEN TIMESTAMP '2024-01-28' <= deadline_at + INTERVAL 30 DAY THEN 'OVERDUE' ELSE 'ESCALATION_DRAFTED' END
            WHEN days_late = 0 THEN 'REVERSED_ON_TIME' WHEN compensated_at IS NOT NULL THEN 'COMPENSATED' WHEN owed_paise > 0 AND TIMESTAMP '2024-01-28' > paid_at + INTERVAL 7 DAY THEN 'COMPENSATION_DRAFTED' ELSE 'REVERSED_LATE' END AS state
        FROM settled""",
        REFUND_SQL,
    ),
}
