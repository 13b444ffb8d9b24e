"""Queries on parsing, merchants, merging of reports, policy and uploads."""

from pyspark.sql import functions as F

from spendlake.functions import grounding
from spendlake.functions.categories import ROASTABLE
from spendlake.functions.text import STOP_WORDS
from spendlake.operators import ingest, merchants, merging, parsing, policy
from spendlake.plans.payments import END, with_txn
from spendlake.sources import tables as t
from spendlake.sources.seeds import seed_rules

MERCHANTS = [("m_swiggy", "Swiggy Stores", "FOOD_DELIVERY", ["swiggy"]), ("m_zomato", "Zomato", "FOOD_DELIVERY", []), ("m_rebel", "Rebel Foods", "FOOD_DELIVERY", ["faasos"]), ("m_hm", "H&M", "SHOPPING", []), ("m_basket", "BigBasket", "GROCERIES", ["big basket"]), ("m_amazon", "Amazon", "SHOPPING", ["amazon pay"])]
STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def key_sql(raw: str) -> str:
    return f"array_to_string(list_filter(regexp_split_to_array(replace(split_part(lower(trim({raw})), '@', 1), '&', ' & '), '[^a-z&]+'), lambda w: w <> '' AND w NOT IN ({STOP})), ' ')"


def merchant_table(s):
    return s.createDataFrame(MERCHANTS, "id string, name string, category string, aliases array<string>")


def override_table(s, d):
    """Every tenth user calls coffee a subscription."""
    rows = t.transactions(s, d).where("user_id % 10 = 0").select("user_id").distinct()
    return rows.select("user_id", F.lit("coffee").alias("alias"), F.lit(None).cast("string").alias("merchant_id"), F.lit("My Coffee").alias("name"), F.lit("SUBSCRIPTIONS").alias("category"))


ALIAS_VALUES = ", ".join(f"('{m[0]}', '{m[1]}', '{m[2]}', '{a}')" for m in MERCHANTS for a in [m[1], *m[3]])
GRAMS = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
ALIAS_SQL = f"""alias AS (SELECT alias, min((id, name, category)) AS m FROM (SELECT id, name, category, {key_sql('raw')} AS alias FROM (VALUES {ALIAS_VALUES}) v(id, name, category, raw)) WHERE alias <> '' GROUP BY alias),
payee AS (SELECT DISTINCT merchant_raw, {key_sql('merchant_raw')} AS key, regexp_matches(trim(merchant_raw), '(?i)^p[0-9a-f]{{8}}@[a-z0-9]+$') AS person FROM txn),
near AS (
  SELECT key, alias, m, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) AS similarity
  FROM (SELECT DISTINCT key, {GRAMS.format(x='key')} AS a FROM payee), (SELECT alias, m, {GRAMS.format(x='alias')} AS b FROM alias)),
best AS (SELECT * FROM near WHERE similarity >= 0.6 QUALIFY row_number() OVER (PARTITION BY key ORDER BY similarity DESC, alias) = 1)"""


def bank_messages(s, d):
    """A message in one of three banks' wordings for each payment; every ninth names a balance that isn't there, every eleventh has no sender that rules know."""
    rows = t.transactions(s, d)
    rupees = F.format_string("%d.%02d", F.floor(F.col("amount_paise") / 100), F.col("amount_paise") % 100)
    ref, acct, name = F.lpad(F.col("seq").cast("string"), 12, "7"), F.lpad(F.col("k").cast("string"), 4, "0"), F.regexp_replace("merchant_raw", "[^A-Za-z0-9 ]", "")
    words = [
        F.concat(F.lit("Rs."), rupees, F.lit(" debited from A/c XX"), acct, F.lit(" on 03-10 to VPA "), F.regexp_replace("merchant_raw", "[^A-Za-z0-9]", ""), F.lit("@upi. UPI Ref "), ref),
        F.concat(F.lit("A/c XX"), acct, F.lit(" is credited with Rs."), rupees, F.lit(" on 03Oct by NEFT from "), name, F.lit(". Avl Bal Rs."), F.col("seq") * 10),
        F.concat(F.lit("INR "), rupees, F.lit(" spent on ICICI Bank Card XX"), acct, F.lit(" on 03-Oct at "), name, F.lit(". Avl Limit INR 5")),
    ]
    sender = F.when(F.col("seq") % 11 == 0, "VK-NOBANK").otherwise(t.pick(["AX-HDFCBK", "VM-SBIINB", "JD-ICICIT"], F.col("seq") % 3))
    return rows.select(F.concat(F.lit("e_"), "seq").alias("event_id"), "user_id", sender.alias("sender"), F.lit(None).cast("string").alias("source_app"), F.element_at(F.array(*words), (F.col("seq") % 3).cast("int") + 1).alias("text"), F.col("txn_time").alias("posted_at"), "seq")


BANK_SQL = r"""bank AS (SELECT 'e_' || seq AS event_id, user_id, seq, k, amount_paise, (amount_paise // 100) || '.' || lpad(CAST(amount_paise % 100 AS VARCHAR), 2, '0') AS r, lpad(CAST(k AS VARCHAR), 4, '0') AS acct, lpad(CAST(seq AS VARCHAR), 12, '7') AS ref,
  regexp_replace(merchant_raw, '[^A-Za-z0-9]', '', 'g') AS vpa, regexp_replace(merchant_raw, '[^A-Za-z0-9 ]', '', 'g') AS name, seq % 11 > 0 AS known FROM txn)"""


def upload_table(s, d):
    """Uploads: each event once, every eighth again, every seventh of them as another user's; some against the rules."""
    rows = t.transactions(s, d).select(F.col("seq").alias("event_id"), "user_id", F.col("k") != 5, F.lit("text").alias("text"), F.col("txn_time").alias("posted_at"), (F.col("k") == 7).alias("replay"), "seq", "k")
    rows = rows.toDF("event_id", "user_id", "redacted", "text", "posted_at", "replay", "seq", "k")
    again = rows.where("event_id % 8 = 0").withColumn("seq", F.col("seq") + 10_000_000).withColumn("user_id", F.when(F.col("event_id") % 7 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")))
    return rows.union(again).drop("k")


def reports(s, d):
    """Parsed reports of payments: each event by a notification; for some a second one of the kinds in the tests."""
    rows = t.transactions(s, d).where("status = 'SUCCESS'")
    reference = F.when(F.col("seq") % 2 == 0, F.concat(F.lit("R"), "seq"))
    base = rows.select(
        (F.col("seq") * 10).alias("seq"), F.concat(F.lit("e_"), "seq").alias("event_id"), "user_id", F.lit("RAW_NOTIFICATION").alias("raw_type"), F.lit("com.phonepe.app").alias("source_app"), "amount_paise", "direction",
        F.when(F.col("k") % 9 == 0, "PENDING").otherwise("SUCCESS").alias("status"), F.when(F.col("k") % 10 == 0, "ATM").otherwise("UPI").alias("channel"), "txn_time", "merchant_raw", (F.col("k") % 12).alias("merchant_id"), "category", reference.alias("reference_id"),
        F.when(F.col("seq") % 4 > 0, F.col("account_hint")).alias("account_hint"), F.when(F.col("k") % 6 == 0, F.col("amount_paise") * 7).alias("balance_after_paise"), F.lit("RULE").alias("parse_method"),
    )
    n = F.floor(F.col("seq") / 10)

    def second(every: int, place: int, **changes):
        out = base.where(n % every == 0).withColumn("seq", F.col("seq") + place).withColumn("event_id", F.concat("event_id", F.lit(f"_{place}")))
        return out.withColumns(changes).select(base.columns)

    later = lambda text: F.col("txn_time") + F.expr(f"INTERVAL {text}")
    sms = second(3, 1, raw_type=F.lit("RAW_SMS"), source_app=F.lit(None).cast("string"), txn_time=later("90 SECONDS"), status=F.lit("SUCCESS"), reference_id=F.concat(F.lit("R"), n))
    same_app = second(7, 2, txn_time=later("60 SECONDS"), reference_id=F.lit(None).cast("string"))
    shared = second(11, 3, txn_time=later("30 HOURS"), reference_id=F.concat(F.lit("R"), n), raw_type=F.lit("RAW_SMS"))
    opposite = second(13, 4, txn_time=later("5 MINUTES"), direction=F.when(F.col("direction") == "DEBIT", "CREDIT").otherwise("DEBIT"), account_hint=F.lit("9999"), reference_id=F.lit(None).cast("string"), merchant_id=F.lit(None).cast("long"))
    return base.union(sms).union(same_app).union(shared).union(opposite)


REPORT_SQL = """base AS (
  SELECT seq * 10 AS seq, 'e_' || seq AS event_id, user_id, 'RAW_NOTIFICATION' AS raw_type, amount_paise, direction, txn_time, merchant_raw, CASE WHEN seq % 2 = 0 THEN 'R' || seq END AS reference_id, CASE WHEN seq % 4 > 0 THEN account_hint END AS account_hint, seq AS n
  FROM txn WHERE status = 'SUCCESS'),
report AS (
  SELECT seq, event_id, user_id, amount_paise, direction, txn_time, merchant_raw, reference_id, account_hint FROM base
  UNION ALL SELECT seq + 1, event_id || '_1', user_id, amount_paise, direction, txn_time + INTERVAL 90 SECOND, merchant_raw, 'R' || n, account_hint FROM base WHERE n % 3 = 0
  UNION ALL SELECT seq + 2, event_id || '_2', user_id, amount_paise, direction, txn_time + INTERVAL 60 SECOND, merchant_raw, NULL, account_hint FROM base WHERE n % 7 = 0
  UNION ALL SELECT seq + 3, event_id || '_3', user_id, amount_paise, direction, txn_time + INTERVAL 30 HOUR, merchant_raw, 'R' || n, account_hint FROM base WHERE n % 11 = 0
  UNION ALL SELECT seq + 4, event_id || '_4', user_id, amount_paise, CASE direction WHEN 'DEBIT' THEN 'CREDIT' ELSE 'DEBIT' END, txn_time + INTERVAL 5 MINUTE, merchant_raw, NULL, '9999' FROM base WHERE n % 13 = 0)"""


def proposals(s, d):
    rows = t.transactions(s, d)
    return rows.select(
        F.concat(F.lit("p_"), "seq").alias("id"), "user_id", t.pick(["ROAST", "NUDGE", "SUMMARY", "CONFIRMATION"], F.col("k") % 4).alias("alert_type"), F.col("txn_time").alias("at"), "category",
        t.pick(["MILD", "OFF", "SAVAGE"], F.col("user_id") % 3).alias("roast_level"), F.lit(1380).alias("quiet_start"), F.lit(480).alias("quiet_end"), F.when(F.col("k") % 5 == 0, F.concat_ws(":", "k", F.to_date("txn_time"))).alias("dedupe_key"), (F.col("k") % 3).alias("roasts_today"), (F.col("k") % 6).alias("roasts_week"), (F.col("k") % 5).alias("capped_today"),
    )


def decided(s, d):
    from spendlake.functions.times import in_quiet_hours

    rows = proposals(s, d)
    verdict = policy.decision(F.col("alert_type"), in_quiet_hours(F.col("at"), F.col("quiet_start"), F.col("quiet_end")), F.col("roast_level"), F.col("category"), F.col("roasts_today"), F.col("roasts_week"), F.col("capped_today"))
    return rows.select("id", verdict.alias("v")).select("id", "v.decision", "v.reason")


def tasks(s, d):
    rows = t.transactions(s, d)
    return rows.select("id", "user_id", F.col("txn_time").alias("now"), F.when(F.col("k") % 4 == 0, F.col("txn_time") + F.expr("INTERVAL 1 HOUR") * (F.col("k") % 3 - 1)).alias("deadline"), (F.col("k") % 3).alias("priority"))


def extractions(s, d):
    """Extractions that fail or hold by `k`, of a debit message."""
    rows = t.transactions(s, d)
    rupees = F.format_string("%d.%02d", F.floor(F.col("amount_paise") / 100), F.col("amount_paise") % 100)
    text = F.concat(F.lit("Rs."), rupees, F.lit(" debited. Ref 12 34"), F.col("seq"))
    kind = F.col("k") % 8
    x = F.struct(
        (kind != 0).alias("is_transaction"), F.when(kind == 1, None).when(kind == 2, "x").when(kind == 3, "99999999.01").otherwise(rupees).alias("amount"), F.when(kind == 4, None).when(kind == 5, "CREDIT").otherwise("DEBIT").alias("direction"),
        F.when(kind == 6, "FAILED").otherwise("SUCCESS").alias("status"), F.when(F.col("k") % 5 == 0, "nope").otherwise(F.concat(F.lit("1234"), F.col("seq"))).alias("reference_id"), F.when(F.col("k") % 7 == 0, "77777777.01").alias("balance_after"),
    )
    return rows.select("id", grounding.failure(x, text).alias("failure"))


def corrections(s, d):
    rows = t.transactions(s, d).where("seq % 9 = 0")
    return rows.select("id", "user_id", F.lit("TRAVEL").alias("category"), F.when(F.col("k") % 2 == 0, F.lit(" My Shop ")).alias("merchant_name"))


def observed(s, d):
    return t.transactions(s, d).select(F.concat(F.lit("r_"), F.col("user_id") % 40).alias("rule_id"), "seq", (F.col("k") % 60 > F.col("user_id") % 3).alias("agreed"))


QUERIES = {
    "rule_extract": lambda s, d: parsing.parse(bank_messages(s, d), parsing.rule_table(s, seed_rules())).select("event_id", "outcome", "reason", "amount_paise", "direction", "channel", "merchant_raw", "reference_id", "account_hint", "balance_after_paise", "rule_id"),
    "validate_extraction": extractions,
    "merchant_exact": lambda s, d: t.transactions(s, d).select("merchant_raw").distinct().withColumn("alias", merchants.merchant_key(F.col("merchant_raw"))).join(merchants.aliases_of(merchant_table(s)), "alias").select("merchant_raw", "merchant_id", "category"),
    "merchant_trigram": lambda s, d: merchants.alike(t.transactions(s, d).select(merchants.merchant_key(F.col("merchant_raw")).alias("key")), merchants.aliases_of(merchant_table(s))).select("key", "alias", "merchant_id", F.round("similarity", 9).alias("similarity")),
    "resolve_cascade": lambda s, d: merchants.resolve(t.transactions(s, d).select("id", "user_id", "merchant_raw"), merchants.aliases_of(merchant_table(s)), override_table(s, d)).select("id", "merchant_id", "merchant_name", "resolved_category", "method"),
    "dedup_candidates": lambda s, d: merging.candidate_pairs(reports(s, d).select(F.col("event_id").alias("id"), "user_id", "amount_paise", "direction", "txn_time", "merchant_raw", "account_hint", "reference_id", "seq")).select("id", "other", F.col("apart").cast("long").alias("apart"), F.col("score").cast("long").alias("score")),
    "dedup_merge": lambda s, d: merging.latest(merging.payments(reports(s, d))).select("payment", "version", "kind", "status", "category", "reference_id", "account_hint"),
    "policy_decide": decided,
    "policy_gate": lambda s, d: policy.gate(proposals(s, d).drop("roasts_today", "roasts_week", "capped_today")).select("id", "user_id", "decision", "reason"),
    "alert_caps": lambda s, d: policy.sent_counts(t.alerts(s, d)),
    "task_gate": lambda s, d: policy.task_gate(tasks(s, d), 2).select("id"),
    "upload_classify": lambda s, d: ingest.classify(upload_table(s, d), t.transactions(s, d).where("seq % 10 = 3").select(F.col("seq").alias("event_id"), "user_id"), F.lit(END).cast("timestamp_ntz")).select("event_id", "seq", "status", "reason"),
    "upsert_latest": lambda s, d: ingest.upsert(t.transactions(s, d).select("id", "category", F.lit(1).alias("version")), t.transactions(s, d).where("seq % 4 = 0").select("id", F.lit("OTHER").alias("category"), (F.col("k") % 3).cast("int").alias("version")), ["id"], "version"),
    "correct_category": lambda s, d: ingest.correct(t.transactions(s, d).select("id", "user_id", "category", F.lit("m").alias("merchant_id"), F.lit(1).alias("version"), F.lit(False).alias("user_corrected")), corrections(s, d)),
    "correct_known_name": lambda s, d: ingest.correct(t.transactions(s, d).select("id", "user_id", "category", F.lit("m").alias("merchant_id"), F.lit(1).alias("version"), F.lit(False).alias("user_corrected")), corrections(s, d).withColumn("merchant_name", F.when(F.length("id") % 2 == 0, "the Zomato  Ltd").otherwise(F.col("merchant_name"))), merchants.aliases_of(merchant_table(s))).select("id", "merchant_id"),
    "delete_users": lambda s, d: ingest.delete_users({"alerts": t.alerts(s, d), "feedback": t.alerts(s, d).select(F.col("id").alias("alert_id"), "reaction")}, t.budgets(s, d).where("user_id % 7 = 0"), {"feedback": ("alert_id", "alerts", "id")})["feedback"],
    "rule_lifecycle": lambda s, d: parsing.lifecycle(observed(s, d), "seq"),
    "labelling_export": lambda s, d: ingest.labelling_export(t.transactions(s, d).select("user_id").distinct().withColumn("consent", F.col("user_id") % 2 == 0), t.messages(s, d), t.transactions(s, d).where("seq % 3 = 0").select(F.concat(F.lit("e_"), "seq").alias("raw_event_id"), F.col("id").alias("transaction_id")), t.transactions(s, d)).select("event_id", "amount_paise", "direction", "merchant_raw"),
}

ROASTS = ", ".join(f"'{c}'" for c in ROASTABLE)
FAILED = [("k % 8 = 0", "NOT_TRANSACTION"), ("k % 8 = 1", "MISSING_AMOUNT"), ("k % 8 = 2", "BAD_AMOUNT"), ("k % 8 = 3", "AMOUNT_NOT_IN_TEXT"), ("k % 5 = 0", "REFERENCE_NOT_IN_TEXT"), ("k % 8 = 4", "MISSING_DIRECTION"), ("k % 8 = 5", "DIRECTION_MISMATCH"), ("k % 8 = 6", "FAILED_WITHOUT_KEYWORD"), ("k % 7 = 0", "BAD_BALANCE")]
WHOLE_GRAMS = "list_distinct(list_transform(range(1, length({x}) + 2), lambda i: substr('  ' || {x} || ' ', i, 3)))"
ORACLE_SQL = {
    "rule_extract": with_txn(
        """SELECT event_id, CASE WHEN known THEN 'PARSED' ELSE 'FAILED' END AS outcome, CASE WHEN NOT known THEN 'NO_TIER' END AS reason,
        CASE WHEN known THEN amount_paise END AS amount_paise, CASE WHEN known THEN ['DEBIT', 'CREDIT', 'DEBIT'][seq % 3 + 1] END AS direction, CASE WHEN known THEN ['UPI', 'NETBANKING', 'CARD'][seq % 3 + 1] ELSE 'UNKNOWN' END AS channel,
        CASE WHEN known THEN CASE seq % 3 WHEN 0 THEN vpa || '@upi' ELSE trim(name) END END AS merchant_raw, CASE WHEN known AND seq % 3 = 0 THEN ref END AS reference_id, CASE WHEN known THEN acct END AS account_hint,
        CASE WHEN known AND seq % 3 = 1 THEN seq * 1000 END AS balance_after_paise, CASE WHEN known THEN ['r_hdfc_upi_debit_v1', 'r_sbi_neft_credit_v1', 'r_icici_card_spend_v1'][seq % 3 + 1] END AS rule_id FROM bank""",
        BANK_SQL,
    ),
    "validate_extraction": with_txn(f"SELECT id, CASE WHEN k % 8 > 3 AND amount_paise = 0 THEN 'BAD_AMOUNT' {' '.join(f'''WHEN {c} THEN '{r}' ''' for c, r in FAILED)} END AS failure FROM txn"),
    "merchant_exact": with_txn("SELECT merchant_raw, m[1] AS merchant_id, m[3] AS category FROM payee JOIN alias ON key = alias", ALIAS_SQL),
    "merchant_trigram": with_txn("SELECT key, alias, m[1] AS merchant_id, round(similarity, 9) AS similarity FROM best", ALIAS_SQL),
    "resolve_cascade": with_txn(
        """SELECT id, CASE WHEN own THEN NULL WHEN person THEN NULL ELSE coalesce(a.m[1], b.m[1]) END AS merchant_id, CASE WHEN own THEN 'My Coffee' WHEN person THEN NULL ELSE coalesce(a.m[2], b.m[2]) END AS merchant_name,
          CASE WHEN own THEN 'SUBSCRIPTIONS' WHEN person THEN 'TRANSFERS' ELSE coalesce(a.m[3], b.m[3], 'OTHER') END AS resolved_category,
          CASE WHEN own THEN 'USER' WHEN person THEN 'PERSON' WHEN a.alias IS NOT NULL THEN 'EXACT' WHEN b.alias IS NOT NULL THEN 'TRIGRAM' ELSE 'NONE' END AS method
        FROM (SELECT id, merchant_raw, key, person, user_id % 10 = 0 AND key = 'coffee' AS own FROM txn JOIN payee USING (merchant_raw)) p LEFT JOIN alias a ON p.key = a.alias LEFT JOIN best b ON p.key = b.key""",
        ALIAS_SQL,
    ),
    "dedup_candidates": with_txn(
        f"""SELECT x.event_id AS id, y.event_id AS other, CAST(abs(epoch_us(x.txn_time) - epoch_us(y.txn_time)) // 1000000 AS BIGINT) AS apart,
          CAST(4 + CASE WHEN abs(epoch_us(x.txn_time) - epoch_us(y.txn_time)) <= 180000000 THEN 3 ELSE 0 END
            + CASE WHEN lower(trim(x.merchant_raw)) = lower(trim(y.merchant_raw)) THEN 2 WHEN kx = '' OR ky = '' THEN 0 WHEN len(list_intersect(gx, gy)) / len(list_distinct(list_concat(gx, gy))) >= 0.4 THEN 2 ELSE 0 END
            + CASE WHEN x.account_hint <> '' AND x.account_hint = y.account_hint THEN 1 ELSE 0 END AS BIGINT) AS score
        FROM (SELECT *, {WHOLE_GRAMS.format(x='kx')} AS gx FROM (SELECT *, {key_sql('merchant_raw')} AS kx FROM report)) x
        JOIN (SELECT *, {WHOLE_GRAMS.format(x='ky')} AS gy FROM (SELECT *, {key_sql('merchant_raw')} AS ky FROM report)) y
        ON x.user_id = y.user_id AND x.amount_paise = y.amount_paise AND x.direction = y.direction AND y.seq < x.seq
          AND abs(epoch_us(x.txn_time) - epoch_us(y.txn_time)) <= CASE WHEN coalesce(x.reference_id, '') <> '' THEN 172800000000 ELSE 900000000 END""",
        REPORT_SQL,
    ),
    "policy_decide": with_txn(
        f"""SELECT id, CASE WHEN a = 'CONFIRMATION' THEN 'SEND' WHEN quiet THEN 'SUPPRESS' WHEN a = 'SUMMARY' THEN 'SEND' WHEN k % 5 >= 3 THEN 'SUPPRESS' WHEN a = 'NUDGE' THEN 'SEND' WHEN user_id % 3 = 1 OR category NOT IN ({ROASTS}) OR k % 3 >= 1 OR k % 6 >= 4 THEN 'SEND_PLAIN' ELSE 'SEND' END AS decision,
          CASE WHEN a = 'CONFIRMATION' THEN NULL WHEN quiet THEN 'QUIET_HOURS' WHEN a = 'SUMMARY' THEN NULL WHEN k % 5 >= 3 THEN 'DAILY_CAP' WHEN a = 'NUDGE' THEN NULL WHEN user_id % 3 = 1 THEN 'ROAST_OFF' WHEN category NOT IN ({ROASTS}) THEN 'NOT_ROASTABLE' WHEN k % 3 >= 1 OR k % 6 >= 4 THEN 'ROAST_CAP' END AS reason
        FROM (SELECT 'p_' || seq AS id, user_id, k, category, ['ROAST', 'NUDGE', 'SUMMARY', 'CONFIRMATION'][k % 4 + 1] AS a, hour(txn_time + INTERVAL 330 MINUTE) * 60 + minute(txn_time + INTERVAL 330 MINUTE) NOT BETWEEN 480 AND 1379 AS quiet FROM txn)"""
    ),
    "policy_gate": with_txn(
        """SELECT id, user_id, decision, reason FROM walk WHERE rn > 0""",
        f"""proposal AS (SELECT 'p_' || seq AS id, user_id, txn_time AS moment, k, CAST(txn_time + INTERVAL 330 MINUTE AS DATE) AS day, CAST(date_trunc('week', txn_time + INTERVAL 330 MINUTE) AS DATE) AS week, ['ROAST', 'NUDGE', 'SUMMARY', 'CONFIRMATION'][k % 4 + 1] AS a,
            category IN ({ROASTS}) AS fit, hour(txn_time + INTERVAL 330 MINUTE) * 60 + minute(txn_time + INTERVAL 330 MINUTE) NOT BETWEEN 480 AND 1379 AS quiet, CASE WHEN k % 5 = 0 THEN k || ':' || CAST(txn_time AS DATE) END AS dedupe FROM txn)""",
        """step AS (SELECT *, dedupe IS NOT NULL AND row_number() OVER (PARTITION BY user_id, dedupe ORDER BY moment, id) > 1 AS again, row_number() OVER (PARTITION BY user_id, week ORDER BY moment, id) AS rn,
            CASE WHEN a = 'CONFIRMATION' OR (a = 'SUMMARY' AND NOT quiet) THEN 'SEND' WHEN quiet THEN 'SUPPRESS' WHEN a = 'ROAST' AND (user_id % 3 = 1 OR NOT fit) THEN 'SEND_PLAIN' ELSE 'SEND' END AS d,
            CASE WHEN a = 'CONFIRMATION' THEN NULL WHEN quiet THEN 'QUIET_HOURS' WHEN a = 'ROAST' AND user_id % 3 = 1 THEN 'ROAST_OFF' WHEN a = 'ROAST' AND NOT fit THEN 'NOT_ROASTABLE' END AS r FROM proposal)""",
        """walk AS (
          SELECT DISTINCT user_id, week, CAST(0 AS BIGINT) AS rn, CAST(NULL AS DATE) AS day, 0 AS capped, 0 AS today, 0 AS of_week, CAST(NULL AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS decision, CAST(NULL AS VARCHAR) AS reason FROM step
          UNION ALL
          SELECT user_id, week, rn, day, c + CASE WHEN counts AND c < 3 THEN 1 ELSE 0 END, t + CASE WHEN joke AND c < 3 AND t < 1 AND w < 4 THEN 1 ELSE 0 END, w + CASE WHEN joke AND c < 3 AND t < 1 AND w < 4 THEN 1 ELSE 0 END, id,
            CASE WHEN again THEN 'SUPPRESS' WHEN counts AND c >= 3 THEN 'SUPPRESS' WHEN joke AND (t >= 1 OR w >= 4) THEN 'SEND_PLAIN' ELSE d END, CASE WHEN again THEN 'DUPLICATE' WHEN counts AND c >= 3 THEN 'DAILY_CAP' WHEN joke AND (t >= 1 OR w >= 4) THEN 'ROAST_CAP' ELSE r END
          FROM (SELECT s.*, CASE WHEN s.day = w.day THEN w.capped ELSE 0 END AS c, CASE WHEN s.day = w.day THEN w.today ELSE 0 END AS t, w.of_week AS w, NOT again AND a IN ('ROAST', 'NUDGE') AND d <> 'SUPPRESS' AS counts, NOT again AND a = 'ROAST' AND d = 'SEND' AS joke
            FROM walk w JOIN step s ON s.user_id = w.user_id AND s.week = w.week AND s.rn = w.rn + 1))""",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
    "alert_caps": with_txn(
        """SELECT user_id, day, capped_today, roasts_today, CAST(sum(roasts_today) OVER (PARTITION BY user_id, week ORDER BY day) AS BIGINT) AS roasts_week FROM (
        SELECT user_id, CAST(date_trunc('week', sent_at + INTERVAL 330 MINUTE) AS DATE) AS week, CAST(sent_at + INTERVAL 330 MINUTE AS DATE) AS day, count(*) FILTER (alert_type IN ('ROAST', 'NUDGE')) AS capped_today, count(*) FILTER (alert_type = 'ROAST') AS roasts_today
        FROM alert WHERE status = 'SENT' GROUP BY ALL)""",
        t.ALERT_SQL,
    ),
    "task_gate": with_txn(
        """SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(txn_time + INTERVAL 330 MINUTE AS DATE) ORDER BY txn_time, id) AS place FROM txn WHERE k % 4 > 0 OR k % 3 >= 1)
        WHERE place <= 2 OR k % 3 >= 2"""
    ),
    "upload_classify": with_txn(
        """SELECT event_id, seq, CASE WHEN rule IS NOT NULL OR owner <> user_id THEN 'REJECTED' WHEN stored OR seq > 10000000 THEN 'DUPLICATE' ELSE 'ACCEPTED' END AS status, coalesce(rule, CASE WHEN owner <> user_id THEN 'OTHER_OWNER' END) AS reason
        FROM (SELECT u.*, x.user_id AS owner, u.event_id % 10 = 3 AS stored, CASE WHEN x.k = 5 THEN 'NOT_REDACTED' WHEN x.txn_time > TIMESTAMP '2024-01-22 00:05:00' THEN 'IN_FUTURE' WHEN x.k = 7 THEN 'REPLAY' END AS rule
          FROM (SELECT seq AS event_id, user_id, seq FROM txn UNION ALL SELECT seq, user_id + CASE WHEN seq % 7 = 0 THEN 1 ELSE 0 END, seq + 10000000 FROM txn WHERE seq % 8 = 0) u JOIN txn x ON x.seq = u.event_id)"""
    ),
    "upsert_latest": with_txn("SELECT id, CASE WHEN seq % 4 = 0 AND k % 3 >= 1 THEN 'OTHER' ELSE category END AS category, CAST(CASE WHEN seq % 4 = 0 THEN greatest(1, k % 3) ELSE 1 END AS INTEGER) AS version FROM txn"),
    "correct_category": with_txn("SELECT id, user_id, CASE WHEN c THEN 'TRAVEL' ELSE category END AS category, CASE WHEN c AND k % 2 = 0 THEN 'um_' || substr(sha256('my shop'), 1, 12) ELSE 'm' END AS merchant_id, CAST(CASE WHEN c THEN 2 ELSE 1 END AS INTEGER) AS version, c AS user_corrected FROM (SELECT *, seq % 9 = 0 AS c FROM txn)"),
    "correct_known_name": with_txn("SELECT id, CASE WHEN seq % 9 = 0 AND length(id) % 2 = 0 THEN 'm_zomato' WHEN seq % 9 = 0 AND k % 2 = 0 THEN 'um_' || substr(sha256('my shop'), 1, 12) ELSE 'm' END AS merchant_id FROM txn"),
    "delete_users": with_txn("SELECT id AS alert_id, reaction FROM alert WHERE user_id NOT IN (SELECT user_id FROM budget WHERE user_id % 7 = 0)", t.ALERT_SQL, t.BUDGET_SQL),
    "rule_lifecycle": with_txn(
        """SELECT rule_id, CASE WHEN mismatches > 2 THEN 'DISABLED' WHEN promoted THEN 'ACTIVE' ELSE 'CANDIDATE' END AS status, matches, mismatches FROM (
        SELECT rule_id, CAST(max(m) AS BIGINT) AS matches, CAST(max(x) AS BIGINT) AS mismatches, bool_or(m >= 5 AND x = 0) AS promoted FROM (
          SELECT rule_id, count(*) FILTER (agreed) OVER w AS m, count(*) FILTER (NOT agreed) OVER w AS x FROM (SELECT 'r_' || (user_id % 40) AS rule_id, seq, k % 60 > user_id % 3 AS agreed FROM txn)
          WINDOW w AS (PARTITION BY rule_id ORDER BY seq ROWS UNBOUNDED PRECEDING)) GROUP BY rule_id)"""
    ),
    "labelling_export": with_txn("SELECT 'e_' || seq AS event_id, CASE WHEN seq % 3 = 0 THEN amount_paise END AS amount_paise, CASE WHEN seq % 3 = 0 THEN direction END AS direction, CASE WHEN seq % 3 = 0 THEN merchant_raw END AS merchant_raw FROM txn WHERE user_id % 2 = 0"),
}
