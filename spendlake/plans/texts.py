"""Queries on texts, ids and calendar functions."""

import hashlib
import hmac
from datetime import date

from pyspark.sql import functions as F

from spendlake.functions import commitments, ids, money, redaction, text, times
from spendlake.operators import cash
from spendlake.plans.payments import with_txn
from spendlake.sources import tables as t

#: Namespace of the query's derived ids.
NAMESPACE = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
KEY_SQL = f"array_to_string(list_filter(regexp_split_to_array(replace(split_part(lower(trim(merchant_raw)), '@', 1), '&', ' & '), '[^a-z&]+'), lambda w: w <> '' AND w NOT IN ({STOP})), ' ')"
NUMBER = r"(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]{1,2}(?:,[0-9]{2})+,[0-9]{3}|[0-9]+)(?:\.[0-9]{1,2})?"


def cash_lines(s, d):
    """A line typed by hand for each payment."""
    rows = t.transactions(s, d)
    words = ["vada pav", "got from mom", "atm", "shoes on sale", "auto", "for chai, ", "movie night", "5 idli", "rent", "something"]
    line = F.concat(F.floor(F.col("amount_paise") / 100), F.when(F.col("seq") % 3 == 0, "k").when(F.col("seq") % 3 == 1, "/-").otherwise(""), F.lit(" "), t.pick(words, F.col("k") % 10))
    return rows.select("id", line.alias("line"))


def promises(s, d):
    """A promise, or something like one, for each payment."""
    rows = t.transactions(s, d)
    words = [F.concat(F.lit("Please limit coffee to "), F.col("k") % 30, F.lit(" times a week till 5 mar")), F.lit("no  food delivery this month until 31 feb"), F.lit("sirf chai 2 baar ek hafte"), F.lit("I spend too much"), F.concat(F.lit("stop shoes for a week by "), F.col("k") % 28 + 1, F.lit("jan"))]
    return rows.select("id", F.element_at(F.array(*words), (F.col("seq") % 5).cast("int") + 1).alias("text"))


QUERIES = {
    "merchant_normalize": lambda s, d: t.transactions(s, d).select("id", text.merchant_key(F.col("merchant_raw")).alias("key"), text.is_person_vpa(F.col("merchant_raw")).alias("person")),
    "sender_key": lambda s, d: t.messages(s, d).select("event_id", text.sender_key(F.col("sender"), F.col("source_app")).alias("key"), text.is_bank_sender(F.col("sender")).alias("bank")),
    "template_signature": lambda s, d: t.messages(s, d).select("event_id", text.template_signature(F.col("text"), F.col("sender")).alias("signature")),
    "prefilter_reason": lambda s, d: t.messages(s, d).select("event_id", text.drop_reason(F.col("text")).alias("reason")),
    "amounts_in_text": lambda s, d: t.messages(s, d).select("event_id", F.array_join(money.currency_amounts(F.col("text")).cast("array<string>"), ",").alias("paise")),
    "format_inr": lambda s, d: t.transactions(s, d).select("id", money.format_inr(F.col("amount_paise") * (F.col("seq") - 5000) * 37).alias("text")),
    "rupees_to_paise": lambda s, d: t.messages(s, d).select("event_id", money.rupees_to_paise(F.regexp_extract("text", r"([0-9][0-9,]*[.][0-9]+)", 1)).alias("paise")),
    "uuid5_ids": lambda s, d: t.transactions(s, d).select("id", F.replace(ids.uuid5(NAMESPACE, F.concat(F.lit("txn/"), "id")), F.lit("-"), F.lit("")).alias("uuid")),
    "uuid7_millis": lambda s, d: t.transactions(s, d).select("id", ids.uuid7_millis(F.concat(F.lpad(F.lower(F.hex(F.col("seq") * 1_000_003)), 12, "0"), F.lit("-7abc-8def"))).alias("millis")),
    "shadow_sample": lambda s, d: t.messages(s, d).select("event_id", ids.sample_slot(F.col("event_id")).alias("slot"), ids.in_sample(F.col("event_id"), 0.05).alias("sampled")),
    "split_bucket": lambda s, d: t.messages(s, d).select("event_id", F.round(ids.hash_fraction(F.concat(F.lit("salt:"), "event_id")), 9).alias("share")),
    "short_ids": lambda s, d: t.transactions(s, d).select("id", ids.short_hash("um_", F.lower(F.trim("merchant_raw"))).alias("merchant_id")),
    "iso_week_key": lambda s, d: t.table(s, d, "orders").select("o_orderkey", times.iso_week_key(F.col("o_orderdate").cast("timestamp_ntz")).alias("week")),
    "quiet_hours": lambda s, d: t.transactions(s, d).select("id", times.in_quiet_hours(F.col("txn_time"), F.lit(1380), F.lit(480)).alias("night"), times.in_quiet_hours(F.col("txn_time"), F.lit(780), F.lit(840)).alias("noon")),
    "recency_decay": lambda s, d: t.transactions(s, d).select("id", F.round(times.recency(F.col("k") - 10), 9).alias("recency")),
    "content_filter": lambda s, d: t.table(s, d, "conversations").select("conv_id", "turn", text.blocked_reason(F.concat_ws(" ", "text", t.pick(["", "your mom", "ugly", "Caste!", "ok"], F.col("conv_id") % 5))).alias("reason")),
    "scrub_digits": lambda s, d: t.messages(s, d).select("event_id", text.scrub_digits(F.concat(F.lit("9"), F.regexp_replace("text", " ", ""), F.lit("12345678901234"))).alias("text")),
    "cash_entry_parse": lambda s, d: cash_lines(s, d).select("id", cash.parse_cash_line(F.col("line")).alias("e")).select("id", "e.entry_type", "e.amount_paise", "e.note", "e.category"),
    "sender_match": lambda s, d: t.messages(s, d).where((F.upper("sender") == "HDFCBK") | F.col("sender").endswith("-HDFCBK") | (F.col("source_app") == "HDFCBK")).select("event_id", "sender"),
    "redact_messages": lambda s, d: t.messages(s, d).select("event_id", redaction.redact(F.concat(F.col("text"), F.lit(" a.b@c.com asha@ybl 98"), F.lpad(F.col("seq").cast("string"), 8, "7")), b"key").alias("text")),
    "commitments": lambda s, d: promises(s, d).select("id", commitments.commitment(F.col("text"), F.lit(date(2026, 2, 1))).alias("c")).select("id", "c.target", "c.max_count", "c.period", "c.until"),
    "capture_key": lambda s, d: t.messages(s, d).where(text.is_bank_sender(F.col("sender")) & F.col("text").rlike(r"\S")).select("event_id", F.sha2(F.concat(*(x for c in ("sender", "source_app", "text") for x in (F.coalesce(c, F.lit("")), F.lit("\0")))), 256).alias("dedupe_key")),
}

M = t.MESSAGE_SQL
#: What cash_lines' words come to: entry type, note and category; a second amount makes a line unreadable.
LINES = [("CASH_SPEND", "vada pav", "DINING_OUT"), ("CASH_RECEIVED", "got from mom", None), ("ATM_WITHDRAWAL", "atm", None), ("CASH_SPEND", "shoes sale", "SHOPPING"), ("CASH_SPEND", "auto", "TRANSPORT"), ("CASH_SPEND", "chai", "DINING_OUT"), ("CASH_SPEND", "movie night", "ENTERTAINMENT"), (None, None, None), ("CASH_SPEND", "rent", "RENT"), ("CASH_SPEND", "something", "CASH_UNCATEGORIZED")]
LINE_SQL = ["[" + ", ".join("NULL" if x is None else f"'{x}'" for x in column) + "][k % 10 + 1]" for column in zip(*LINES, strict=True)]


def hidden(local: str) -> str:
    """A person's name in an address, as redaction writes it under the query's key."""
    return "p" + hmac.new(b"key", local.encode(), hashlib.sha256).hexdigest()[:8]


ORACLE_SQL = {
    "merchant_normalize": with_txn(f"SELECT id, {KEY_SQL} AS key, regexp_matches(trim(merchant_raw), '{text.PERSON_VPA}') AS person FROM txn"),
    "sender_key": with_txn(f"SELECT event_id, upper(regexp_extract(trim(sender), '[^-]*$')) AS key, regexp_matches(sender, '{text.BANK_SENDER}') AS bank FROM message", M),
    "template_signature": with_txn(
        r"""SELECT event_id, upper(regexp_extract(sender, '[^-]*$')) || '|' || lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
        '(?i)\b[\w.\-]+@[a-z][a-z0-9]+\b', '<vpa>', 'g'), '(?i)(?:\bXX|\*\*|\bx)\d{3,4}\b', '<acct>', 'g'), '\d[\d,]*(?:\.\d+)?', '<n>', 'g'), '\b[A-Z][A-Z0-9&.''-]{2,}\b', '<name>', 'g'), '\s+', ' ', 'g'))) AS signature FROM message""",
        M,
    ),
    "prefilter_reason": with_txn(
        f"""SELECT event_id, CASE WHEN NOT regexp_matches(text, '\\S') THEN 'EMPTY' WHEN regexp_matches(text, '{text.OTP}') THEN 'OTP' WHEN regexp_matches(text, '{text.COLLECT}') THEN 'COLLECT_REQUEST'
        WHEN regexp_matches(text, '{text.PROMO}') AND NOT regexp_matches(text, '{text.MOVEMENT}') THEN 'PROMO' WHEN regexp_matches(text, '{text.BALANCE}') AND NOT regexp_matches(text, '{text.MOVEMENT}') THEN 'BALANCE_ONLY'
        WHEN NOT regexp_matches(text, '[0-9]') THEN 'NO_AMOUNT' END AS reason FROM message""",
        M,
    ),
    "amounts_in_text": with_txn(f"SELECT event_id, array_to_string(list_transform(regexp_extract_all(text, '(?i)(?:\\b(?:rs\\.?|inr)|₹)\\s*({NUMBER})', 1), lambda x: CAST(CAST(round(CAST(replace(x, ',', '') AS DECIMAL(18, 2)) * 100) AS BIGINT) AS VARCHAR)), ',') AS paise FROM message", M),
    "format_inr": with_txn(
        """SELECT id, CASE WHEN p < 0 THEN '-' ELSE '' END || '₹' || CASE WHEN length(w) <= 3 THEN w
          ELSE reverse(substr(reverse(w), 1, 3) || regexp_replace(substr(reverse(w), 4), '(..?)', ',\\1', 'g')) END || '.' || lpad(CAST(abs(p) % 100 AS VARCHAR), 2, '0') AS text
        FROM (SELECT id, p, CAST(abs(p) // 100 AS VARCHAR) AS w FROM (SELECT id, amount_paise * (seq - 5000) * 37 AS p FROM txn))"""
    ),
    "rupees_to_paise": with_txn("SELECT event_id, CAST(round(CAST(nullif(replace(x, ',', ''), '') AS DECIMAL(18, 2)) * 100) AS BIGINT) AS paise FROM (SELECT event_id, regexp_extract(text, '([0-9][0-9,]*[.][0-9]+)', 1) AS x FROM message)", M),
    "uuid5_ids": with_txn(
        """SELECT id, substr(h, 1, 12) || '5' || substr(h, 14, 3) || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 15) AS uuid
        FROM (SELECT id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode('txn/' || id)) AS h FROM txn)"""
    ),
    "uuid7_millis": with_txn("SELECT id, seq * 1000003 AS millis FROM txn"),
    "shadow_sample": with_txn("SELECT event_id, slot, slot < 500 AS sampled FROM (SELECT event_id, CAST('0x' || substr(sha256(event_id), 1, 8) AS BIGINT) % 10000 AS slot FROM message)", M),
    "split_bucket": with_txn("SELECT event_id, round(CAST(CAST('0x' || substr(sha256('salt:' || event_id), 1, 16) AS UHUGEINT) AS DOUBLE) / 18446744073709551616.0, 9) AS share FROM message", M),
    "short_ids": with_txn("SELECT id, 'um_' || substr(sha256(lower(trim(merchant_raw))), 1, 12) AS merchant_id FROM txn"),
    "iso_week_key": "SELECT o_orderkey, isoyear(o_orderdate + INTERVAL 330 MINUTE) || '-W' || lpad(CAST(weekofyear(o_orderdate + INTERVAL 330 MINUTE) AS VARCHAR), 2, '0') AS week FROM orders",
    "quiet_hours": with_txn("SELECT id, m >= 1380 OR m < 480 AS night, m >= 780 AND m < 840 AS noon FROM (SELECT id, hour(i) * 60 + minute(i) AS m FROM (SELECT id, txn_time + INTERVAL 330 MINUTE AS i FROM txn))"),
    "recency_decay": with_txn("SELECT id, round(pow(0.5, greatest(k - 10, 0) / 60.0), 9) AS recency FROM txn"),
    "content_filter": (
        "SELECT conv_id, turn, CASE WHEN NOT regexp_matches(x, '\\S') THEN 'EMPTY' WHEN length(x) > 400 THEN 'TOO_LONG' "
        + " ".join(f"WHEN regexp_matches(x, '(?i)\\b({'|'.join(w)})\\b') THEN '{r}'" for r, w in text.BLOCKED.items())
        + " END AS reason FROM (SELECT conv_id, turn, concat_ws(' ', text, ['', 'your mom', 'ugly', 'Caste!', 'ok'][conv_id % 5 + 1]) AS x FROM conversations)"
    ),
    "scrub_digits": with_txn(
        """SELECT event_id, array_to_string(list_transform(regexp_extract_all('9' || replace(text, ' ', '') || '12345678901234', '(\\d+|[^\\d]+)', 1), lambda r: CASE WHEN regexp_matches(r, '^\\d{13,}$') THEN repeat('X', length(r) - 4) || substr(r, -4) ELSE r END), '') AS text FROM message""",
        M,
    ),
    "commitments": with_txn(
        """SELECT id, ['coffee', 'food delivery', 'chai', NULL, 'shoes'][seq % 5 + 1] AS target, CAST([k % 30, 0, 2, NULL, 0][seq % 5 + 1] AS INTEGER) AS max_count, ['week', 'month', 'week', NULL, 'week'][seq % 5 + 1] AS period,
        CASE seq % 5 WHEN 0 THEN DATE '2026-03-05' WHEN 4 THEN make_date(2027, 1, CAST(k % 28 + 1 AS INTEGER)) END AS until FROM txn"""
    ),
    "cash_entry_parse": with_txn(
        f"""SELECT id, CASE WHEN good THEN {LINE_SQL[0]} END AS entry_type, CASE WHEN good THEN p END AS amount_paise, CASE WHEN good THEN {LINE_SQL[1]} END AS note, CASE WHEN good THEN {LINE_SQL[2]} END AS category
        FROM (SELECT *, k % 10 <> 7 AND p > 0 AND p <= 100000000 AS good FROM (SELECT id, k, amount_paise // 100 * CASE WHEN seq % 3 = 0 THEN 100000 ELSE 100 END AS p FROM txn))"""
    ),
    "redact_messages": with_txn(
        f"SELECT event_id, replace(replace(text, 'p12ab34cd@ybl', '{hidden('p12ab34cd')}@ybl'), '12345@ybl', '{hidden('12345')}@ybl') || ' [email] {hidden('asha')}@ybl [phone]' AS text FROM message", M
    ),
    "sender_match": with_txn("SELECT event_id, sender FROM message WHERE upper(sender) = 'HDFCBK' OR sender LIKE '%-HDFCBK' OR source_app = 'HDFCBK'", M),
    "capture_key": with_txn(f"SELECT event_id, sha256(coalesce(sender, '') || chr(0) || coalesce(source_app, '') || chr(0) || coalesce(text, '') || chr(0)) AS dedupe_key FROM message WHERE regexp_matches(sender, '{text.BANK_SENDER}') AND regexp_matches(text, '\\S')", M),
}
