"""Messages to payments: rules kept as data, checks, and tiers that answer one after another.

Rules are a small table: a sender key, a regex with named groups, and fixed fields. A message stays one row:
a few hundred rules are written into the plan, and a larger table meets the messages by sender key.
"""

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlake.functions.binding import once
from spendlake.functions.grounding import failure, same_extraction
from spendlake.functions.money import rupees_to_paise
from spendlake.functions.text import drop_reason, sender_key

GROUPS = ("amount", "merchant", "vpa", "ref", "acct", "bal", "days")
DIRECTIONS = ("DEBIT", "CREDIT")
CHANNELS = ("UPI", "CARD", "ATM", "NETBANKING", "WALLET", "UNKNOWN")
STATUSES = ("SUCCESS", "FAILED", "PENDING", "REVERSED", "REFUND_INITIATED")
MAX_REGEX, MAX_TEXT = 600, 1000
CONFIDENCE = {"RULE": 0.99, "DEVICE": 0.95, "SERVER_MODEL": 0.95, "TEACHER_LLM": 0.9}
PROMOTE_AFTER, DISABLE_AFTER = 5, 2

# What a rule must not have.
#: A quantified group that holds a quantifier; references back; data that belongs to one user.
NESTED = re.compile(r"\((?:[^()\\]|\\.)*[+*}](?:[^()\\]|\\.)*\)\s*[+*{]")
BACK = re.compile(r"\\[1-9]|\(\?P=")
MARKS = re.compile(r"\\.|\{\d+(?:,\d*)?\}")
LITERAL = re.compile(r"\d{3,}|[a-z0-9]@[a-z]", re.IGNORECASE)

EXTRACTION = "struct<is_transaction: boolean, amount: string, direction: string, channel: string, status: string, merchant_raw: string, counterparty_vpa: string, reference_id: string, account_hint: string, balance_after: string, promised_refund_days: int>"
#: Stands before each group that a rule has taken from a text.
MARK = "\x01"
RULE = "id string, sender_key string, status string, created_at long, regex string, groups string, direction string, channel string, txn_status string"


def fault(regex: str, direction: str | None, channel: str = "UNKNOWN", status: str = "SUCCESS") -> str | None:
    """Why a rule must not be used; null if it may."""
    checks = [
        (len(regex) > MAX_REGEX, "too_long"),
        (NESTED.search(regex), "nested_quantifier"),
        (BACK.search(regex), "backreference"),
        (LITERAL.search(MARKS.sub("", regex)), "literal_data"),
    ]
    for bad, reason in checks:
        if bad:
            return reason
    try:
        names = set(re.compile(regex, re.IGNORECASE).groupindex)
    except re.error:
        return "does_not_compile"
    checks = [
        ("amount" not in names, "no_amount_group"),
        (names - set(GROUPS), "unknown_group"),
        (direction not in DIRECTIONS, "bad_direction"),
        (channel not in CHANNELS, "bad_channel"),
        (status not in STATUSES, "bad_status"),
    ]
    return next((reason for bad, reason in checks if bad), None)


def written(regex: str) -> tuple[str, str]:
    """A rule's regex so that it matches a whole text, and what replaces the text then: what each named group took, a mark before each."""
    index = re.compile(regex).groupindex
    whole = f"(?i)\\A(?s:.*?)(?:{regex.replace('(?P<', '(?<')})(?s:.*)\\z"
    return whole, "".join(MARK + (f"${{{g}}}" if g in index else "") for g in GROUPS)


def rule_table(spark: SparkSession, rules: list[dict]) -> DataFrame:
    """Rules (id, sender, regex, direction, channel, status, rule_status, created_at) as a table; unsafe ones are left out."""
    rows = []
    for r in rules:
        channel, status = r.get("channel", "UNKNOWN"), r.get("status", "SUCCESS")
        if fault(r["regex"], r.get("direction"), channel, status) is None:
            rows.append((r["id"], r["sender"], r.get("rule_status", "ACTIVE"), r.get("created_at", 0), *written(r["regex"]), r["direction"], channel, status))
    return spark.createDataFrame(rows, RULE)


def rules_for(rules: DataFrame) -> DataFrame:
    """sender_key, rule_id, status and place of the rules that may read a sender's messages: active ones first, then candidates, each oldest first."""
    from pyspark.sql import Window

    order = Window.partitionBy("sender_key").orderBy("status", "created_at", "id")
    return rules.where("status IN ('ACTIVE', 'CANDIDATE')").select("sender_key", F.col("id").alias("rule_id"), "status", F.row_number().over(order).alias("place"))


def samples(messages: DataFrame, sources: DataFrame, payments: DataFrame, n: int = 50) -> DataFrame:
    """The newest n messages of each sender key whose payment a teacher read, to write rules from.

    messages: event_id, sender, source_app, text, posted_at; sources: event_id, transaction_id; payments: id, parse_method.
    """
    from pyspark.sql import Window

    taught = payments.where("parse_method = 'TEACHER_LLM'").select(F.col("id").alias("transaction_id"))
    ids = sources.join(taught, "transaction_id", "left_semi").select("event_id").distinct()
    keyed = messages.join(ids, "event_id", "left_semi").withColumn("sender_key", sender_key(F.col("sender"), F.lit(None).cast("string")))
    order = Window.partitionBy("sender_key").orderBy(F.desc("posted_at"), "event_id")
    return keyed.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def extraction(rule, groups):
    """What a rule takes from a text that it matches (groups: the split replacement); null if it doesn't match."""
    group = {g: F.nullif(F.trim(F.get(groups, F.lit(i + 1))), F.lit("")) for i, g in enumerate(GROUPS)}
    out = F.struct(
        F.lit(True).alias("is_transaction"), group["amount"].alias("amount"), rule["direction"].alias("direction"), rule["channel"].alias("channel"), rule["txn_status"].alias("status"),
        F.coalesce(group["merchant"], group["vpa"]).alias("merchant_raw"), group["vpa"].alias("counterparty_vpa"), group["ref"].alias("reference_id"),
        group["acct"].alias("account_hint"), group["bal"].alias("balance_after"), F.when(group["days"].rlike("^[0-9]{1,9}$"), group["days"].cast("int")).alias("promised_refund_days"),
    )
    return F.when(F.size(groups) == len(GROUPS) + 1, out)


#: So many rules are written into the plan, each regex compiled once for a task; more of them meet messages by a join.
LITERAL_RULES = 256


def tried(messages: DataFrame, rules: DataFrame, status: str = "ACTIVE") -> DataFrame:
    """messages with sender_key and `tries`: (rule_id, x, failure) of each rule of the key that matches, oldest first.

    A rule runs once a text: one replacement of the whole text by the rule's groups, a mark before each. Texts
    longer than MAX_TEXT match nothing.
    """
    keyed = messages.withColumn("sender_key", sender_key(F.col("sender"), F.col("source_app")))
    keyed = keyed.withColumn("__plain", F.when(F.length("text") <= MAX_TEXT, F.replace("text", F.lit(MARK), F.lit(" "))))
    own = rules.where(F.col("status") == status)
    known = own.orderBy("created_at", "id").limit(LITERAL_RULES + 1).collect()
    return (tried_in_plan(keyed, known) if len(known) <= LITERAL_RULES else tried_by_join(keyed, own)).drop("__plain")


TRIES = f"array<struct<rule_id: string, x: {EXTRACTION}, failure: string>>"


def tried_in_plan(keyed: DataFrame, rules: list) -> DataFrame:
    """The nth rule of each sender key is the nth try; which rule that is follows from the key."""
    of_key: dict[str, list] = {}
    for r in rules:
        of_key.setdefault(r.sender_key, []).append(r)
    rows, tries = keyed, []
    for n in range(max(map(len, of_key.values()), default=0)):
        nth = [own[n] for own in of_key.values() if len(own) > n]

        def chosen(value, nth=nth):
            out = F.when(F.col("sender_key") == nth[0].sender_key, value(nth[0]))
            for r in nth[1:]:
                out = out.when(F.col("sender_key") == r.sender_key, value(r))
            return out

        rule = chosen(lambda r: F.struct(F.lit(r.id).alias("id"), *(F.lit(r[c]).alias(c) for c in ("direction", "channel", "txn_status"))))
        rows = rows.withColumn(f"__rule{n}", rule).withColumn(f"__groups{n}", chosen(lambda r: F.split(F.regexp_replace("__plain", r.regex, r.groups), MARK)))
        rows = rows.withColumn(f"__x{n}", extraction(F.col(f"__rule{n}"), F.col(f"__groups{n}")))
        tries.append(F.struct(F.col(f"__rule{n}.id").alias("rule_id"), F.col(f"__x{n}").alias("x"), F.when(F.col(f"__x{n}").isNotNull(), failure(F.col(f"__x{n}"), F.col("text"))).alias("failure")))
    found = F.filter(F.array(*tries), lambda t: t["x"].isNotNull()) if tries else F.array()
    return rows.withColumn("tries", found.cast(TRIES)).drop(*(f"__{c}{n}" for n in range(len(tries)) for c in ("rule", "groups", "x")))


def tried_by_join(keyed: DataFrame, rules: DataFrame) -> DataFrame:
    """A message meets the rules of its key as one array; Spark sends the table of rules to all tasks as long as it is small enough."""
    by_key = rules.groupBy("sender_key").agg(F.array_sort(F.collect_list(F.struct("created_at", "id", "regex", "groups", "direction", "channel", "txn_status"))).alias("__rules"))
    taken = lambda r: F.split(F.call_function("regexp_replace", F.col("__plain"), r["regex"], r["groups"]), MARK)
    each = F.transform("__rules", lambda r: F.struct(r["id"].alias("rule_id"), once(taken(r), lambda g: extraction(r, g)).alias("x")))
    hits = F.filter(each, lambda e: e["x"].isNotNull())
    checked = F.transform(hits, lambda e: F.struct(e["rule_id"].alias("rule_id"), e["x"].alias("x"), failure(e["x"], F.col("text")).alias("failure")))
    return keyed.join(by_key, "sender_key", "left").withColumn("tries", F.coalesce(checked, F.array().cast(TRIES))).drop("__rules")


def parsed_fields(x, method, rule_id):
    """Fields of a payment from an extraction that holds."""
    return [
        rupees_to_paise(x["amount"]).alias("amount_paise"), x["direction"].alias("direction"), F.coalesce(x["channel"], F.lit("UNKNOWN")).alias("channel"), F.coalesce(x["status"], F.lit("SUCCESS")).alias("status"),
        x["merchant_raw"].alias("merchant_raw"), x["counterparty_vpa"].alias("counterparty_vpa"), x["reference_id"].alias("reference_id"), F.right(x["account_hint"], F.lit(4)).alias("account_hint"),
        rupees_to_paise(x["balance_after"]).alias("balance_after_paise"), x["promised_refund_days"].alias("promised_refund_days"), method.alias("parse_method"), rule_id.alias("rule_id"),
        F.element_at(F.create_map(*(F.lit(v) for kv in CONFIDENCE.items() for v in kv)), method).alias("confidence"),
    ]


def parse(messages: DataFrame, rules: DataFrame, models: dict[str, str] | None = None) -> DataFrame:
    """messages (event_id, sender, source_app, text, …) with outcome, reason and the payment's fields.

    outcome is DROPPED (by the filter of messages, with its reason), PARSED, NOT_TRANSACTION or FAILED. Active
    rules answer first, then the tiers in `models` (method to the name of a column with an extraction), each
    checked against the text; the first that holds wins. Of a message that no tier answers, reason is the last
    tier's failure, or NO_TIER. Null texts are dropped as EMPTY.
    """
    rows = tried(messages.withColumn("drop", drop_reason(F.col("text"))), rules)
    rows = rows.withColumn("__first", F.get(F.filter("tries", lambda t: t["failure"].isNull()), F.lit(0)))
    first = F.col("__first")
    answers = [F.struct(F.lit("RULE").alias("method"), first["rule_id"].alias("rule_id"), first["x"].alias("x"), F.when(first.isNull(), "NO_TIER").alias("failure"))]
    for method, column in (models or {}).items():
        x = F.col(column)
        answers.append(F.struct(F.lit(method).alias("method"), F.lit(None).cast("string").alias("rule_id"), x.alias("x"), F.when(x.isNull(), "NO_TIER").otherwise(failure(x, F.col("text"))).alias("failure")))
    rows = rows.withColumn("answers", F.when(F.col("drop").isNull(), F.array(*answers)))
    rows = rows.withColumn("won", F.get(F.filter("answers", lambda a: a["failure"].isNull()), F.lit(0)))
    rows = rows.withColumn("__faults", F.filter("answers.failure", lambda f: f != "NO_TIER"))
    rows = rows.withColumn("last", F.when(F.size("__faults") > 0, F.element_at("__faults", -1)).otherwise("NO_TIER"))
    outcome = F.when(F.col("drop").isNotNull(), "DROPPED").when(F.col("won").isNotNull(), "PARSED").when(F.col("last") == "NOT_TRANSACTION", "NOT_TRANSACTION").otherwise("FAILED")
    reason = F.when(F.col("drop").isNotNull(), F.col("drop")).when(F.col("won").isNull(), F.col("last"))
    kept = [c for c in messages.columns if c not in ("amount_paise", "outcome", "reason")]
    return rows.select(*kept, outcome.alias("outcome"), reason.alias("reason"), *parsed_fields(F.col("won.x"), F.col("won.method"), F.col("won.rule_id")))


def observations(messages: DataFrame, rules: DataFrame, truth: str) -> DataFrame:
    """rule_id, event_id and agreed: candidate rules that match a message, held against the extraction in column `truth`."""
    rows = tried(messages.where(drop_reason(F.col("text")).isNull()), rules, "CANDIDATE").where(F.col(truth).isNotNull())
    each = rows.select("event_id", F.col(truth).alias("truth"), F.explode("tries").alias("t"))
    return each.select("t.rule_id", "event_id", (F.col("t.failure").isNull() & same_extraction(F.col("t.x"), F.col("truth"))).alias("agreed"))


def lifecycle(observed: DataFrame, order: str) -> DataFrame:
    """rule_id, status, matches and mismatches of candidate rules after their observations (rule_id, agreed) in order.

    A candidate becomes active at PROMOTE_AFTER matches without a mismatch; more than DISABLE_AFTER mismatches
    disable a rule for good. Both follow from running counts, so no rule's observations are collected.
    """
    from pyspark.sql import Window

    so_far = Window.partitionBy("rule_id").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = observed.withColumn("m", F.count_if(F.col("agreed")).over(so_far)).withColumn("x", F.count_if(~F.col("agreed")).over(so_far))
    out = counted.groupBy("rule_id").agg(F.max("m").alias("matches"), F.max("x").alias("mismatches"), F.bool_or((F.col("m") >= PROMOTE_AFTER) & (F.col("x") == 0)).alias("promoted"))
    status = F.when(F.col("mismatches") > DISABLE_AFTER, "DISABLED").when(F.col("promoted"), "ACTIVE").otherwise("CANDIDATE")
    return out.select("rule_id", status.alias("status"), "matches", "mismatches")
