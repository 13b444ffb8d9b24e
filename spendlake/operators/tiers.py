"""Tiers of parsing held against each other, what came of messages, and models' answers as extractions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlake.functions.binding import once
from spendlake.functions.grounding import same_extraction
from spendlake.functions.ids import derived, in_sample
from spendlake.operators.parsing import CHANNELS, CONFIDENCE, DIRECTIONS, EXTRACTION, STATUSES

SHADOW_RATE = 0.1


def agreement(a: Column, b: Column) -> Column:
    """Whether two answers agree: both missing, both no payment, or the same fields."""
    payment = lambda x: F.coalesce(x["is_transaction"], F.lit(False))
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).when(~payment(a) | ~payment(b), payment(a) == payment(b)).otherwise(same_extraction(a, b))


def outcome(x: Column, failure: Column) -> Column:
    return F.when(x.isNull() | (failure.isNotNull() & (failure != "NOT_TRANSACTION")), "FAILED").when(failure == "NOT_TRANSACTION", "NOT_TRANSACTION").otherwise("TRANSACTION")


def shadow_records(messages: DataFrame, first: str, second: str, rate: float = SHADOW_RATE) -> DataFrame:
    """A record for each sampled message: id, raw_event_id, outcome of both tiers and whether they agree; no text leaves.

    messages: event_id, text, and a column with an extraction (or null) for each tier. The sample follows from
    the event's id, so a message that comes again is chosen again.
    """
    from spendlake.functions.grounding import failure

    rows = messages.where(in_sample(F.col("event_id"), rate))
    one, two = F.col(first), F.col(second)
    return rows.select(
        derived(F.lit("shadow"), F.col("event_id")).alias("id"), F.col("event_id").alias("raw_event_id"),
        outcome(one, failure(one, F.col("text"))).alias("first"), outcome(two, failure(two, F.col("text"))).alias("second"), agreement(one, two).alias("agreement"),
    )


def outcome_counts(parsed: DataFrame) -> DataFrame:
    """outcome, detail (the method of parsed ones, else the reason) and n of parsed messages."""
    detail = F.when(F.col("outcome") == "PARSED", F.col("parse_method")).when(F.col("outcome") == "NOT_TRANSACTION", None).otherwise(F.col("reason"))
    return parsed.groupBy("outcome", detail.alias("detail")).agg(F.count(F.lit(1)).alias("n"))


#: Details that outcomes have by themselves; plug-ins and models may bring others, which are counted together.
DETAILS = {
    "PARSED": list(CONFIDENCE),
    "DROPPED": ["EMPTY", "OTP", "COLLECT_REQUEST", "PROMO", "BALANCE_ONLY", "NO_AMOUNT"],
    "NOT_TRANSACTION": [None],
    "FAILED": ["NO_TIER", "MISSING_AMOUNT", "BAD_AMOUNT", "AMOUNT_NOT_IN_TEXT", "REFERENCE_NOT_IN_TEXT", "MISSING_DIRECTION", "DIRECTION_MISMATCH", "FAILED_WITHOUT_KEYWORD", "REVERSED_WITHOUT_KEYWORD", "BAD_BALANCE"],
}


def observed(parsed: DataFrame, observation) -> DataFrame:
    """parsed, counted while it is written: no second pass over it.

    observation: pyspark.sql.Observation for a table (metrics after the first action), or a name on a stream
    (metrics in each progress). `counted` makes rows of the metrics.
    """
    detail = F.when(F.col("outcome") == "PARSED", F.col("parse_method")).otherwise(F.col("reason"))
    metrics = []
    for outcome, details in DETAILS.items():
        is_it = F.col("outcome") == outcome
        known = [d for d in details if d is not None]
        metrics += [F.count_if(is_it & (detail == d)).alias(f"{outcome}:{d}") for d in known]
        other = is_it if not known else is_it & ~F.coalesce(detail.isin(known), F.lit(False))
        metrics.append(F.count_if(other).alias(f"{outcome}:" if not known else f"{outcome}:*"))
    return parsed.observe(observation, *metrics)


def counted(metrics: dict[str, int]) -> dict[tuple[str, str | None], int]:
    """Counts by (outcome, detail) of observed metrics, those that aren't zero; detail `*` stands for others than the known ones."""
    return {(name.split(":")[0], name.split(":")[1] or None): n for name, n in metrics.items() if n}


FIELDS = {"isTransaction": "is_transaction", "amount": "amount", "direction": "direction", "channel": "channel", "status": "status", "merchantRaw": "merchant_raw", "counterpartyVpa": "counterparty_vpa", "referenceId": "reference_id", "accountHint": "account_hint", "balanceAfter": "balance_after", "promisedRefundDays": "promised_refund_days"}


def decoded(text: Column) -> Column:
    """The extraction in a model's answer: a JSON object, perhaps in a code fence, with camel or snake names; null if there is none.

    Numbers become decimal texts without trailing zeros, so that no amount passes through floating point. An unknown
    channel is UNKNOWN, a missing status SUCCESS; an unknown direction or status spoils the answer, as does one
    without is_transaction. Blank names are null. A text is read once, and each field once.
    """
    plain = F.regexp_replace(F.regexp_replace(text, r"^\s*(?:`{3}(?:json)?)?\s*", ""), r"\s*(?:`{3})?\s*$", "")
    get = lambda value, n: F.coalesce(F.try_variant_get(value, f"$.{n}", "string"), F.try_variant_get(value, f"$.{FIELDS[n]}", "string"))
    fields = lambda p: once(F.try_parse_json(p), lambda value: F.struct(p.startswith("{").alias("is_object"), *(get(value, n).alias(n) for n in FIELDS)))
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))

    def checked(f: Column) -> Column:
        days = f["promisedRefundDays"]
        out = F.struct(
            (f["isTransaction"] == "true").alias("is_transaction"), f["amount"].alias("amount"), f["direction"].alias("direction"),
            F.when(f["channel"].isin(*CHANNELS), f["channel"]).otherwise("UNKNOWN").alias("channel"), F.coalesce(f["status"], F.lit("SUCCESS")).alias("status"),
            F.when(blank(f["merchantRaw"]).isNotNull(), f["merchantRaw"]).alias("merchant_raw"), F.when(blank(f["counterpartyVpa"]).isNotNull(), f["counterpartyVpa"]).alias("counterparty_vpa"),
            f["referenceId"].alias("reference_id"), f["accountHint"].alias("account_hint"), f["balanceAfter"].alias("balance_after"), days.try_cast("int").alias("promised_refund_days"),
        )
        good = f["is_object"] & f["isTransaction"].isin("true", "false") & (f["direction"].isNull() | f["direction"].isin(*DIRECTIONS)) & (f["status"].isNull() | f["status"].isin(*STATUSES)) & (days.isNull() | days.rlike("^[0-9]{1,9}$"))
        return F.when(good, out).cast(EXTRACTION)

    return once(once(plain, fields), checked)


def canonical(x: Column) -> Column:
    """An extraction as the JSON that models learn: fields in their fixed order, compact, nulls kept."""
    return once(x, lambda v: F.when(v.isNotNull(), F.to_json(F.struct(*(v[own].alias(name) for name, own in FIELDS.items())), {"ignoreNullFields": "false"})))
