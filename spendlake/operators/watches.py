"""What should have come and did not: cash that nobody logged, money that was not paid back.

Both look forward in time from an event, by range windows over rows dealt by user and what must be alike, so a
watch costs a sort and no join of each event with all later ones. `streaming.watches` does the same by timers.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlake.functions.text import is_person_vpa
from spendlake.operators.cash import OUT_OF_WALLET

HOUR = 3_600_000_000
DAY = 24 * HOUR
#: Hours after which a withdrawal is looked at, and the share of it that should be logged by then.
AFTER_HOURS, SHARE = 72, 60

# Days until money must be back, and what each day beyond is worth in paise.
DEADLINE_DAYS = {"UPI_P2P_FAILED": 1, "UPI_P2M_FAILED": 5, "ECOM_REFUND": 7}
PER_DAY_PAISE = {"UPI_P2P_FAILED": 10_000, "UPI_P2M_FAILED": 10_000, "ECOM_REFUND": 0}
#: Days in which a credit of the same amount, or of the same reference, pays a case back; in which compensation may come; after which an overdue case is escalated.
SAME_AMOUNT_DAYS, SAME_REFERENCE_DAYS = 30, 90
COMPENSATION_DAYS, ESCALATION_DAYS = 7, 30
CASE = ["id", "user_id", "case_type", "amount_paise", "reference_id", "opened_at", "deadline_at", "per_day_paise"]


def micros(at: str | Column) -> Column:
    return F.unix_micros((F.col(at) if isinstance(at, str) else at).cast("timestamp"))


def moment(value: Column) -> Column:
    return F.timestamp_micros(value).cast("timestamp_ntz")


def missing_cash(ledger: DataFrame, until: Column, hours: int = AFTER_HOURS, percent: int = SHARE) -> DataFrame:
    """id, user_id, amount_paise, logged_paise and due_at of withdrawals of which less than `percent` of a hundred was logged within `hours` (the withdrawal's own moment and the last one count).

    Withdrawals that are not due by `until` are left out. Each withdrawal looks at all entries of its time, those
    that another withdrawal looks at too. Null amounts count as nothing, and entries without time take no part.
    """
    ahead = Window.partitionBy("user_id").orderBy(micros("occurred_at")).rangeBetween(0, hours * HOUR)
    spent = F.when(F.col("entry_type").isin(OUT_OF_WALLET), F.col("amount_paise"))
    rows = ledger.where("occurred_at IS NOT NULL").withColumn("logged_paise", F.coalesce(F.sum(spent).over(ahead), F.lit(0)).cast("long"))
    due = moment(micros("occurred_at") + hours * HOUR)
    fires = (F.col("entry_type") == "ATM_WITHDRAWAL") & (F.col("logged_paise") * 100 < F.col("amount_paise") * percent) & (due <= until)
    return rows.where(fires).select("id", "user_id", "amount_paise", "logged_paise", due.alias("due_at"))


def by_type(values: dict[str, int]) -> Column:
    return F.element_at(F.create_map(*(F.lit(v) for kv in values.items() for v in kv)), F.col("case_type"))


def with_case(payments: DataFrame) -> DataFrame:
    """payments with case_type, deadline_at and per_day_paise of the case that each opens: UPI debits that failed or hang, to a person or to a merchant, and refunds that were promised; null for the others."""
    failed = (F.col("direction") == "DEBIT") & (F.col("channel") == "UPI") & F.col("status").isin("FAILED", "PENDING")
    kind = F.when(failed, F.when(is_person_vpa(F.col("merchant_raw")), "UPI_P2P_FAILED").otherwise("UPI_P2M_FAILED")).when(F.col("status") == "REFUND_INITIATED", "ECOM_REFUND")
    rows = payments.withColumn("case_type", kind)
    days = F.when(F.col("case_type") == "ECOM_REFUND", F.coalesce("promised_refund_days", by_type(DEADLINE_DAYS))).otherwise(by_type(DEADLINE_DAYS))
    return rows.withColumn("deadline_at", moment(micros("txn_time") + days * F.lit(DAY))).withColumn("per_day_paise", by_type(PER_DAY_PAISE).cast("long"))


def opened(payments: DataFrame) -> DataFrame:
    """The cases (CASE) that payments open."""
    rows = with_case(payments).where("case_type IS NOT NULL AND txn_time IS NOT NULL")
    return rows.withColumn("opened_at", F.col("txn_time")).select(*CASE)


#: Money that has come.
CAME = "direction = 'CREDIT' AND status IN ('SUCCESS', 'REVERSED')"


def credits_of(payments: DataFrame) -> DataFrame:
    return payments.where(CAME).where("txn_time IS NOT NULL").select("user_id", "amount_paise", "reference_id", F.col("txn_time").alias("at"))


def first_ahead(cases: DataFrame, credits_: DataFrame, key: str, of_case: str, since: str, days: int) -> DataFrame:
    """id and `found`: the first credit of the case's user within `days` from `since` whose `key` is the case's `of_case`. Only cases and credits that have it take part."""
    ours = cases.where(F.col(of_case).isNotNull() & F.col(since).isNotNull()).select("id", "user_id", F.col(of_case).alias("k"), micros(since).alias("m"), F.lit(None).cast("long").alias("paid"))
    theirs = credits_.where(F.col(key).isNotNull()).select(F.lit(None).cast(cases.schema["id"].dataType).alias("id"), "user_id", F.col(key).alias("k"), micros("at").alias("m"), micros("at").alias("paid"))
    ahead = Window.partitionBy("user_id", "k").orderBy("m").rangeBetween(0, days * DAY)
    return ours.union(theirs).withColumn("found", F.min("paid").over(ahead)).where("id IS NOT NULL AND found IS NOT NULL").select("id", "found")


def refund_states(payments: DataFrame, until: Column) -> DataFrame:
    """Cases with state, paid_at, days_late, owed_paise and compensated_at as they stand at `until`.

    payments: id, user_id, amount_paise, direction, status, channel, merchant_raw, reference_id,
    promised_refund_days, txn_time; ids are distinct. A case is paid back by the first credit of its user with its
    reference (within SAME_REFERENCE_DAYS) or its amount (within SAME_AMOUNT_DAYS), whichever comes first; one
    credit may pay several. States: WAITING, REVERSED_ON_TIME, REVERSED_LATE (owed: each day begun beyond the
    deadline), COMPENSATED (a credit of what is owed within COMPENSATION_DAYS), COMPENSATION_DRAFTED (none came),
    OVERDUE, ESCALATION_DRAFTED (ESCALATION_DAYS after the deadline). What happens after `until` isn't known.
    """
    known = payments.where(F.col("txn_time") <= until)
    cases, came = opened(known), credits_of(known)
    reference = F.nullif(F.col("reference_id"), F.lit(""))
    by_reference = first_ahead(cases.withColumn("reference_id", reference), came.withColumn("reference_id", reference), "reference_id", "reference_id", "opened_at", SAME_REFERENCE_DAYS)
    by_amount = first_ahead(cases, came, "amount_paise", "amount_paise", "opened_at", SAME_AMOUNT_DAYS)
    paid = by_reference.union(by_amount).groupBy("id").agg(F.min("found").alias("paid"))
    late = F.greatest(F.lit(0), F.ceil((F.col("paid") - micros("deadline_at")) / F.lit(DAY))).cast("int")
    rows = cases.join(paid, "id", "left").withColumn("paid_at", moment(F.col("paid"))).withColumn("days_late", late)
    rows = rows.withColumn("owed_paise", F.coalesce(F.col("days_late") * F.col("per_day_paise"), F.lit(0)).cast("long"))
    wanted = rows.where("owed_paise > 0")
    extra = first_ahead(wanted, came, "amount_paise", "owed_paise", "paid_at", COMPENSATION_DAYS)
    rows = rows.join(extra.withColumnRenamed("found", "extra"), "id", "left").withColumn("compensated_at", moment(F.col("extra")))
    now = micros(until)
    overdue = now - micros("deadline_at")
    state = (
        F.when(F.col("paid").isNull(), F.when(overdue <= 0, "WAITING").when(overdue <= ESCALATION_DAYS * DAY, "OVERDUE").otherwise("ESCALATION_DRAFTED"))
        .when(F.col("days_late") == 0, "REVERSED_ON_TIME")
        .when(F.col("extra").isNotNull(), "COMPENSATED")
        .when((F.col("owed_paise") > 0) & (now - F.col("paid") > COMPENSATION_DAYS * DAY), "COMPENSATION_DRAFTED")
        .otherwise("REVERSED_LATE")
    )
    return rows.withColumn("state", state).select(*CASE, "state", "paid_at", F.coalesce("days_late", F.lit(0)).alias("days_late"), "owed_paise", "compensated_at")
