"""The watches of `operators.watches` on streams: keyed state and timers in event time.

A watch speaks when the watermark has passed the moment it waits for, so that entries which come late, but within
the lateness allowed, count as they do in a table.
"""

from datetime import UTC, datetime

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from spendlake.operators import watches as w
from spendlake.operators.cash import OUT_OF_WALLET
from spendlake.operators.watches import COMPENSATION_DAYS, DAY, ESCALATION_DAYS, HOUR, SAME_AMOUNT_DAYS, SAME_REFERENCE_DAYS
from spendlake.streaming.merging import STORE
from spendlake.streaming.processors import stateful


def moment(micros: int | None) -> datetime | None:
    return None if micros is None else datetime.fromtimestamp(micros // 1_000_000, UTC).replace(microsecond=micros % 1_000_000, tzinfo=None)


class Watch(StatefulProcessor):
    """A user's open matters, by id, and the money that may settle them, by time and amount; at most one timer, for the next moment at which a matter may change."""

    def init(self, handle) -> None:
        self.handle = handle
        self.matters = handle.getMapState("matters", "id string", self.MATTER)
        self.money = handle.getMapState("money", "micros long, id string", "amount long, reference_id string")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues):
        soonest = None
        for r in rows:
            if r.opens:
                self.matters.updateValue((r.id,), self.matter(r))
                soonest = min(soonest or r.wakes, r.wakes)
            else:
                self.money.updateValue((r.micros, r.id), (r.amount_paise, r.reference_id))
                soonest = min(soonest or r.micros, r.micros)
        self.wake(soonest, timerValues.getCurrentWatermarkInMs())
        yield from ()

    def wake(self, micros: int | None, watermark: int, rung: int | None = None) -> None:
        """A timer rings when the watermark is beyond `micros`, at once if it is already. rung: the one that rings now, which is still in the list."""
        if micros is None:
            return
        at = max(watermark, micros // 1000) + 1
        timers = [t for t in self.handle.listTimers() if t != rung]
        if not timers or at < min(timers):
            for t in timers:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs() * 1000
        money = sorted((micros, amount, reference) for (micros, _), (amount, reference) in self.money.iterator())
        known = [m for m in money if m[0] <= now]
        out, following = [], []
        first = now
        for (id_,), values in list(self.matters.iterator()):
            row, after, since = self.judged(id_, values, known, now)
            if row is not None:
                out.append(Row(id=id_, user_id=key[0], **row))
            if after is None:
                self.matters.removeKey((id_,))
            else:
                following.append(after)
                first = min(first, since)
        for micros, id_ in list(self.money.keys()):
            if micros < first:
                self.money.removeKey((micros, id_))
            elif micros > now:
                following.append(micros)
        self.wake(min(following, default=None), timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        yield from out


class CashWatch(Watch):
    MATTER = "micros long, amount long"

    def __init__(self, hours: int, percent: int):
        self.span, self.percent = hours * HOUR, percent

    def matter(self, r) -> tuple:
        return r.micros, r.amount_paise

    def judged(self, id_, values, known, now):
        micros, amount = values
        due = micros + self.span
        if now < due:
            return None, due, micros
        logged = sum(a or 0 for m, a, _ in known if micros <= m <= due)
        fires = amount is not None and logged * 100 < amount * self.percent
        return ({"amount_paise": amount, "logged_paise": logged, "due_at": moment(due)} if fires else None), None, None


def prepared(rows: DataFrame, at: str, late: str) -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    timed = rows.where(F.col(at).isNotNull()).withColumn("__at", F.col(at).cast("timestamp")).withColumn("micros", w.micros(at))
    return timed.withWatermark("__at", late)


def missing_cash(ledger: DataFrame, late: str = "1 day", hours: int = w.AFTER_HOURS, percent: int = w.SHARE) -> DataFrame:
    """`operators.watches.missing_cash` of a stream of cash entries, each withdrawal once, when the watermark has passed its time. Entries later than `late` are left out; ids are distinct. An entry leaves the state once no open withdrawal can look at it."""
    rows = prepared(ledger, "occurred_at", late).withColumn("opens", F.col("entry_type") == "ATM_WITHDRAWAL")
    rows = rows.where(F.col("opens") | F.col("entry_type").isin(OUT_OF_WALLET))
    chosen = rows.select("id", "user_id", "opens", "micros", "__at", (F.col("micros") + hours * HOUR).alias("wakes"), "amount_paise", F.lit(None).cast("string").alias("reference_id"))
    user = ledger.schema["user_id"].dataType.simpleString()
    return stateful(chosen.groupBy("user_id"), CashWatch(hours, percent), f"id string, user_id {user}, amount_paise long, logged_paise long, due_at timestamp_ntz")


class RefundWatch(Watch):
    MATTER = "case_type string, amount long, reference_id string, opened long, deadline long, per_day long, state string"

    def matter(self, r) -> tuple:
        return r.case_type, r.amount_paise, r.reference_id, r.micros, r.deadline, r.per_day_paise, "WAITING"

    def judged(self, id_, values, known, now):
        case_type, amount, reference, opened, deadline, per_day, before = values
        paid = min((m for m, a, ref in known if m >= opened and (a == amount and m <= opened + SAME_AMOUNT_DAYS * DAY or reference and ref == reference and m <= opened + SAME_REFERENCE_DAYS * DAY)), default=None)
        late = owed = 0
        extra, after = None, None
        last = opened + SAME_REFERENCE_DAYS * DAY
        if paid is None:
            escalated = deadline + ESCALATION_DAYS * DAY
            state = "WAITING" if now <= deadline else "OVERDUE" if now <= escalated else "ESCALATION_DRAFTED"
            after = next((t for t in (deadline, escalated, last) if t >= now), None)
        else:
            late = max(0, -((deadline - paid) // DAY))
            owed = late * per_day
            extra = min((m for m, a, _ in known if owed and a == owed and paid <= m <= paid + COMPENSATION_DAYS * DAY), default=None)
            drafted = paid + COMPENSATION_DAYS * DAY
            state = "REVERSED_ON_TIME" if not late else "COMPENSATED" if extra is not None else "COMPENSATION_DRAFTED" if owed and now > drafted else "REVERSED_LATE"
            if state == "REVERSED_LATE" and owed:
                after = drafted
        if after is not None:
            self.matters.updateValue((id_,), (*values[:-1], state))
        row = {"case_type": case_type, "state": state, "known_at": moment(now), "paid_at": moment(paid), "days_late": late, "owed_paise": owed, "compensated_at": moment(extra)}
        return (row if state != before else None), after, opened


def refund_states(payments: DataFrame, late: str = "1 day") -> DataFrame:
    """Changes of refund cases of a stream of payments: id, user_id, case_type, the state it has come to, when that was known (the watermark), paid_at, days_late, owed_paise and compensated_at.

    A case's last change is what `operators.watches.refund_states` gives for the watermark; one without any is
    WAITING. A case is forgotten once it is settled, or nothing can pay it back any more.
    """
    rows = w.with_case(prepared(payments, "txn_time", late)).withColumn("opens", F.col("case_type").isNotNull())
    rows = rows.where(F.col("opens") | F.expr(w.CAME)).withColumn("deadline", w.micros("deadline_at")).withColumn("reference_id", F.nullif(F.col("reference_id"), F.lit("")))
    chosen = rows.select("id", "user_id", "opens", "micros", "__at", F.col("micros").alias("wakes"), "amount_paise", "reference_id", "case_type", "deadline", "per_day_paise")
    user = payments.schema["user_id"].dataType.simpleString()
    fields = f"id string, user_id {user}, case_type string, state string, known_at timestamp_ntz, paid_at timestamp_ntz, days_late int, owed_paise long, compensated_at timestamp_ntz"
    return stateful(chosen.groupBy("user_id"), RefundWatch(), fields)
