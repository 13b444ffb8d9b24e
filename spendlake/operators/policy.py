"""Which alerts may be sent: caps, quiet hours, and what is fit for a joke."""

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spendlake.functions.categories import is_roastable
from spendlake.functions.times import in_quiet_hours, ist_day, ist_week

ROASTS_A_DAY, ROASTS_A_WEEK, OTHERS_A_DAY = 1, 4, 3
CAPPED = ("ROAST", "NUDGE")


def decision(kind: Column, quiet: Column, roast_level: Column, category: Column, roasts_today: Column, roasts_week: Column, capped_today: Column) -> Column:
    """Struct of decision (SEND, SEND_PLAIN, SUPPRESS) and reason for an alert, given what was sent before."""
    cases = [
        (kind == "CONFIRMATION", "SEND", None),
        (quiet, "SUPPRESS", "QUIET_HOURS"),
        (kind == "SUMMARY", "SEND", None),
        (capped_today >= OTHERS_A_DAY, "SUPPRESS", "DAILY_CAP"),
        (kind == "NUDGE", "SEND", None),
        (roast_level == "OFF", "SEND_PLAIN", "ROAST_OFF"),
        (~is_roastable(category), "SEND_PLAIN", "NOT_ROASTABLE"),
        ((roasts_today >= ROASTS_A_DAY) | (roasts_week >= ROASTS_A_WEEK), "SEND_PLAIN", "ROAST_CAP"),
        (F.lit(True), "SEND", None),
    ]
    out = None
    for when, verdict, reason in cases:
        value = F.struct(F.lit(verdict).alias("decision"), F.lit(reason).cast("string").alias("reason"))
        out = F.when(when, value) if out is None else out.when(when, value)
    return out


def sent_counts(alerts: DataFrame) -> DataFrame:
    """user_id, IST day: alerts sent that day under the cap, roasts that day, and roasts of the week up to that day."""
    from pyspark.sql import Window

    sent = alerts.where("status = 'SENT'").withColumn("day", ist_day(F.col("sent_at"))).withColumn("week", ist_week(F.col("sent_at")))
    roast = F.col("alert_type") == "ROAST"
    days = sent.groupBy("user_id", "week", "day").agg(F.count_if(F.col("alert_type").isin(*CAPPED)).alias("capped_today"), F.count_if(roast).alias("roasts_today"))
    so_far = Window.partitionBy("user_id", "week").orderBy("day")
    return days.withColumn("roasts_week", F.sum("roasts_today").over(so_far)).drop("week")


def gate(proposals: DataFrame) -> DataFrame:
    """proposals (id, user_id, alert_type, at, category, roast_level, quiet_start, quiet_end, dedupe_key) with decision and reason, decided one after another.

    What was sent before in the same IST day and week counts, so a user's week is decided in order; the task
    keeps counts only. A dedupe_key that a user has been sent (or was to be sent) before is a DUPLICATE.
    """
    from pyspark.sql import Window

    first = Window.partitionBy("user_id", "dedupe_key").orderBy("at", "id")
    again = F.col("dedupe_key").isNotNull() & (F.row_number().over(first) > 1)
    stateless = decision(F.col("alert_type"), in_quiet_hours(F.col("at"), F.col("quiet_start"), F.col("quiet_end")), F.col("roast_level"), F.col("category"), F.lit(0), F.lit(0), F.lit(0))
    rows = proposals.withColumn("again", again).withColumn("d", stateless).withColumn("day", ist_day(F.col("at"))).withColumn("week", ist_week(F.col("at")))
    rows = rows.select(*proposals.columns, "again", "day", "week", "d.decision", "d.reason")
    schema = T.StructType([*proposals.schema.fields, T.StructField("decision", T.StringType()), T.StructField("reason", T.StringType())])
    names, arrow = schema.names, to_arrow_schema(schema)

    def run(batches):
        group, day, roasts_week, roasts_today, capped = None, None, 0, 0, 0
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if (r["user_id"], r["week"]) != group:
                    group, day, roasts_week = (r["user_id"], r["week"]), None, 0
                if r["day"] != day:
                    day, roasts_today, capped = r["day"], 0, 0
                if r["again"]:
                    r["decision"], r["reason"] = "SUPPRESS", "DUPLICATE"
                elif r["alert_type"] in CAPPED and r["decision"] != "SUPPRESS":
                    if capped >= OTHERS_A_DAY:
                        r["decision"], r["reason"] = "SUPPRESS", "DAILY_CAP"
                    else:
                        capped += 1
                        if r["alert_type"] == "ROAST" and r["decision"] == "SEND":
                            if roasts_today >= ROASTS_A_DAY or roasts_week >= ROASTS_A_WEEK:
                                r["decision"], r["reason"] = "SEND_PLAIN", "ROAST_CAP"
                            else:
                                roasts_today, roasts_week = roasts_today + 1, roasts_week + 1
                out.append({c: r[c] for c in names})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return rows.repartition("user_id", "week").sortWithinPartitions("user_id", "week", "at", "id").mapInArrow(run, schema)


def task_gate(tasks: DataFrame, per_day: int = 12) -> DataFrame:
    """tasks (id, user_id, at, deadline, priority, now) that run: not too late, and among the first `per_day` of the user's IST day unless of priority 2 or more."""
    from pyspark.sql import Window

    in_time = tasks.where(F.col("deadline").isNull() | (F.col("now") <= F.col("deadline")))
    so_far = Window.partitionBy("user_id", ist_day(F.col("now"))).orderBy("now", "id").rowsBetween(Window.unboundedPreceding, -1)
    return in_time.withColumn("before", F.count(F.lit(1)).over(so_far)).where((F.col("before") < per_day) | (F.col("priority") >= 2)).drop("before")


def due_summaries(users: DataFrame, summaries: DataFrame, alerts: DataFrame, now: Column, at_minute: int = 21 * 60) -> DataFrame:
    """Daily summaries to send at `now` (from `at_minute` of the IST day on): user_id, dedupe_key, total_paise and n of users outside their quiet hours who haven't had the day's.

    users: user_id, quiet_start, quiet_end; summaries: user_id, day, total_paise, n; alerts: user_id, dedupe_key.
    """
    from spendlake.functions.times import minute_of_day

    key = F.concat(F.lit("daily:"), ist_day(now).cast("string"))
    open_now = users.where((minute_of_day(now) >= at_minute) & ~in_quiet_hours(now, F.col("quiet_start"), F.col("quiet_end"))).select("user_id", key.alias("dedupe_key"))
    new = open_now.join(alerts.select("user_id", "dedupe_key"), ["user_id", "dedupe_key"], "left_anti")
    today = summaries.where(F.col("day") == ist_day(now)).select("user_id", "total_paise", "n")
    return new.join(today, "user_id", "left").na.fill(0, ["total_paise", "n"])
