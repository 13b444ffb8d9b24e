"""Watches on streams say what the tables say, late entries included."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from spendlake.operators import watches as tables
from spendlake.streaming import watches as live

T0 = datetime(2026, 3, 1)


def fed(spark, folder, rows, schema, parts):
    """A stream of rows in the order given, part by part; later parts move the watermark on."""
    size = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * size : (k + 1) * size], schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def written(spark, changes, base):
    query = changes.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/check").trigger(availableNow=True).start()
    query.awaitTermination()
    return query, spark.read.schema(changes.schema).parquet(f"{base}/out")


def shuffled_a_little(rows, at, draw, hours):
    """In order of time, but for some that come up to `hours` late."""
    return sorted(rows, key=lambda r: r[at] + timedelta(hours=draw.choice([0, 0, draw.random() * hours])))


def test_missing_cash_by_hand(spark):
    hour = lambda n: T0 + timedelta(hours=n)
    rows = [("w1", 1, "ATM_WITHDRAWAL", 1000, hour(0)), ("s1", 1, "CASH_SPEND", 599, hour(72)), ("w2", 2, "ATM_WITHDRAWAL", 1000, hour(0)), ("s2", 2, "CASH_SPEND", 600, hour(0)), ("w3", 3, "ATM_WITHDRAWAL", 1000, hour(0)), ("s3", 3, "CASH_SPEND", 900, hour(73)), ("w4", 4, "ATM_WITHDRAWAL", 10, hour(30)), ("w5", 5, "ATM_WITHDRAWAL", None, hour(0)), ("w6", None, "ATM_WITHDRAWAL", 10, hour(0)), ("w7", 5, "ATM_WITHDRAWAL", 10, None)]
    ledger = spark.createDataFrame(rows, "id string, user_id long, entry_type string, amount_paise long, occurred_at timestamp_ntz")
    got = tables.missing_cash(ledger, F.lit(hour(100)).cast("timestamp_ntz")).collect()
    assert sorted((r.id, r.logged_paise, r.due_at) for r in got) == [("w1", 599, hour(72)), ("w3", 0, hour(72)), ("w6", 0, hour(72))]
    assert tables.missing_cash(ledger.limit(0), F.lit(hour(100)).cast("timestamp_ntz")).count() == 0


def test_missing_cash_on_a_stream(spark, tmp_path):
    draw = random.Random(1)
    rows = [(f"c{i}", draw.randrange(3), draw.choice(["ATM_WITHDRAWAL", "CASH_SPEND", "UNACCOUNTED", "CASH_RECEIVED"]), draw.randint(1, 900), T0 + timedelta(minutes=draw.randrange(100_000))) for i in range(250)]
    last = T0 + timedelta(days=90)
    rows = [*shuffled_a_little(rows, 4, draw, 20), ("end", 9, "CASH_SPEND", 1, last)]
    schema = "id string, user_id long, entry_type string, amount_paise long, occurred_at timestamp_ntz"
    query, out = written(spark, live.missing_cash(fed(spark, f"{tmp_path}/in", rows, schema, 4), "1 day"), tmp_path)
    want = tables.missing_cash(spark.createDataFrame(rows, schema), F.lit(last - timedelta(days=1)).cast("timestamp_ntz"))
    assert want.count() > 20 and sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] < 10  # all matters are settled


PAYMENT = "id string, user_id long, amount_paise long, direction string, status string, channel string, merchant_raw string, reference_id string, promised_refund_days int, txn_time timestamp_ntz"


def test_refund_states_by_hand(spark):
    day = lambda n: T0 + timedelta(days=n)
    debit = lambda i, at, to="shop@ybl", ref=None, amount=500: (i, 1, amount, "DEBIT", "FAILED", "UPI", to, ref, None, day(at))
    credit = lambda i, at, amount, ref=None: (i, 1, amount, "CREDIT", "SUCCESS", "UPI", None, ref, None, day(at))
    rows = [debit("a", 0, "p12ab34cd@ybl", "R1", 11), credit("a1", 1, 12, "R1"), debit("b", 0, ref="R2", amount=21), credit("b1", 8, 22, "R2"), credit("b2", 10, 30_000), debit("c", 0, amount=31), credit("c1", 5.5, 31), debit("d", 0, amount=41), credit("d1", 31, 41), debit("e", 58, amount=51), debit("f", 40, amount=61)]
    rows += [("g", 1, 71, "CREDIT", "REFUND_INITIATED", "CARD", "x", None, 2, day(0)), credit("g1", 3, 71), debit("h", 0, ref="", amount=81), credit("h1", 1, 82, "")]
    got = {r.id: (r.case_type, r.state, r.days_late, r.owed_paise) for r in tables.refund_states(spark.createDataFrame(rows, PAYMENT), F.lit(day(60)).cast("timestamp_ntz")).collect()}
    assert got == {
        "a": ("UPI_P2P_FAILED", "REVERSED_ON_TIME", 0, 0), "b": ("UPI_P2M_FAILED", "COMPENSATED", 3, 30_000), "c": ("UPI_P2M_FAILED", "COMPENSATION_DRAFTED", 1, 10_000), "d": ("UPI_P2M_FAILED", "ESCALATION_DRAFTED", 0, 0),
        "e": ("UPI_P2M_FAILED", "WAITING", 0, 0), "f": ("UPI_P2M_FAILED", "OVERDUE", 0, 0), "g": ("ECOM_REFUND", "REVERSED_LATE", 1, 0), "h": ("UPI_P2M_FAILED", "ESCALATION_DRAFTED", 0, 0),
    }


def test_refund_states_on_a_stream(spark, tmp_path):
    draw = random.Random(2)
    rows = []
    for i in range(150):
        at, user, amount, ref = T0 + timedelta(minutes=draw.randrange(80_000)), draw.randrange(3), draw.randrange(10**6, 10**6 + 60), draw.choice([None, "", f"R{i}"])
        kind = draw.choice([("DEBIT", "FAILED"), ("DEBIT", "PENDING"), ("CREDIT", "REFUND_INITIATED"), ("DEBIT", "SUCCESS")])
        rows.append((f"p{i}", user, amount, *kind, "UPI", draw.choice(["p12ab34cd@ybl", "shop"]), ref, draw.choice([None, 2]), at))
        if draw.random() < 0.7:
            back = at + timedelta(minutes=draw.randrange(20_000))
            rows.append((f"b{i}", user, draw.choice([amount, amount + 7]), "CREDIT", draw.choice(["SUCCESS", "REVERSED"]), "UPI", None, draw.choice([ref, None]), None, back))
            rows.append((f"x{i}", user, 10_000 * draw.randint(1, 9), "CREDIT", "SUCCESS", "UPI", None, None, None, back + timedelta(days=draw.randrange(10))))
    last = T0 + timedelta(days=80)
    rows = [*shuffled_a_little(rows, 9, draw, 20), ("end", 9, 1, "CREDIT", "SUCCESS", "UPI", None, None, None, last)]
    query, out = written(spark, live.refund_states(fed(spark, f"{tmp_path}/in", rows, PAYMENT, 5), "1 day"), tmp_path)
    fields = ["id", "user_id", "case_type", "state", "paid_at", "days_late", "owed_paise", "compensated_at"]
    changes = out.groupBy("id").agg(F.max_by(F.struct(*out.columns), "known_at").alias("r")).select(*(f"r.{c}" for c in fields))
    want = tables.refund_states(spark.createDataFrame(rows, PAYMENT), F.lit(last - timedelta(days=1)).cast("timestamp_ntz")).select(*fields)
    states = {r.state for r in want.collect()}
    assert len(states) >= 5 and sorted(map(tuple, changes.collect()), key=repr) == sorted((tuple(r) for r in want.collect() if r.state != "WAITING"), key=repr)
