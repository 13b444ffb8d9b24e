"""Streams give what batches give, and a restarted stream writes nothing twice."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from spendlake.operators import parsing, triggers
from spendlake.sources.seeds import seed_rules
from spendlake.streaming import jobs

T0 = datetime(2026, 2, 1)
EVENT = "event_id string, sender string, source_app string, text string, posted_at timestamp"


def events(numbers):
    return [(f"e{i}", "AX-HDFCBK", None, f"Rs.{i}.00 debited from A/c XX9911 on 04-10-26 to VPA a@ybl. UPI Ref 70001111{i:04d}" if i % 3 else f"Rs {i} sent somewhere", T0 + timedelta(minutes=i)) for i in numbers]


def test_parse_stream_restarts_and_drops_repeats(spark, tmp_path):
    rules = parsing.rule_table(spark, seed_rules())

    def run():
        stream = jobs.once_each(spark.readStream.schema(EVENT).parquet(str(tmp_path / "in")))
        jobs.parse_stream(stream, rules, str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "check")).awaitTermination()

    spark.createDataFrame(events([*range(1, 20), 5, 6]), EVENT).write.parquet(str(tmp_path / "in"))
    run()
    spark.createDataFrame(events(range(10, 31)), EVENT).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    run()
    good, bad = spark.read.parquet(str(tmp_path / "good")), spark.read.parquet(str(tmp_path / "bad"))
    assert sorted(r.amount_paise for r in good.collect()) == [100 * i for i in range(1, 31) if i % 3]
    assert sorted(r.event_id for r in bad.collect()) == sorted(f"e{i}" for i in range(1, 31) if not i % 3)


def test_running_budget_like_the_batch(spark, tmp_path):
    rows = [(f"t{i:03d}", i % 3, "RENT" if i % 2 else "TRAVEL", 700 + i, "DEBIT", "SPEND", "SUCCESS", T0 + timedelta(hours=i)) for i in range(120)]
    schema = "id string, user_id long, category string, amount_paise long, direction string, kind string, status string, txn_time timestamp"
    limits = spark.createDataFrame([(u, c, 12_000) for u in range(3) for c in ("RENT", "TRAVEL")], "user_id long, category string, monthly_limit_paise long")
    for a in (0, 40, 80):
        spark.createDataFrame(rows[a : a + 40], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = jobs.running_budget(stream, limits).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination()
    batch = triggers.budget_crossings(spark.createDataFrame(rows, schema).withColumn("txn_time", F.col("txn_time").cast("timestamp_ntz")), limits)
    want = sorted((r.user_id, r.category, r.crossed, r.spent_paise) for r in batch.collect())
    assert want and sorted((r.user_id, r.category, r.crossed, r.spent_paise) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == want


def test_budgets_of_past_months_leave_the_state(spark, tmp_path):
    schema = "id string, user_id long, category string, amount_paise long, direction string, kind string, status string, txn_time timestamp"
    limits = spark.createDataFrame([(1, "RENT", 100)], "user_id long, category string, monthly_limit_paise long")
    for month in range(1, 9):
        spark.createDataFrame([(f"t{month}{i}", 1, "RENT", 60, "DEBIT", "SPEND", "SUCCESS", datetime(2026, month, 10 + i)) for i in range(2)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = jobs.running_budget(stream, limits).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 2
    assert sorted((r.month.month, r.crossed, r.spent_paise) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(m, 100, 120) for m in range(1, 9)]


def test_written_once(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        jobs.written_once(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"), lambda df: df.where("id > 4")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
