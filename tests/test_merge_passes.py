"""The two passes of merging share what they can."""

from datetime import timedelta

from pyspark.sql import functions as F
from test_merging import T0, frame, report

from spendlake.operators import merging


def test_islands_are_numbered_once_and_times_stay(spark, monkeypatch):
    calls, islands = [], merging.islands
    monkeypatch.setattr(merging, "islands", lambda rows: calls.append(1) or islands(rows))
    rows = [report(i, txn_time=T0 + timedelta(days=i % 3 * 5, microseconds=i)) for i in range(1, 9)]
    for kind in ("timestamp_ntz", "timestamp"):
        calls.clear()
        df = frame(spark, rows).withColumn("txn_time", F.col("txn_time").cast(kind))
        out = merging.payments(df)
        assert out.schema["txn_time"].dataType.simpleString() == kind
        assert out.join(df.select(F.col("seq").alias("payment"), F.col("txn_time").alias("own")), "payment").where("txn_time <> own OR txn_time IS NULL").count() == 0
        assert out.count() == 8 and len(calls) == 1
