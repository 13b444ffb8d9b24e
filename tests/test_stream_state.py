"""What the merging of a stream's reports keeps in its state."""

from datetime import timedelta

from test_merging import SCHEMA, T0, frame, report

from spendlake.operators import merging
from spendlake.streaming import merging as live


def test_entries_grow_with_time_not_with_reports(spark, tmp_path):
    rows = [report(i, txn_time=T0 + timedelta(seconds=60 * i), amount_paise=100 + i, reference_id=f"R{i}", merchant_id=i) for i in range(1, 301)]
    frame(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/in")
    query = live.merge(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/check")
    query.awaitTermination()
    assert merging.latest(spark.read.parquet(f"{tmp_path}/out")).count() == 300
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 3 * 8 + 8  # packs, stretches of time and timers
