"""Reports merged on a stream give the payments of the batch, and the state forgets."""

import os
import random
from datetime import timedelta

import pytest
from test_merging import SCHEMA, T0, TABLES, frame, report

from spendlake.operators import merging
from spendlake.streaming import merging as live

FIELDS = ["payment", "version", "kind", "status", "category", "reference_id", "account_hint", "merchant_id", "balance_after_paise", "merchant_raw", "txn_time"]


def rows_of(changelog):
    return sorted((tuple(r) for r in merging.latest(changelog).select(*FIELDS).collect()), key=repr)


def feed(spark, folder, rows, parts):
    """Reports in order of arrival, as files that the stream takes one by one."""
    size = -(-len(rows) // parts)
    for k in range(parts):
        frame(spark, rows[k * size : (k + 1) * size]).coalesce(1).write.mode("append").parquet(folder)


def run(spark, base, **more):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    query = live.merge(stream, f"{base}/out", f"{base}/check", **more)
    query.awaitTermination()
    return query


def drawn(n, seconds, seed):
    """Reports that arrive about in order of their time, some up to two days late, some twice."""
    draw = random.Random(seed)
    times = sorted(draw.randrange(seconds) for _ in range(n))
    return [
        report(
            seq, event_id=f"e{draw.randrange(9 * n // 10)}" if draw.random() < 0.2 else f"x{seq}", user_id=draw.randrange(4), raw_type=draw.choice(["RAW_NOTIFICATION", "RAW_SMS"]), source_app=draw.choice(["a", "b", None]), amount_paise=draw.choice([100, 200, 300]), direction=draw.choice(["DEBIT", "DEBIT", "CREDIT"]),
            status=draw.choice(["SUCCESS", "PENDING", "REFUND_INITIATED", "REVERSED"] if draw.random() < 0.3 else ["SUCCESS"]), channel=draw.choice(["UPI", "UPI", "ATM"]), txn_time=T0 + timedelta(seconds=max(0, times[seq - 1] - draw.choice([0, 0, 0, 100, 40_000, 150_000]))), merchant_raw=draw.choice([None, "zomato", "Zomatto Ltd", "uber", "12@ybl"]),
            merchant_id=draw.choice([None, None, 1, 2, 3]), reference_id=draw.choice([None, None, f"R{draw.randrange(n // 8)}"]), account_hint=draw.choice([None, "1", "2"]), balance_after_paise=draw.choice([None, 5]),
        )
        for seq in range(1, n + 1)
    ]


@pytest.mark.parametrize("seconds", [300_000, 9_000_000])
def test_batches_of_a_stream_like_the_batch(spark, tmp_path, seconds):
    rows = drawn(400, seconds, 3)
    feed(spark, f"{tmp_path}/in", rows[:250], 2)
    run(spark, tmp_path)
    feed(spark, f"{tmp_path}/in", rows[250:], 2)
    run(spark, tmp_path)
    got = spark.read.parquet(f"{tmp_path}/out")
    before = got.count()
    run(spark, tmp_path)  # nothing is left
    assert spark.read.parquet(f"{tmp_path}/out").count() == before
    assert rows_of(got) == rows_of(merging.payments(frame(spark, rows)))
    assert got.select("payment", "version").distinct().count() == before


def test_the_state_forgets(spark, tmp_path):
    rows = [report(i, txn_time=T0 + timedelta(hours=6 * i), reference_id=f"R{i}", merchant_id=i) for i in range(1, 1201)]
    feed(spark, f"{tmp_path}/in", rows, 6)
    query = run(spark, tmp_path, late="1 day", horizon=20)
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
    assert max(sizes) > 0 and sizes[-1] <= sizes[1] and merging.latest(spark.read.parquet(f"{tmp_path}/out")).count() == 1200


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="the test tables are not here")
def test_query_like_the_batch(spark):
    from spendlake.plans import flows, live as plans

    want = sorted(map(tuple, flows.QUERIES["dedup_merge"](spark, TABLES).collect()), key=repr)
    assert want and sorted(map(tuple, plans.QUERIES["dedup_stream"](spark, TABLES).select(*flows.QUERIES["dedup_merge"](spark, TABLES).columns).collect()), key=repr) == want
