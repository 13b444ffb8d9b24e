"""Topics: order by key, offsets, batches that run again, dead letters with their reason."""

import pytest
from pyspark.sql import functions as F

from spendlake.sources import topics


def rows(spark, numbers):
    return spark.createDataFrame([(i, i % 5, f"text {i}") for i in numbers], "seq long, user_id long, text string").repartition(3)


def read(spark, path):
    return spark.read.format("topic").load(path).collect()


def by_key(records):
    out = {}
    for r in sorted(records, key=lambda r: (r.partition, r.offset)):
        out.setdefault(r.key, []).append(r.value)
    return out


def test_order_and_offsets(spark, tmp_path):
    topics.register(spark)
    path = f"file://{tmp_path}/t"
    for part in (range(0, 50), range(50, 120)):
        topics.publish(rows(spark, part), path, "user_id", "seq", F.col("seq").cast("string"), partitions=3)
    got = read(spark, path)
    assert by_key(got) == {str(u): [str(i) for i in range(120) if i % 5 == u] for u in range(5)}
    for p in {r.partition for r in got}:
        assert sorted(r.offset for r in got if r.partition == p) == list(range(sum(r.partition == p for r in got)))
    assert topics.Log(path).ends() == {str(p): sum(r.partition == p for r in got) for p in {r.partition for r in got}}
    nulls = spark.createDataFrame([(1, None, None), (2, None, "x")], "seq long, user_id long, text string")
    topics.publish(nulls, f"{path}2", "user_id", "seq", F.col("text"), F.create_map(F.lit("a"), F.lit("b")))
    assert [(r.key, r.value, r.headers, r.partition) for r in read(spark, f"{path}2")] == [(None, None, {"a": "b"}, 0), (None, "x", {"a": "b"}, 0)]
    topics.publish(nulls.limit(0), f"{path}3", "user_id", "seq")
    assert read(spark, f"{path}3") == []


def test_a_killed_query_resumes_without_loss_or_repeat(spark, tmp_path):
    topics.register(spark)
    source, good, dead, check = (f"file://{tmp_path}/{n}" for n in ("in", "good", "dead", "check"))
    topics.publish(rows(spark, range(60)), source, "user_id", "seq", F.col("seq").cast("string"), partitions=3)
    broken = {"left": 4, "calls": 0}

    def handle(batch):
        broken["calls"] += 1
        if broken["left"]:
            broken["left"] -= 1
            raise ConnectionError("down")
        return batch.withColumn("reason", F.when(F.col("value").cast("int") % 7 == 0, "SEVENTH"))

    def run(tries=3):
        stream = spark.readStream.format("topic").load(source)
        topics.consume(stream, handle, good, dead, check, tries, pause=0.01).awaitTermination()

    with pytest.raises(Exception, match="down"):
        run()
    assert broken["calls"] == 3
    run()  # once more down, then well
    topics.publish(rows(spark, range(60, 100)), source, "user_id", "seq", F.col("seq").cast("string"), partitions=3)
    run()
    run()
    assert by_key(read(spark, good)) == {str(u): [str(i) for i in range(100) if i % 5 == u and i % 7] for u in range(5)}
    letters = read(spark, dead)
    assert sorted(int(r.value) for r in letters) == list(range(0, 100, 7))
    origin = {r.value: (str(r.partition), str(r.offset)) for r in read(spark, source)}
    assert all(r.headers["reason"] == "SEVENTH" and (r.headers["partition"], r.headers["offset"]) == origin[r.value] for r in letters)
    before = len(topics.Log(good).entries())
    topics.written(spark.read.format("topic").load(source), good, 0)  # a batch that runs again
    assert len(topics.Log(good).entries()) == before


def test_streams_write_topics(spark, tmp_path):
    topics.register(spark)
    source, out = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    topics.publish(rows(spark, range(20)), source, "user_id", "seq", F.col("seq").cast("string"))
    for _ in range(2):
        stream = spark.readStream.format("topic").load(source)
        stream.writeStream.format("topic").option("path", out).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert sorted(int(r.value) for r in read(spark, out)) == list(range(20))
