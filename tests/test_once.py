"""Dear steps stand once in the plan, so that a row's text is read once."""

from datetime import date

from pyspark.sql import functions as F

from spendlake.operators import forecast, memory, tiers


def times(df, step):
    return df._jdf.queryExecution().optimizedPlan().toString().count(step)


def test_an_answer_is_parsed_once(spark):
    rows = spark.createDataFrame([(1, '{"isTransaction": true, "amount": 5}'), (2, None), (3, "no")], "id int, answer string")
    out = rows.select("id", tiers.canonical(tiers.decoded(F.col("answer"))).alias("json"))
    assert times(out, "(?:`{3}(?:json)?)") == 1
    assert {r.id: r.json and r.json[:35] for r in out.collect()} == {1: '{"isTransaction":true,"amount":"5",', 2: None, 3: None}


def test_a_promise_is_looked_for_once(spark):
    said = spark.createDataFrame([(1, 7, "limit  tea to 2 times a week by 5 mar"), (2, 7, None), (3, 7, "hello")], "id int, user_id int, text string")
    jokes = spark.createDataFrame([(9, 7, "NOT_FAIR", "RENT"), (10, 7, "LIKED", "RENT")], "id int, user_id int, reaction string, category string")
    out = memory.written(said, jokes, F.lit(date(2026, 2, 1)))
    assert times(out, "regexp_replace(") == 1
    assert {(r.source, r.kind, r.content) for r in out.collect()} == {(1, "COMMITMENT", "limit tea to 2 times a week by 5 mar"), (9, "PREFERENCE", "Finds roasts about rent not fair")}


def test_a_run_draws_once_a_day(spark):
    kind = "user_id long, start_paise long, pool array<struct<weekday:int,paise:bigint>>, flow array<struct<ahead:int,paise:bigint>>, today date"
    rows = [(1, 100, [(d, 10) for d in range(7)], None, date(2026, 10, 1)), (2, 5, None, [(3, -5)], date(2026, 10, 1)), (3, 5, None, None, date(2026, 10, 1))]
    out = forecast.forecast_by_hash(spark.createDataFrame(rows, kind), runs=150)
    assert times(out, "md5(") == 1
    got = {r.user_id: (r.broke_p50, r.prob_broke) for r in out.collect()}
    assert got == {1: (date(2026, 10, 11), 1.0), 2: (date(2026, 10, 4), 1.0), 3: (None, 0.0)}
