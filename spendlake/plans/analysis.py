"""Queries on forecasts, labelled datasets, memories and streams."""

import uuid
from datetime import date, datetime

from pyspark.sql import functions as F

from spendlake.operators import datasets, forecast, memory
from spendlake.plans.payments import with_txn
from spendlake.sources import tables as t
from spendlake.sources.scratch import shared_dir
from spendlake.streaming import jobs

NOW = datetime(2024, 1, 28, 12)
TODAY = date(2024, 1, 29)
START = 40_000


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def today():
    return F.lit(TODAY)


def stated(s, d):
    """Payments; some state the balance after them."""
    return t.transactions(s, d).withColumn("balance_after_paise", F.when(F.col("k") % 6 == 0, F.col("amount_paise") * 7))


def past(s, d):
    """Signed payments of one payee string for each user and day of the month, so that some repeat."""
    rows = t.transactions(s, d).where("status = 'SUCCESS'")
    return rows.select("user_id", "id", F.concat_ws(":", "merchant_raw", F.col("k") % 2).alias("key"), F.when(F.col("direction") == "CREDIT", 5_000).otherwise(-1_000 - F.col("k")).cast("long").alias("amount_paise"), F.to_date(F.col("txn_time") + F.expr("INTERVAL 330 MINUTES")).alias("day"), "category")


def days(s, d, explained=None):
    return forecast.spending_days(t.transactions(s, d), today(), explained)


def forecast_rows(s, d, cut=None, runs=forecast.RUNS):
    balances = t.transactions(s, d).select("user_id").distinct().withColumn("start_paise", F.lit(START).cast("long"))
    items, explained = forecast.recurring(past(s, d))
    return forecast.forecast(forecast.inputs(balances, days(s, d, explained), items, today(), cut_percent=cut), runs=runs)


HASHED_RUNS = 400


def hashed_forecast(s, d):
    """The forecast with draws that any database can repeat; from all spending."""
    balances = t.transactions(s, d).select("user_id").distinct().withColumn("start_paise", F.lit(START).cast("long"))
    rows = forecast.inputs(balances, days(s, d), forecast.recurring(past(s, d))[0], today())
    return forecast.forecast_by_hash(rows, runs=HASHED_RUNS)


def backtested(s, d):
    """Users as cases: the forecast of the median day from the first three weeks' spending against the last days as they came.

    The horizon is 9 days, not 45: the table ends 9 days after the split.
    """
    split = date(2024, 1, 21)
    cases = t.transactions(s, d).select("user_id").distinct().withColumn("start_paise", F.lit(START).cast("long"))
    items, explained = forecast.recurring(past(s, d).where(F.col("day") < F.lit(split)))
    before = forecast.spending_days(t.transactions(s, d), F.lit(split), explained)
    predicted = forecast.forecast(forecast.inputs(cases, before, items, F.lit(split), 9), 9)
    spent = t.transactions(s, d).where("status = 'SUCCESS' AND kind = 'SPEND'").withColumn("ahead", F.datediff(F.to_date(F.col("txn_time") + F.expr("INTERVAL 330 MINUTES")), F.lit(split))).where("ahead BETWEEN 1 AND 9")
    flows = spent.groupBy(F.col("user_id").alias("case_id"), "ahead").agg((-F.sum("amount_paise")).alias("paise")).withColumn("start_paise", F.lit(START))
    actual = cases.select(F.col("user_id").alias("case_id")).join(forecast.first_broke(flows), "case_id", "left")
    return forecast.backtest(predicted.select(F.col("user_id").alias("case_id"), F.datediff("broke_p50", F.lit(split)).alias("predicted_days")), actual, 9)


def examples(s, d):
    """Labelled messages: the template is the wording, some are reviewed."""
    rows = t.messages(s, d)
    return rows.select("event_id", "sender", "text", F.concat_ws("-", F.lit("T"), F.col("seq") % 8, F.col("k") % 25).alias("template"), (F.col("k") % 25 % 2 == 0).alias("reviewed"), t.pick(["rules", "teacher"], F.col("k") % 2).alias("source"), t.pick(["SUCCESS", "FAILED"], F.col("k") % 3 % 2).alias("status"))


def document_examples(s, d):
    """Documents as examples: every fourth is protected."""
    return t.table(s, d, "documents").select(F.col("doc_id").alias("event_id"), "text")


def extraction_pairs(s, d):
    rows = t.transactions(s, d)
    rupees = F.format_string("%d.%02d", F.floor(F.col("amount_paise") / 100), F.col("amount_paise") % 100)
    fields = lambda is_txn, amount, name: F.struct(is_txn.alias("is_transaction"), amount.alias("amount"), F.col("direction").alias("direction"), F.lit("SUCCESS").alias("status"), name.alias("merchant_raw"), F.lit("r").alias("reference_id"))
    expected = fields(F.col("k") % 10 > 0, rupees, F.col("merchant_raw"))
    predicted = F.when(F.col("k") % 13 > 0, fields(F.col("k") % 10 > 1, F.when(F.col("k") % 7 == 0, F.concat(F.lit("Rs."), rupees)).when(F.col("k") % 11 == 0, "1").otherwise(rupees), F.when(F.col("k") % 5 == 0, F.upper("merchant_raw")).when(F.col("k") % 17 == 0, "other").otherwise(F.col("merchant_raw"))))
    return rows.select("user_id", "seq", t.pick(["AX-HDFCBK", "VM-SBIUPI-S", "JD-ICICIB"], F.col("seq") % 3).alias("sender"), expected.alias("expected"), predicted.alias("predicted"))


def inputs_to_merge(s, d):
    rows = examples(s, d).select("event_id", "status", "reviewed")
    return [rows, rows.where("event_id LIKE '%1'").withColumn("status", F.lit("SECOND")).withColumn("reviewed", F.lit(False)), rows.where("event_id LIKE '%11'").withColumn("status", F.lit("THIRD")).withColumn("reviewed", F.lit(True))]


def memories(s, d):
    """Embeddings as memories: a user for every fifty rows, which is what a user keeps."""
    e = t.table(s, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.floor(F.col("vec_id") / memory.KEPT).alias("user_id"), F.col("label").cast("string").alias("kind"), "embedding", (F.col("vec_id") % 10 / 10.0).alias("confidence"), F.date_sub(today(), (F.col("vec_id") % 200).cast("int")).alias("last_used_at"), F.when(F.col("vec_id") % 9 == 0, "FORGOTTEN").otherwise("ACTIVE").alias("status"))


def memory_queries(s, d):
    return t.table(s, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.floor(F.col("vec_id") / memory.KEPT).alias("user_id"), "embedding")


def streamed_days(s, d):
    """The daily summary of payments read as a stream, from what its last batch wrote."""
    base = f"{shared_dir(s)}/stream-{uuid.uuid4().hex}"
    events = s.readStream.schema(t.table(s, d, "events").schema).parquet(f"{d}/event[s].parquet")
    payments = t.payments_of(events).withColumn("txn_time", F.col("txn_time").cast("timestamp"))

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{base}/out")

    query = jobs.daily_spending(payments).writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return s.read.parquet(f"{base}/out")


QUERIES = {
    "bank_balance": lambda s, d: forecast.bank_balances(stated(s, d), now()),
    "recurring_items": lambda s, d: forecast.recurring(past(s, d))[0],
    "recurring_explained": lambda s, d: forecast.recurring(past(s, d))[1],
    "spending_days": lambda s, d: days(s, d).select("user_id", "day", "weekday", forecast.total(F.col("by_category"), {"FOOD_DELIVERY": 33, "RENT": 100}).alias("paise")),
    "scheduled_flow": lambda s, d: forecast.scheduled(forecast.recurring(past(s, d))[0], today()),
    "broke_forecast": forecast_rows,
    "broke_by_hash": hashed_forecast,
    "broke_what_if": lambda s, d: forecast.days_gained(forecast_rows(s, d), forecast_rows(s, d, {"FOOD_DELIVERY": 100, "SHOPPING": 100})),
    "forecast_backtest": backtested,
    "template_split": lambda s, d: datasets.template_splits(examples(s, d), "split-1"),
    "dataset_splits": lambda s, d: datasets.make_splits(examples(s, d), "split-1").select("event_id", "split"),
    "dataset_card": lambda s, d: datasets.card(examples(s, d).withColumn("split", t.pick(list(datasets.SPLITS), F.length("event_id") % 3))),
    "near_protected": lambda s, d: datasets.near_protected(document_examples(s, d).where("event_id % 4 > 0"), document_examples(s, d).where("event_id % 4 = 0")),
    "merge_inputs": lambda s, d: datasets.merge_inputs(inputs_to_merge(s, d)),
    "parser_metrics": lambda s, d: datasets.metrics(extraction_pairs(s, d)),
    "parser_metrics_by_sender": lambda s, d: datasets.metrics(extraction_pairs(s, d), "sender").select("sender", "n", "all_match"),
    "promotion_gate": lambda s, d: datasets.gate(datasets.metrics(extraction_pairs(s, d).withColumn("variant", F.when(F.col("seq") % 2 == 0, "ours").otherwise("teacher")), "variant"), "ours", "teacher").select("passed"),
    "latency_p95": lambda s, d: datasets.nearest_rank(t.transactions(s, d), "amount_paise", 0.95, ["user_id"]),
    "memory_search": lambda s, d: memory.search(memories(s, d), memory_queries(s, d), today()),
    "memory_forget": lambda s, d: memory.forget(memories(s, d), today()).select("id", "status"),
    "memory_embed": lambda s, d: t.table(s, d, "conversations").select("conv_id", "turn", memory.embed(F.col("text")).alias("embedding")),
    "stream_daily_summary": streamed_days,
}

SPENT = "kind = 'SPEND' AND status = 'SUCCESS'"
PAST_SQL = """past AS (SELECT user_id, id, merchant_raw || ':' || (k % 2) AS key, CAST(CASE direction WHEN 'CREDIT' THEN 5000 ELSE -1000 - k END AS BIGINT) AS amount_paise, CAST(txn_time + INTERVAL 330 MINUTE AS DATE) AS day, category FROM txn WHERE status = 'SUCCESS'),
mid AS (SELECT user_id, key, amount_paise > 0 AS income, CAST(trunc(median(amount_paise)) AS BIGINT) AS m FROM past GROUP BY ALL HAVING count(*) >= 2),
same AS (SELECT p.*, p.amount_paise > 0 AS income, day - lag(day) OVER (PARTITION BY p.user_id, p.key, p.amount_paise > 0 ORDER BY day, id) AS gap FROM past p JOIN mid ON p.user_id = mid.user_id AND p.key = mid.key AND (p.amount_paise > 0) = mid.income WHERE abs(p.amount_paise - m) * 100 <= 10 * abs(m)),
item AS (SELECT user_id, key, income, CAST(trunc(median(amount_paise)) AS BIGINT) AS amount_paise, max(day) AS last, arg_max(category, (day, id)) AS category,
    CASE WHEN count(*) >= 3 AND bool_and(abs(gap - 7) <= 3) THEN 7 WHEN count(*) >= 2 AND bool_and(abs(gap - 30) <= 3) THEN 30 END AS step FROM same GROUP BY ALL),
due AS (SELECT user_id, key, income, amount_paise, CAST(last + step AS DATE) AS next_date, CAST(step AS INTEGER) AS interval_days, category FROM item WHERE step IS NOT NULL)"""
PAIR_SQL = """pair AS (SELECT *, CASE WHEN wanted AND got THEN 'tp' WHEN wanted THEN 'fn' WHEN got THEN 'fp' ELSE 'tn' END AS o FROM (
  SELECT seq, ['AX-HDFCBK', 'VM-SBIUPI-S', 'JD-ICICIB'][seq % 3 + 1] AS sender, k % 10 > 0 AS wanted, k % 13 > 0 AND k % 10 > 1 AS got, k % 7 = 0 OR k % 11 > 0 OR amount_paise = 100 AS a, k % 5 = 0 OR k % 17 > 0 AS m FROM txn))"""
METRICS = """count(*) AS n, round(count(*) FILTER (o = 'tp') / count(*) FILTER (o IN ('tp', 'fp')), 4) AS precision, round(count(*) FILTER (o = 'tp') / count(*) FILTER (o IN ('tp', 'fn')), 4) AS recall,
  round(2 * count(*) FILTER (o = 'tp') / (2 * count(*) FILTER (o = 'tp') + count(*) FILTER (o IN ('fp', 'fn'))), 4) AS f1, round(count(*) FILTER (o = 'tp' AND a) / count(*) FILTER (o = 'tp'), 4) AS amount_match,
  1.0::DOUBLE AS direction_match, 1.0::DOUBLE AS status_match, round(count(*) FILTER (o = 'tp' AND m) / count(*) FILTER (o = 'tp'), 4) AS merchant_raw_match, 1.0::DOUBLE AS reference_id_match, round(count(*) FILTER (o = 'tn' OR (o = 'tp' AND a AND m)) / count(*), 4) AS all_match"""
EXAMPLE_SQL = "example AS (SELECT 'e_' || seq AS event_id, 'T-' || (seq % 8) || '-' || (k % 25) AS template, k % 25 % 2 = 0 AS reviewed, ['rules', 'teacher'][k % 2 + 1] AS source, ['SUCCESS', 'FAILED'][k % 3 % 2 + 1] AS status, ['HDFCBK', 'S', 'ICICIB'][seq % 3 + 1] AS bank FROM txn)"
MEMORY_SQL = "memory AS (SELECT vec_id AS id, vec_id // 50 AS user_id, embedding, (vec_id % 10) / 10.0 AS confidence, pow(0.5, (vec_id % 200) / 60.0) AS recency, CASE WHEN vec_id % 9 = 0 THEN 'FORGOTTEN' ELSE 'ACTIVE' END AS status FROM embeddings)"
ORACLE_SQL = {
    "bank_balance": with_txn(
        """SELECT user_id, CAST(sum(b + after) AS BIGINT) AS bank_paise, min(t) >= TIMESTAMP '2024-01-25 12:00:00' AS fresh FROM (
          SELECT a.user_id, a.account_hint, a.b, a.t, coalesce((SELECT sum(CASE x.direction WHEN 'CREDIT' THEN x.amount_paise ELSE -x.amount_paise END) FROM live x WHERE x.user_id = a.user_id AND x.account_hint = a.account_hint AND x.txn_time > a.t), 0) AS after
          FROM (SELECT user_id, account_hint, arg_max(amount_paise * 7, (txn_time, id)) AS b, max(txn_time) AS t FROM live WHERE k % 6 = 0 GROUP BY ALL) a) GROUP BY user_id""",
        "live AS (SELECT * FROM txn WHERE status = 'SUCCESS' AND txn_time <= TIMESTAMP '2024-01-28 12:00:00')",
    ),
    "recurring_items": with_txn("SELECT user_id, key, amount_paise, next_date, interval_days, category FROM due", PAST_SQL),
    "recurring_explained": with_txn("SELECT s.user_id, s.id FROM same s JOIN due USING (user_id, key, income)", PAST_SQL),
    "broke_by_hash": with_txn(
        f""", sp AS (
          SELECT d.user_id, d.day, CAST(isodow(d.day) - 1 AS INTEGER) AS weekday, CAST(coalesce(paise, 0) AS BIGINT) AS paise FROM (
          SELECT user_id, CAST(unnest(generate_series(greatest(min(day), DATE '2024-01-29' - 60), DATE '2024-01-28', INTERVAL 1 DAY)) AS DATE) AS day FROM live WHERE day < DATE '2024-01-29' GROUP BY user_id) d
          LEFT JOIN (SELECT user_id, day, CAST(sum(amount_paise) AS BIGINT) AS paise FROM live WHERE {SPENT} GROUP BY ALL) USING (user_id, day)),
        fl AS (
          SELECT user_id, CAST(ahead AS INTEGER) AS a, CAST(sum(amount_paise) AS BIGINT) AS paise FROM (SELECT user_id, amount_paise, next_date + interval_days * n - DATE '2024-01-29' AS ahead FROM due, (SELECT CAST(range AS INTEGER) AS n FROM range(0, 20)))
          WHERE ahead BETWEEN 1 AND 45 GROUP BY ALL),
        alike AS (SELECT user_id, weekday, list(paise ORDER BY day) AS own FROM sp GROUP BY ALL), every AS (SELECT user_id, list(paise ORDER BY day) AS al FROM sp GROUP BY ALL),
        choice AS (
          SELECT u.user_id, u.a, coalesce(own, al, [0]) AS l, coalesce(fl.paise, 0) AS due_paise
          FROM (SELECT user_id, CAST(a AS INTEGER) AS a FROM (SELECT DISTINCT user_id FROM txn), range(1, 46) x(a)) u
          LEFT JOIN alike ON alike.user_id = u.user_id AND weekday = u.a % 7 LEFT JOIN every ON every.user_id = u.user_id LEFT JOIN fl ON fl.user_id = u.user_id AND fl.a = u.a),
        money AS (
          SELECT user_id, r, a, {START} + sum(due_paise - l[CAST(('0x' || substr(md5('0:' || user_id || ':' || r || ':' || a), 1, 8))::UBIGINT AS BIGINT) % len(l) + 1]) OVER (PARTITION BY user_id, r ORDER BY a) AS balance
          FROM choice, range(0, {HASHED_RUNS}) y(r)),
        solvent AS (SELECT user_id, list_sort(list(n)) AS n FROM (SELECT user_id, r, coalesce(min(a) FILTER (balance <= 0), 46) - 1 AS n FROM money GROUP BY ALL) GROUP BY user_id)
        SELECT user_id, DATE '2024-01-29' AS today, CAST({START} AS BIGINT) AS start_paise, {", ".join(f"CASE WHEN n[{int(q * (HASHED_RUNS - 1)) + 1}] < 45 THEN DATE '2024-01-29' + CAST(n[{int(q * (HASHED_RUNS - 1)) + 1}] + 1 AS INTEGER) END AS broke_p{int(q * 100)}" for q in (0.2, 0.5, 0.8))},
          round(len(list_filter(n, lambda x: x < 45)) / {HASHED_RUNS}, 4) AS prob_broke FROM solvent""",
        "live AS (SELECT *, CAST(txn_time + INTERVAL 330 MINUTE AS DATE) AS day FROM txn WHERE status = 'SUCCESS')",
        PAST_SQL,
    ).replace(" ,", ","),
    "spending_days": with_txn(
        f"""SELECT d.user_id, d.day, CAST(isodow(d.day) - 1 AS INTEGER) AS weekday, CAST(coalesce(paise, 0) AS BIGINT) AS paise FROM (
          SELECT user_id, CAST(unnest(generate_series(greatest(min(day), DATE '2024-01-29' - 60), DATE '2024-01-28', INTERVAL 1 DAY)) AS DATE) AS day FROM live WHERE day < DATE '2024-01-29' GROUP BY user_id) d
        LEFT JOIN (SELECT user_id, day, sum(p - CASE category WHEN 'FOOD_DELIVERY' THEN p * 33 // 100 WHEN 'RENT' THEN p ELSE 0 END) AS paise FROM (SELECT user_id, day, category, CAST(sum(amount_paise) AS BIGINT) AS p FROM live WHERE {SPENT} GROUP BY ALL) GROUP BY ALL) USING (user_id, day)""",
        "live AS (SELECT *, CAST(txn_time + INTERVAL 330 MINUTE AS DATE) AS day FROM txn WHERE status = 'SUCCESS')",
    ),
    "scheduled_flow": with_txn(
        """SELECT user_id, CAST(ahead AS INTEGER) AS ahead, CAST(sum(amount_paise) AS BIGINT) AS paise FROM (SELECT user_id, amount_paise, next_date + interval_days * n - DATE '2024-01-29' AS ahead FROM due, (SELECT CAST(range AS INTEGER) AS n FROM range(0, 20)))
        WHERE ahead BETWEEN 1 AND 45 GROUP BY ALL""",
        PAST_SQL,
    ),
    "template_split": with_txn(
        """SELECT template, CASE WHEN reviewed AND b < 0.15 THEN 'gold_test' WHEN b < 0.25 THEN 'val' ELSE 'train' END AS split FROM (
        SELECT template, bool_and(reviewed) AS reviewed, CAST(CAST('0x' || substr(sha256('split-1:' || template), 1, 16) AS UHUGEINT) AS DOUBLE) / 18446744073709551616.0 AS b FROM example GROUP BY template)""",
        EXAMPLE_SQL,
    ),
    "dataset_card": with_txn(
        """SELECT source, bank, status, count(*) FILTER (length(event_id) % 3 = 0) AS train, count(*) FILTER (length(event_id) % 3 = 1) AS val, count(*) FILTER (length(event_id) % 3 = 2) AS gold_test FROM example GROUP BY ALL""", EXAMPLE_SQL
    ),
    "merge_inputs": with_txn("SELECT event_id, CASE WHEN event_id LIKE '%11' THEN 'THIRD' WHEN event_id LIKE '%1' AND NOT reviewed THEN 'SECOND' ELSE status END AS status, reviewed OR event_id LIKE '%11' AS reviewed FROM example", EXAMPLE_SQL),
    "parser_metrics": with_txn(f"SELECT {METRICS} FROM pair", PAIR_SQL),
    "parser_metrics_by_sender": with_txn(f"SELECT sender, n, all_match FROM (SELECT sender, {METRICS} FROM pair GROUP BY sender)", PAIR_SQL),
    "promotion_gate": with_txn(
        f"SELECT max(all_match) FILTER (ours) >= max(all_match) FILTER (NOT ours) - 0.03 AND max(amount_match) FILTER (ours) >= 0.99 AS passed FROM (SELECT seq % 2 = 0 AS ours, {METRICS} FROM pair GROUP BY ours)", PAIR_SQL
    ),
    "latency_p95": with_txn("SELECT user_id, list_sort(list(amount_paise))[1 + CAST(round_even(0.95 * (count(*) - 1), 0) AS BIGINT)] AS amount_paise_q FROM txn GROUP BY user_id"),
    "memory_search": f"""WITH {MEMORY_SQL},
      near AS (SELECT q.vec_id AS query_id, m.id, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(m.embedding AS DOUBLE[])), 6) AS near, recency, confidence FROM embeddings q JOIN memory m ON q.vec_id // 50 = m.user_id WHERE q.vec_id % 100 = 0 AND status = 'ACTIVE'
        QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY near DESC, m.id) <= 20)
      SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS place, id, score FROM (SELECT query_id, id, round(near * recency * CAST(confidence AS DOUBLE), 6) AS score FROM near) QUALIFY place <= 10""",
    "memory_forget": f"WITH {MEMORY_SQL} SELECT id, CASE WHEN status = 'ACTIVE' AND row_number() OVER (PARTITION BY user_id, status ORDER BY round(CAST(confidence AS DOUBLE) * recency, 9) DESC, id) > 50 THEN 'FORGOTTEN' ELSE status END AS status FROM memory",
    "stream_daily_summary": with_txn(f"SELECT user_id, CAST(txn_time + INTERVAL 330 MINUTE AS DATE) AS day, CAST(sum(amount_paise) AS BIGINT) AS total_paise, count(*) AS n FROM txn WHERE {SPENT} GROUP BY ALL"),
}
