"""Plug-ins that fail now and then leave the other rows whole."""

from pyspark.sql import Observation

from spendlake.operators import datasets, memory, parsing, plugins, tiers
from spendlake.sources.seeds import seed_rules


def flaky():
    """A plug-in that fails on every seventh text, and on the batch that holds it."""

    def load():
        def ask(texts):
            if any(int(t.split()[-1]) % 7 == 0 for t in texts):
                raise RuntimeError("seventh")
            return [f"read {t}" for t in texts]

        return ask

    return load


def test_failures_are_rows(spark):
    rows = spark.createDataFrame([(i, f"text {i}" if i % 5 else None) for i in range(200)], "id int, text string").repartition(3)
    got = {r.id: r for r in plugins.answered(rows, flaky(), "string", batch=16).collect()}
    assert len(got) == 200
    for i, r in got.items():
        want = (None, None) if i % 5 == 0 else (None, "RuntimeError") if i % 7 == 0 else (f"read text {i}", None)
        assert (r.answer, r.answer_failure) == want
    assert plugins.answered(rows.limit(0), flaky(), "string").count() == 0


def test_a_second_try_and_wrong_answers(spark):
    def once_down():
        tries = []

        def ask(texts):
            tries.append(1)
            if len(tries) == 1:
                raise ConnectionError
            return [None if t == "none" else ["x"] if t == "odd" else len(t) for t in texts]

        return ask

    rows = spark.createDataFrame([("abc",), ("none",), ("odd",)], "text string").coalesce(1)
    got = {r.text: (r.answer, r.answer_failure is not None) for r in plugins.answered(rows, once_down, "int").collect()}
    assert got == {"abc": (3, False), "none": (None, False), "odd": (None, True)}
    short = plugins.answered(rows, lambda: lambda texts: [], "int").collect()
    assert [r.answer_failure for r in short] == ["ValueError"] * 3


BLANK = dict.fromkeys(("amount", "direction", "channel", "status", "merchant_raw", "counterparty_vpa", "reference_id", "account_hint", "balance_after", "promised_refund_days"))


def test_parse_asks_only_what_rules_leave(spark):
    BLANK = dict(globals()["BLANK"])  # plug-ins are sent to workers with what they close over
    good = "Rs.{}.00 debited from A/c XX9911 on 04-10-26 to VPA a@ybl. UPI Ref 700011112222"
    rows = [("r", "AX-HDFCBK", None, good.format(5)), ("m", "AX-NEWBNK", None, "Rs.7.00 debited for tea"), ("w", "AX-NEWBNK", None, "Rs.8.00 debited for tea"), ("d", "AX-NEWBNK", None, "Rs.9.00 debited for tea"), ("n", "AX-NEWBNK", None, "Rs.6.00 debited note"), ("o", "AX-HDFCBK", None, "Your OTP is 123456")]

    def model():
        def ask(texts):
            if any("5.00" in t or "OTP" in t for t in texts):
                raise AssertionError("a rule has read this")
            if any("9.00" in t for t in texts):
                raise TimeoutError
            return [dict(BLANK, is_transaction=False) if "note" in t else dict(BLANK, is_transaction=True, direction="DEBIT", amount="7.00") for t in texts]

        return ask

    def teacher():
        return lambda texts: [dict(BLANK, is_transaction=True, direction="DEBIT", amount="8.00") if "8.00" in t else None for t in texts]

    messages = spark.createDataFrame(rows, "event_id string, sender string, source_app string, text string")
    got = {r.event_id: (r.outcome, r.reason, r.parse_method, r.amount_paise) for r in plugins.parse(messages, parsing.rule_table(spark, seed_rules()), {"SERVER_MODEL": model, "TEACHER_LLM": teacher}).collect()}
    assert got["r"] == ("PARSED", None, "RULE", 500) and got["m"] == ("PARSED", None, "SERVER_MODEL", 700) and got["w"] == ("PARSED", None, "TEACHER_LLM", 800)
    assert got["d"] == ("FAILED", "TIMEOUTERROR", None, None) and got["n"][0] == "NOT_TRANSACTION" and got["o"][:2] == ("DROPPED", "OTP")


def test_distill_and_embed(spark):
    BLANK = dict(globals()["BLANK"])
    first = lambda: lambda texts: [dict(BLANK, is_transaction=True, amount=t[-1], direction="DEBIT") for t in texts]
    second = lambda: lambda texts: [None if t.endswith("3") else dict(BLANK, is_transaction=True, amount="1", direction="DEBIT") for t in texts]
    rows = spark.createDataFrame([(f"e{i}", f"text {i}") for i in (1, 2, 3)], "event_id string, text string")
    queue = {r.event_id: r.reason for r in datasets.review_queue(plugins.distill(rows, first, second), 0.0).collect()}
    assert queue == {"e2": "DISAGREE", "e3": "FAILED"}
    own = plugins.embed(rows, lambda: lambda texts: memory.vectors(texts, 16), 16).collect()
    assert all(r.embedding == memory.vectors([r.text], 16)[0].tolist() for r in own)
    assert [r.embedding_failure for r in plugins.embed(rows, lambda: lambda texts: [[1.0]] * len(texts), 16).collect()] == ["ValueError"] * 3


def test_outcomes_are_counted_while_they_are_written(spark, tmp_path):
    good = "Rs.{}.00 debited from A/c XX9911 on 04-10-26 to VPA a@ybl. UPI Ref 70001111{:04d}"
    rows = [(f"e{i}", "AX-HDFCBK" if i % 4 else "AX-NEWBNK", None, [good.format(i, i), "Your OTP is 123456", None, "Hello", good.format(i, i).replace("debited", "credited")][i % 5]) for i in range(1, 200)]
    schema = "event_id string, sender string, source_app string, text string"
    rules, seen = parsing.rule_table(spark, seed_rules()), Observation()
    parsed = parsing.parse(spark.createDataFrame(rows, schema), rules)
    want = {(r.outcome, r.detail): r.n for r in tiers.outcome_counts(parsed).collect()}
    written = tiers.observed(parsed, seen)
    written.write.parquet(f"{tmp_path}/out")
    assert tiers.counted(seen.get) == want and len(want) >= 4
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in")
    stream = tiers.observed(parsing.parse(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), rules), "outcomes")
    query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/live").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination()
    told = [p["observedMetrics"]["outcomes"].asDict() for p in query.recentProgress if p["numInputRows"]]
    assert tiers.counted({k: sum(m[k] for m in told) for k in told[0]}) == want
