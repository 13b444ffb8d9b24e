"""Parsing, merchants, policy, uploads, datasets and memories on small tables."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from spendlake.operators import datasets, ingest, memory, merchants, parsing, policy
from spendlake.sources import files
from spendlake.sources.seeds import seed_rules

MESSAGES = [
    ("1", "AX-HDFCBK", None, "Rs.61.00 debited from A/c XX9911 on 04-10-26 to VPA asha.tea@ybl. UPI Ref 700011112222. Call us"),
    ("2", None, "com.phonepe.app", "Paid ₹90 to Tea Point. UPI Ref No. 700011113333"),
    ("3", "AD-KOTAKB", None, "Your transaction of Rs.15.00 to asha@ybl has FAILED. Amount if debited will be refunded within 7 working days. UPI Ref 700011114444"),
    ("4", "VM-SBIINB", None, "Dear Customer, your A/c XX1212 is credited with Rs 9,000.00 on 01Oct26 by NEFT from BIRCH LTD. Avl Bal Rs 19,000.75 -SBI"),
    ("5", "AX-HDFCBK", None, "Rs.61.00 withdrawn somewhere, we think. Txn noted"),
    ("6", "AX-HDFCBK", None, "555 is your OTP for Rs 61"),
    ("7", None, None, None),
]
MESSAGE = "event_id string, sender string, source_app string, text string"


def test_rules_parse(spark):
    got = {r.event_id: r for r in parsing.parse(spark.createDataFrame(MESSAGES, MESSAGE), parsing.rule_table(spark, seed_rules())).collect()}
    assert len(got) == 7
    assert (got["1"].amount_paise, got["1"].merchant_raw, got["1"].reference_id, got["1"].account_hint, got["1"].confidence) == (6100, "asha.tea@ybl", "700011112222", "9911", 0.99)
    assert (got["2"].amount_paise, got["2"].merchant_raw, got["2"].channel) == (9000, "Tea Point", "UPI")
    assert (got["3"].status, got["3"].promised_refund_days) == ("FAILED", 7)
    assert (got["4"].direction, got["4"].balance_after_paise, got["4"].merchant_raw) == ("CREDIT", 1900075, "BIRCH LTD")
    assert [(got[i].outcome, got[i].reason) for i in "567"] == [("FAILED", "NO_TIER"), ("DROPPED", "OTP"), ("DROPPED", "EMPTY")]


def test_tiers_answer_in_turn(spark):
    x = lambda amount: (True, amount, "DEBIT", "UPI", "SUCCESS", "asha", None, None, None, None, None)
    rows = [("1", "A", None, "Paid Rs 5 to asha", x("6"), x("5")), ("2", "A", None, "Paid Rs 5 to asha", x("5"), None), ("3", "A", None, "Paid Rs 5 to asha", x("6"), None), ("4", "A", None, "Paid Rs 5 to asha", None, (False, *[None] * 10))]
    df = spark.createDataFrame(rows, f"{MESSAGE}, device {parsing.EXTRACTION}, teacher {parsing.EXTRACTION}")
    got = {r.event_id: (r.outcome, r.reason, r.parse_method) for r in parsing.parse(df, parsing.rule_table(spark, seed_rules()), {"DEVICE": "device", "TEACHER_LLM": "teacher"}).collect()}
    assert got == {"1": ("PARSED", None, "TEACHER_LLM"), "2": ("PARSED", None, "DEVICE"), "3": ("FAILED", "AMOUNT_NOT_IN_TEXT", None), "4": ("NOT_TRANSACTION", "NOT_TRANSACTION", None)}


@pytest.mark.parametrize(
    ("regex", "reason"),
    [(r"Rs (?P<amount>\d+)", None), ("x" * 601, "too_long"), (r"(?P<amount>(\d+)+)", "nested_quantifier"), (r"(?P<amount>\d)\1", "backreference"), (r"(?P<amount>\d+) 12345", "literal_data"), (r"(?P<amount>\d", "does_not_compile"), (r"(?P<ref>\d+)", "no_amount_group"), (r"(?P<amount>\d+)(?P<who>a)", "unknown_group")],
)
def test_guard_of_rules(regex, reason):
    assert parsing.fault(regex, "DEBIT") == reason
    assert parsing.fault(r"(?P<amount>\d+)", "SIDEWAYS") == "bad_direction"


def test_life_of_rules(spark):
    seen = {"up": "+++++", "down": "+-+--", "late": "++++-+++++", "end": "+++++---", "few": "++++"}
    rows = [(rule, i, c == "+") for rule, line in seen.items() for i, c in enumerate(line)]
    got = {r.rule_id: r.status for r in parsing.lifecycle(spark.createDataFrame(rows, "rule_id string, at int, agreed boolean"), "at").collect()}
    assert got == {"up": "ACTIVE", "down": "DISABLED", "late": "CANDIDATE", "end": "DISABLED", "few": "CANDIDATE"}


def test_candidates_are_held_against_the_truth(spark):
    rule = [{"id": "c", "sender": "HDFCBK", "regex": r"Rs\.(?P<amount>[\d.]+) debited", "direction": "DEBIT", "rule_status": "CANDIDATE"}]
    truth = lambda amount: (True, amount, "DEBIT", None, "SUCCESS", None, None, None, None, None, None)
    rows = spark.createDataFrame([("1", "AX-HDFCBK", None, "Rs.5.00 debited", truth("5")), ("2", "AX-HDFCBK", None, "Rs.5.00 debited", truth("6")), ("3", "AX-HDFCBK", None, "Rs 5 sent", truth("5"))], f"{MESSAGE}, truth {parsing.EXTRACTION}")
    got = parsing.observations(rows, parsing.rule_table(spark, rule), "truth").collect()
    assert {(r.event_id, r.agreed) for r in got} == {("1", True), ("2", False)}


def test_merchants(spark):
    shops = spark.createDataFrame([("m1", "Teapot House", "DINING_OUT", ["teapot"]), ("m2", "Birch", "SHOPPING", None)], "id string, name string, category string, aliases array<string>")
    own = spark.createDataFrame([(2, "birch", None, None, "OTHER")], "user_id long, alias string, merchant_id string, name string, category string")
    rows = spark.createDataFrame([(1, "TEAPOT@ybl"), (1, "Teapott House"), (1, "p01234567@ybl"), (1, "123@ybl"), (1, None), (1, "Birch"), (2, "Birch"), (1, "Quartz")], "user_id long, merchant_raw string")
    got = {(r.user_id, r.merchant_raw): (r.merchant_id, r.resolved_category, r.method) for r in merchants.resolve(rows, merchants.aliases_of(shops), own).collect()}
    assert got == {
        (1, "TEAPOT@ybl"): ("m1", "DINING_OUT", "EXACT"), (1, "Teapott House"): ("m1", "DINING_OUT", "TRIGRAM"), (1, "p01234567@ybl"): (None, "TRANSFERS", "PERSON"), (1, "123@ybl"): (None, "OTHER", "NONE"),
        (1, None): (None, "OTHER", "NONE"), (1, "Birch"): ("m2", "SHOPPING", "EXACT"), (2, "Birch"): (None, "OTHER", "USER"), (1, "Quartz"): (None, "OTHER", "NONE"),
    }


def test_gate_like_a_plain_loop(spark):
    draw, rows = random.Random(8), []
    for i in range(600):
        at = datetime(2026, 3, 2) + timedelta(minutes=draw.randrange(14 * 1440))
        rows.append((i, draw.randrange(4), draw.choice(["ROAST", "ROAST", "NUDGE", "SUMMARY", "CONFIRMATION"]), at, draw.choice(["TRAVEL", "RENT", None]), draw.choice(["OFF", "MILD", "MILD"]), 1380, 480, draw.choice([None, None, f"d{draw.randrange(60)}"])))
    df = spark.createDataFrame(rows, "id long, user_id long, alert_type string, at timestamp_ntz, category string, roast_level string, quiet_start int, quiet_end int, dedupe_key string")
    want, roasts, others, keys = {}, {}, {}, set()
    for i, user, kind, at, category, level, *_, key in sorted(rows, key=lambda r: (r[3], r[0])):
        ist = at + timedelta(minutes=330)
        day, week, minute = (user, ist.date()), (user, ist.isocalendar()[:2]), ist.hour * 60 + ist.minute
        if key and (user, key) in keys:
            want[i] = "DUPLICATE"
            continue
        keys.add((user, key))
        if kind == "CONFIRMATION":
            want[i] = None
        elif minute >= 1380 or minute < 480:
            want[i] = "QUIET_HOURS"
        elif kind == "SUMMARY":
            want[i] = None
        elif others.get(day, 0) >= 3:
            want[i] = "DAILY_CAP"
        else:
            others[day] = others.get(day, 0) + 1
            if kind == "NUDGE":
                want[i] = None
            elif level == "OFF":
                want[i] = "ROAST_OFF"
            elif category != "TRAVEL":
                want[i] = "NOT_ROASTABLE"
            elif roasts.get(day, 0) >= 1 or roasts.get(week, 0) >= 4:
                want[i] = "ROAST_CAP"
            else:
                want[i] = None
                roasts[day], roasts[week] = roasts.get(day, 0) + 1, roasts.get(week, 0) + 1
    assert {r.id: r.reason for r in policy.gate(df).collect()} == want


def test_uploads(spark):
    now = F.lit(datetime(2026, 5, 1)).cast("timestamp_ntz")
    at = datetime(2026, 4, 30)
    rows = [("a", 1, True, "x", at, False, 1), ("a", 1, True, "x", at, False, 2), ("a", 2, True, "x", at, False, 3), ("b", 1, False, "x", at, False, 4), ("c", 1, True, "x" * 2001, at, False, 5), ("d", 1, True, "x", datetime(2024, 1, 1), False, 6), ("e", 1, True, "x", datetime(2026, 5, 2), True, 7), ("f", 1, True, None, at, True, 8), ("g", 1, True, "x", at, None, 9), ("h", 1, True, "x", at, False, 10)]
    df = spark.createDataFrame(rows, "event_id string, user_id long, redacted boolean, text string, posted_at timestamp_ntz, replay boolean, seq int")
    stored = spark.createDataFrame([("g", 1), ("h", 2)], "event_id string, user_id long")
    got = {r.seq: (r.status, r.reason) for r in ingest.classify(df, stored, now).collect()}
    assert [got[i] for i in range(1, 11)] == [("ACCEPTED", None), ("DUPLICATE", None), ("REJECTED", "OTHER_OWNER"), ("REJECTED", "NOT_REDACTED"), ("REJECTED", "TEXT_TOO_LONG"), ("REJECTED", "TOO_OLD"), ("REJECTED", "IN_FUTURE"), ("REJECTED", "REPLAY"), ("DUPLICATE", None), ("REJECTED", "OTHER_OWNER")]


def test_tables_change(spark):
    stored = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "id int, v string, version int")
    new = spark.createDataFrame([(1, "c", 2), (2, "d", 4), (3, "e", 1)], "id int, v string, version int")
    assert sorted(tuple(r) for r in ingest.upsert(stored, new, ["id"], "version").collect()) == [(1, "c", 2), (2, "b", 5), (3, "e", 1)]
    assert sorted(tuple(r) for r in ingest.insert_new(stored, new, ["id"]).collect()) == [(1, "a", 1), (2, "b", 5), (3, "e", 1)]
    models = spark.createDataFrame([("m1", "parser", "ACTIVE", True), ("m2", "parser", "SHADOW", True), ("m3", "parser", "SHADOW", False), ("o", "other", "ACTIVE", True)], "id string, kind string, status string, gate_passed boolean")
    state = lambda m: {r.id: r.status for r in ingest.promote(models, m).collect()}
    assert state("m2") == {"m1": "RETIRED", "m2": "ACTIVE", "m3": "SHADOW", "o": "ACTIVE"}
    assert state("m3") == {"m1": "ACTIVE", "m2": "SHADOW", "m3": "SHADOW", "o": "ACTIVE"}
    ledger = spark.createDataFrame([("c_1",), ("c_2",)], "id string")
    assert [r.id for r in ingest.undo_cash(ledger, spark.createDataFrame([("1",)], "id string")).collect()] == ["c_2"]
    texts = spark.createDataFrame([("t1", 1, "Tea", "OTHER", "m", 1, False), ("t2", 1, "Bus", "OTHER", "m", 3, False)], "id string, user_id long, merchant_raw string, category string, merchant_id string, version int, user_corrected boolean")
    change = spark.createDataFrame([("t1", 1, "DINING_OUT", None), ("t2", 2, "RENT", None)], "id string, user_id long, category string, merchant_name string")
    assert sorted((r.id, r.category, r.version) for r in ingest.correct(texts, change).collect()) == [("t1", "DINING_OUT", 2), ("t2", "OTHER", 3)]
    assert [(r.alias, r.category) for r in ingest.overrides_from(texts, change).collect()] == [("tea", "DINING_OUT")]


def test_near_duplicates_of_protected_rows(spark):
    draw = random.Random(4)
    words = lambda n: ["".join(draw.choice("aeioubcdfg") for _ in range(6)) for _ in range(n)]
    base = [words(60) for _ in range(20)]
    close_ = [b[:-1] + ["end"] for b in base]
    protected = spark.createDataFrame([(i, " ".join(b)) for i, b in enumerate(base)] + [(90, None)], "event_id long, text string")
    candidates = spark.createDataFrame([(100 + i, " ".join(b).upper()) for i, b in enumerate(close_)] + [(200 + i, " ".join(words(60))) for i in range(20)] + [(300, "")], "event_id long, text string")
    got = {r.event_id for r in datasets.near_protected(candidates, protected).collect()}
    assert {*range(100, 120)} <= got and not got & {*range(200, 220)}


def test_splits_keep_templates_apart(spark):
    draw = random.Random(6)
    rows = [(str(i), draw.choice(["AX-HDFCBK", "VM-CANBNK"]), " ".join(f"w{draw.randrange(900)}" for _ in range(12)), f"T{i % 40}", i % 40 < 25) for i in range(800)]
    df = spark.createDataFrame(rows, "event_id string, sender string, text string, template string, reviewed boolean")
    out = datasets.make_splits(df, "salt")
    assert datasets.leaking(out).count() == 0
    assert {r.template for r in out.where("split = 'gold_test'").select("template").distinct().collect()} <= {f"T{i}" for i in range(25)}
    assert datasets.version_of(out).first() == datasets.version_of(out.orderBy("text").repartition(3)).first()


def test_memories(spark):
    near = memory.cosine(memory.embed(F.col("a")), memory.embed(F.col("b")))
    rows = spark.createDataFrame([("no coffee this week", "no coffee this week"), ("no coffee this week", "rent is due"), ("", "x")], "a string, b string").select(F.round(near, 6)).collect()
    assert rows[0][0] == 1.0 and rows[1][0] < 0.5 and rows[2][0] == 0.0
    schema = "id string, user_id long, kind string, embedding array<double>, confidence double, status string, last_used_at date"
    held = spark.createDataFrame([("a", 1, "GOAL", [1.0, 0.0], 0.5, "ACTIVE", date(2026, 1, 1)), ("b", 1, "FACT", [1.0, 0.0], 0.5, "ACTIVE", date(2026, 1, 1))], schema)
    new = spark.createDataFrame([("n", 1, "GOAL", [0.96, 0.28], 0.95, "ACTIVE", date(2026, 1, 2)), ("m", 1, "FACT", [0.6, 0.8], 0.7, "ACTIVE", date(2026, 1, 2))], schema)
    assert sorted((r.id, r.confidence) for r in memory.remember(held, new).collect()) == [("a", 1.0), ("b", 0.5), ("m", 0.7)]
    many = spark.createDataFrame([(f"k{i}", 1, "FACT", [1.0], 0.9 if i < 3 else 0.5, "ACTIVE", date(2026, 1, 1)) for i in range(6)], schema)
    assert {r.id for r in memory.forget(many, F.lit(date(2026, 3, 1)), 3).where("status = 'ACTIVE'").collect()} == {"k0", "k1", "k2"}


def test_files(spark, tmp_path):
    (tmp_path / "seeds.yaml").write_text("# shops\nteapot: [Teapot House, DINING_OUT, [teapot, tea pot]]\nbirch: [\"Birch\", SHOPPING]\n")
    got = {r.id: (r.name, r.category, r.aliases) for r in files.read_merchants(spark, str(tmp_path / "seeds.yaml")).collect()}
    assert got == {"teapot": ("Teapot House", "DINING_OUT", ["teapot", "tea pot"]), "birch": ("Birch", "SHOPPING", [])}
    rows = spark.createDataFrame([("e1", 7, datetime(2026, 1, 1), "app", "hello", datetime(2026, 1, 1, 5))], "event_id string, user_id long, occurred_at timestamp, sourceApp string, text string, postedAt timestamp")
    sent = files.to_envelopes(rows, "RAW_SMS", "test", ["sourceApp", "text", "postedAt"])
    bad = spark.createDataFrame([("k", "{}"), ("k", "no json")], "key string, value string")
    back = files.from_envelopes(sent.union(bad)).collect()
    assert [(r.event_id, r.user_id, r.text, r.fault) for r in back] == [("e1", "7", "hello", None), (None, None, None, "BAD_ENVELOPE"), (None, None, None, "BAD_ENVELOPE")]
    files.write_examples(spark.createDataFrame([("x", "A", None, "t", "rules", True, None, (True, "5", "DEBIT", "UPI", "SUCCESS", "a", None, None, None, None, None))], files.EXAMPLE), str(tmp_path / "out"))
    assert files.read_examples(spark, str(tmp_path / "out")).first().label.amount == "5"


def test_rules_from_a_file(spark, tmp_path):
    import json

    from spendlake.sources import files
    from spendlake.sources.seeds import seed_rules

    (tmp_path / "rules.json").write_text("\n".join(map(json.dumps, seed_rules())))
    assert sorted(r["id"] for r in files.read_rules(spark, str(tmp_path / "rules.json"))) == sorted(r["id"] for r in seed_rules())
    (tmp_path / "bad.json").write_text(json.dumps({"id": "r", "sender": "X", "regex": "(?P<amount>(a+)+)", "direction": "DEBIT"}))
    with pytest.raises(ValueError, match="nested_quantifier"):
        files.read_rules(spark, str(tmp_path / "bad.json"))


def test_exported_schemas_read_back(spark):
    import json

    from pyspark.sql.types import StructType
    from spendlake.sources import files

    schemas = files.exported_schemas()
    assert set(schemas) == {"labeled-example", "envelope", "raw-event-payload", "rule"}
    assert StructType.fromJson(json.loads(schemas["envelope"])) == spark.createDataFrame([], files.ENVELOPE).schema


def test_many_rules_meet_by_a_join(spark, monkeypatch):
    """Rules in the plan and rules by a join try the same and find the same."""
    rules = parsing.rule_table(spark, seed_rules_and_more())
    rows = [(f"e{i}", sender, None, text) for i, (sender, text) in enumerate([("AX-HDFCBK", "Rs.349.00 debited from A/c XX1234 on 03-10-26 to VPA zomato@hdfcbank. UPI Ref 412345678901"), ("AX-HDFCBK", "Rs 5 debited"), ("XY-NONE", "Rs 5 debited"), (None, None), ("AX-HDFCBK", "Rs.1 debited " + "x" * 2000)])]
    messages = spark.createDataFrame(rows, "event_id string, sender string, source_app string, text string")
    want = {r.event_id: r.tries for r in parsing.tried(messages, rules).collect()}
    monkeypatch.setattr(parsing, "LITERAL_RULES", 3)
    got = {r.event_id: r.tries for r in parsing.tried(messages, rules).collect()}
    assert got == want and len(want["e0"]) >= 2 and len(want["e1"]) == 1 and not want["e2"] and not want["e4"]


def seed_rules_and_more():
    from spendlake.sources.seeds import seed_rules

    return [*seed_rules(), {"id": "r_any", "sender": "HDFCBK", "regex": r"Rs\.? ?(?P<amount>[\d,]+(?:\.\d{1,2})?) debited", "direction": "DEBIT", "created_at": 5}]
