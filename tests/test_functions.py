"""Column functions on tables of inputs and expected values."""

import random
import uuid
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from spendlake.functions import commitments, grounding, ids, money, redaction, text, times
from spendlake.operators import cash


def values(spark, function, inputs, kind="string"):
    rows = spark.createDataFrame(list(enumerate(inputs)), f"i int, x {kind}")
    return [r.y for r in rows.select("i", function(F.col("x")).alias("y")).orderBy("i").collect()]


def test_amounts(spark):
    cases = {"Rs.725.50 debited. Avl Bal Rs 3,10,000": [72550, 31000000], "inr7 sent": [700], "₹1,00,00,000 in": [1000000000], "3 days, 4 nights": [], "stars 5": []}
    assert values(spark, money.currency_amounts, list(cases)) == list(cases.values())
    assert 81200 in values(spark, money.all_number_amounts, ["812 to asha@okaxis"])[0]


def test_rupees_round_trip(spark):
    draw = random.Random(3)
    paise = [draw.randrange(1, 10 ** draw.randrange(2, 15)) for _ in range(200)] + [1, 99, 100, 99_99_999]
    shown = values(spark, money.format_inr, paise, "long")
    assert values(spark, money.rupees_to_paise, shown) == paise
    assert values(spark, money.format_inr, [-123456789, 0, None], "long") == ["-₹12,34,567.89", "₹0.00", None]
    assert values(spark, money.rupees_to_paise, ["1.234", "ten", "", None, "9" * 30]) == [None] * 5


def test_filter_of_messages(spark):
    cases = {
        "": "EMPTY", None: "EMPTY", "4411 is your one time password for Rs 20": "OTP", "Get upto Rs 75 off, click here": "PROMO", "Available balance in A/c XX77 is Rs 5": "BALANCE_ONLY",
        "asha@okaxis has requested Rs 10": "COLLECT_REQUEST", "Bill is ready": "NO_AMOUNT", "Rs 5 debited. Avl Bal Rs 9": None, "Refund of Rs 60 sent, coupon inside": None,
    }
    assert values(spark, text.drop_reason, list(cases)) == list(cases.values())


def test_payees(spark):
    cases = {"BIGCAT.SHOP@ybl": "bigcat shop", "Salt & Co Pvt Ltd": "salt &", "98765@ybl": "", " The India Company ": ""}
    assert values(spark, text.merchant_key, list(cases)) == list(cases.values())
    assert values(spark, text.is_person_vpa, ["p0a1b2c3d@ybl", "P0A1B2C3D@OKAXIS", "p0a1b2c3@ybl", None]) == [True, True, False, False]
    pairs = spark.createDataFrame([("swigy", "swiggy"), ("", "a"), ("uber", "uber"), ("uber", "metro")], "a string, b string")
    got = [r[0] for r in pairs.select(F.round(text.payee_similarity(F.col("a"), F.col("b")), 3)).collect()]
    assert got == [0.625, 0.0, 1.0, 0.0]


@pytest.mark.parametrize(
    ("line", "expected"),
    [("35 samosa", ("CASH_SPEND", 3500, "samosa", "DINING_OUT")), ("2k jeans", ("CASH_SPEND", 200000, "jeans", "SHOPPING")), ("got 90 from aunt", ("CASH_RECEIVED", 9000, "got from aunt", None)), ("withdrew 3000", ("ATM_WITHDRAWAL", 300000, "withdrew", None)), ("Rs 12.50 doodh", ("CASH_SPEND", 1250, "doodh", "GROCERIES")), ("66/- cab", ("CASH_SPEND", 6600, "cab", "TRANSPORT")), ("7 odd things", ("CASH_SPEND", 700, "odd things", "CASH_UNCATEGORIZED")), ("12 tea and 5 pav", None), ("0 tea", None), ("none", None), ("", None), ("5 " + "y" * 150, None)],
)
def test_cash_lines(spark, line, expected):
    got = values(spark, cash.parse_cash_line, [line])[0]
    assert (tuple(got) if got else None) == expected


def test_numbers_and_grounding(spark):
    assert values(spark, grounding.numbers, ["₹2,310 on 3 rides, 4.5k left by the 21st, 2 lakh"]) == [[Decimal(x) for x in ("2310", "3", "4500", "21", "200000")]]
    rows = spark.createDataFrame([("₹231 for 3",), ("₹230.50 for 3",), ("₹240 for 3",)], "x string")
    allowed = grounding.allowed_values(F.array(F.lit(23050).cast("long")), F.array(F.lit(3)))
    assert [len(r[0]) for r in rows.select(grounding.ungrounded(F.col("x"), allowed)).collect()] == [1, 0, 1]  # 230.5 to the even rupee is 230


@pytest.mark.parametrize(
    ("change", "expected"),
    [({}, None), ({"is_transaction": False}, "NOT_TRANSACTION"), ({"amount": None}, "MISSING_AMOUNT"), ({"amount": "few"}, "BAD_AMOUNT"), ({"amount": "0"}, "BAD_AMOUNT"), ({"amount": "526"}, "AMOUNT_NOT_IN_TEXT"), ({"reference_id": "12"}, "REFERENCE_NOT_IN_TEXT"), ({"direction": None}, "MISSING_DIRECTION"), ({"direction": "CREDIT"}, "DIRECTION_MISMATCH"), ({"status": "FAILED"}, "FAILED_WITHOUT_KEYWORD"), ({"status": "REVERSED"}, "REVERSED_WITHOUT_KEYWORD"), ({"balance_after": "77"}, "BAD_BALANCE")],
)
def test_checks_of_extractions(spark, change, expected):
    x = {"is_transaction": True, "amount": "525", "direction": "DEBIT", "status": "SUCCESS", "reference_id": "40 50", "balance_after": "1,310"} | change
    rows = spark.createDataFrame([(tuple(x.values()), "Paid Rs 525.00 to Asha. Ref 4050 Bal Rs 1,310")], "x struct<is_transaction: boolean, amount: string, direction: string, status: string, reference_id: string, balance_after: string>, t string")
    assert rows.select(grounding.failure(F.col("x"), F.col("t"))).first()[0] == expected


def test_ids(spark):
    names = ["", "a", "चाय", "txn/1"]
    assert values(spark, lambda c: ids.uuid5(str(uuid.NAMESPACE_URL), c), names) == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]
    assert values(spark, ids.uuid7_millis, ["0192f3a4-b5c6-7abc-8def-000000000000"]) == [0x0192F3A4B5C6]


def test_calendar(spark):
    at = [datetime(2026, 12, 31, 18, 29), datetime(2026, 12, 31, 18, 30), datetime(2027, 1, 3, 18, 30)]
    assert values(spark, lambda c: times.ist_day(c).cast("string"), at, "timestamp_ntz") == ["2026-12-31", "2027-01-01", "2027-01-04"]
    assert values(spark, times.iso_week_key, at, "timestamp_ntz") == ["2026-W53", "2026-W53", "2027-W01"]
    night = lambda c: times.in_quiet_hours(c, F.lit(1380), F.lit(480))
    assert values(spark, night, [datetime(2026, 1, 1, h, m) for h, m in ((17, 29), (17, 30), (2, 29), (2, 30))], "timestamp_ntz") == [False, True, True, False]


def test_content_and_digits(spark):
    cases = {"": "EMPTY", "x" * 401: "TOO_LONG", "so skinny": "BODY", "Your Mom again": "FAMILY", "fine, face it": "BODY", "five rides": None}
    assert values(spark, text.blocked_reason, list(cases)) == list(cases.values())
    assert values(spark, text.scrub_digits, ["a 1234567890123 b", "123456789012", "x12345678901234567y", ""]) == ["a XXXXXXXXX0123 b", "123456789012", "xXXXXXXXXXXXXX4567y", ""]


@pytest.mark.parametrize(
    ("message", "expected"),
    [
        ("Rs 80 to tea.shop@hdfcbank from A/c XX5511. UPI Ref 700011112222", "Rs 80 to tea.shop@hdfcbank from A/c XX5511. UPI Ref 700011112222"),
        ("A/c 60200987654 debited, acct no: 12345", "A/c XX7654 debited, acct no: XX2345"),
        ("card 5100 2222 3333 4444 or 5100222233334444", "card XX4444 or XX4444"),
        ("call 9812345670 or +91-9812345671, Txn id 9812345672", "call [phone] or [phone], Txn id 9812345672"),
        ("mail a.b@c.co.in, PAN ABCDE9999K, Aadhaar 4321 8765 1234", "mail [email], PAN [pan], Aadhaar [aadhaar]"),
        ("member 556677889900, order #556677889900", "member XX9900, order #556677889900"),
        ("Ref No." + " " * 17 + "9876543210", "Ref No." + " " * 17 + "9876543210"),
        ("Ref No." + " " * 25 + "9876543210", "Ref No." + " " * 25 + "[phone]"),
        ("9876543210 9876543211 upi/9876543212", "[phone] [phone] upi/9876543212"),
        ("order number 1234567890123 then 1234567890123", "order number 1234567890123 then XX0123"),
        ("", ""),
        (None, None),
    ],
)
def test_redaction(spark, message, expected):
    assert values(spark, lambda c: redaction.redact(c, b"k"), [message]) == [expected]


def test_keyed_hash_of_persons(spark):
    import hashlib
    import hmac

    own = hmac.new(b"k" * 70, b"asha.rao", hashlib.sha256).hexdigest()[:8]
    got = values(spark, lambda c: redaction.redact(c, b"k" * 70), ["to Asha.Rao@ybl, ao@ybl and Asha.Rao@ybl", "bharatpe99@ybl 9812345670@hdfcbank"])
    assert got[0].startswith(f"to p{own}@ybl, p") and got[0].endswith(f"@ybl and p{own}@ybl")
    assert got[1].startswith("bharatpe99@ybl p") and got[1].endswith("@hdfcbank")


def test_commitments(spark):
    from datetime import date

    got = values(spark, lambda c: commitments.commitment(c, F.lit(date(2026, 12, 5))), ["Max  pizza 3 orders per mahine until 9 jan", "nahi chai is hafta", "maybe", "no cabs this week by 31 feb", None])
    assert [x and (x.target, x.max_count, x.period, x.until) for x in got] == [("pizza", 3, "month", date(2027, 1, 9)), ("chai", 0, "week", None), None, ("cabs", 0, "week", None), None]
    assert values(spark, commitments.due_at, [date(2026, 12, 5)], "date") == [datetime(2026, 12, 5, 18, 29)]


def test_ways_cash_may_have_gone(spark):
    rows = spark.createDataFrame([("a", 1, 50_000), ("b", 2, 50_000), ("c", 3, 4_999), ("d", 4, 7_000)], "id string, user_id long, unaccounted_paise long")
    habits = spark.createDataFrame([(1, "RENT", 1, 300), (1, "TRAVEL", 2, 200), (1, "HEALTH", 3, 100), (1, "OTHER", 4, 50), (4, "DINING_OUT", 1, 5)], "user_id long, category string, place int, total_paise long")
    got = {r.id: [[(p.category, p.amount_paise) for p in w] for w in r.ways] for r in cash.breakdowns(rows, habits).collect()}
    assert got["a"] == [[("RENT", 50_000)], [("RENT", 30_000), ("TRAVEL", 20_000)], [("RENT", 25_000), ("TRAVEL", 16_000), ("HEALTH", 9_000)]]
    assert got["b"] == [[("DINING_OUT", 50_000)], [("DINING_OUT", 25_000), ("TRANSPORT", 25_000)], [("DINING_OUT", 16_000), ("TRANSPORT", 16_000), ("SHOPPING", 18_000)]]
    assert "c" not in got and got["d"] == [[("DINING_OUT", 7_000)], [("TRANSPORT", 7_000)]]
