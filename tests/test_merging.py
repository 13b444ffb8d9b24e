"""Merging of reports: scenarios, and a plain pass over all of a user's reports."""

import os
import random
from datetime import datetime, timedelta

import pytest

from spendlake.functions.text import STOP_WORDS
from spendlake.operators import merging

TABLES = "/root/testdata/sf0.001"
T0 = datetime(2026, 10, 3, 8)
SCHEMA = "seq long, event_id string, user_id long, raw_type string, source_app string, amount_paise long, direction string, status string, channel string, txn_time timestamp_ntz, merchant_raw string, merchant_id long, category string, reference_id string, account_hint string, balance_after_paise long, parse_method string"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def report(seq, **given):
    base = dict(event_id=f"e{seq}", user_id=1, raw_type="RAW_NOTIFICATION", source_app="com.phonepe.app", amount_paise=34900, direction="DEBIT", status="SUCCESS", channel="UPI", txn_time=T0, merchant_raw="zomato@hdfcbank", merchant_id=7, category="FOOD_DELIVERY", reference_id=None, account_hint="1234", balance_after_paise=None, parse_method="RULE")
    return {"seq": seq} | base | given


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[c] for c in NAMES) for r in rows], SCHEMA)


def final(spark, rows):
    return {r["payment"]: r for r in merging.latest(merging.payments(frame(spark, rows))).collect()}


SMS = dict(raw_type="RAW_SMS", source_app=None)


def test_scenarios(spark):
    minutes = lambda n: T0 + timedelta(minutes=n)
    one = final(spark, [report(1), report(2, **SMS, txn_time=minutes(1), merchant_raw="ZOMATO", reference_id="R1")])
    assert [(r["version"], r["reference_id"], r["kind"]) for r in one.values()] == [(2, "R1", "SPEND")]
    assert len(final(spark, [report(1), report(2)])) == 2  # the same app twice
    late = final(spark, [report(1, reference_id="R", status="PENDING"), report(2, **SMS, txn_time=minutes(1200), reference_id="R")])
    assert [(r["version"], r["status"]) for r in late.values()] == [(2, "SUCCESS")]
    assert len(final(spark, [report(1), report(2, **SMS, txn_time=minutes(20))])) == 2
    both = final(spark, [report(1), report(2, direction="CREDIT", account_hint="9999", txn_time=minutes(4), merchant_id=None)])
    assert sorted((r["kind"], r["version"], r["category"]) for r in both.values()) == [("SELF_TRANSFER", 1, "TRANSFERS"), ("SELF_TRANSFER", 2, "TRANSFERS")]
    back = final(spark, [report(1, reference_id="R"), report(2, direction="CREDIT", amount_paise=100, reference_id="R", txn_time=minutes(9000))])
    assert back[2]["kind"] == "REVERSAL"
    paid = final(spark, [report(1), report(2, direction="CREDIT", amount_paise=100, txn_time=minutes(60 * 24 * 80))])
    assert paid[2]["kind"] == "REFUND"
    gone = final(spark, [report(1), report(2, direction="CREDIT", amount_paise=100, txn_time=minutes(60 * 24 * 91))])
    assert gone[2]["kind"] == "INCOME"
    again = final(spark, [report(1), report(2, event_id="e1")])
    assert [r["version"] for r in again.values()] == [1]
    assert final(spark, [report(1, channel="ATM")])[1]["kind"] == "ATM_WITHDRAWAL"


def test_scores(spark):
    rows = [report(1), report(2), report(3, txn_time=T0 + timedelta(minutes=10)), report(4, txn_time=T0 + timedelta(minutes=10), merchant_raw="uber", account_hint=None)]
    pairs = merging.candidate_pairs(frame(spark, rows).withColumnRenamed("event_id", "id")).collect()
    scores = {(r["id"], r["other"]): r["score"] for r in pairs}
    assert scores["e2", "e1"] == 10 and scores["e3", "e1"] == 7 and scores["e4", "e1"] == 4


def test_long_gaps_meet_only_with_a_reference(spark):
    rows = [report(1), report(2, txn_time=T0 + timedelta(hours=30), reference_id="R"), report(3, txn_time=T0 + timedelta(hours=31))]
    pairs = {(r["id"], r["other"]) for r in merging.candidate_pairs(frame(spark, rows).withColumnRenamed("event_id", "id")).collect()}
    assert pairs == {("e2", "e1")}


def key(raw):
    import re

    return " ".join(w for w in re.split("[^a-z&]+", raw.strip().lower().split("@")[0].replace("&", " & ")) if w and w not in STOP_WORDS)


def plain_pass(rows):
    """All of one user's reports one after another, each held against all payments so far."""
    grams = lambda k: {f"  {k} "[i : i + 3] for i in range(len(k) + 1)}

    def like(a, b):
        if not a or not b:
            return 0
        if a.strip().lower() == b.strip().lower():
            return 1
        a, b = grams(key(a)) if key(a) else set(), grams(key(b)) if key(b) else set()
        return len(a & b) / len(a | b) if a and b else 0

    payments, seen = [], set()
    for r in sorted(rows, key=lambda r: r["seq"]):
        if r["event_id"] in seen:
            continue
        seen.add(r["event_id"])
        gap = lambda p: abs((p["txn_time"] - r["txn_time"]).total_seconds())  # noqa: B023, E731
        near = [p for p in payments if p["amount_paise"] == r["amount_paise"] and p["direction"] == r["direction"] and gap(p) <= (172800 if r["reference_id"] else 900)]
        target = None
        for p in sorted(near, key=lambda p: (gap(p), p["payment"])):
            points = 4 + 3 * (gap(p) <= 180) + 2 * (like(p["merchant_raw"], r["merchant_raw"]) >= 0.4) + bool(r["account_hint"] and r["account_hint"] == p["account_hint"])
            if r["reference_id"] and r["reference_id"] == p["reference_id"]:
                target = p
            elif r["raw_type"] == "RAW_NOTIFICATION" and (r["raw_type"], r["source_app"]) in p["sources"]:
                continue
            elif points >= 8 or (points >= 6 and any(s[0] != r["raw_type"] for s in p["sources"])):
                target = p
            if target:
                break
        if target:
            for c in ("merchant_raw", "reference_id", "account_hint", "balance_after_paise"):
                target[c] = r[c] if target[c] is None else target[c]
            if target["merchant_id"] is None and r["merchant_id"] is not None:
                target["merchant_id"] = r["merchant_id"]
            if target["status"] == "PENDING":
                target["status"] = r["status"]
            target["sources"].add((r["raw_type"], r["source_app"]))
            target["version"] += 1
            continue
        p = dict(r) | {"payment": r["seq"], "version": 1, "sources": {(r["raw_type"], r["source_app"])}}
        kind = "INCOME" if r["direction"] == "CREDIT" else "ATM_WITHDRAWAL" if r["channel"] == "ATM" else "SPEND"
        debits = [x for x in payments if x["direction"] == "DEBIT"]
        if r["direction"] == "CREDIT" and r["reference_id"] and any(x["reference_id"] == r["reference_id"] for x in debits):
            kind = "REVERSAL"
        elif r["direction"] == "CREDIT" and r["merchant_id"] is not None and any(x["merchant_id"] == r["merchant_id"] and timedelta(0) <= r["txn_time"] - x["txn_time"] <= timedelta(days=90) for x in debits):
            kind = "REFUND"
        elif r["account_hint"] and kind != "ATM_WITHDRAWAL":
            other = next((x for x in payments if x["amount_paise"] == r["amount_paise"] and x["direction"] != r["direction"] and x["kind"] in ("SPEND", "INCOME") and x["account_hint"] not in (None, r["account_hint"]) and gap(x) <= 600), None)
            if other:
                kind = other["kind"] = "SELF_TRANSFER"
                other["version"] += 1
        payments.append(p | {"kind": kind})
    return sorted((p["user_id"], p["payment"], p["version"], p["kind"], p["status"], p["reference_id"] or "", p["account_hint"] or "", p["merchant_id"] or 0) for p in payments)


@pytest.mark.parametrize("seconds", [400_000, 12_000_000])  # one stretch of time, and many
def test_random_reports_like_a_plain_pass(spark, seconds):
    draw = random.Random(5)
    rows = []
    for seq in range(1, 700):
        rows.append(report(
            seq, event_id=f"e{draw.randrange(600)}", user_id=draw.randrange(3), raw_type=draw.choice(["RAW_NOTIFICATION", "RAW_SMS"]), source_app=draw.choice(["a", "b"]), amount_paise=draw.choice([100, 200, 300]), direction=draw.choice(["DEBIT", "DEBIT", "CREDIT"]),
            status=draw.choice(["SUCCESS", "PENDING"]), txn_time=T0 + timedelta(seconds=draw.randrange(seconds)), merchant_raw=draw.choice([None, "zomato", "Zomatto Ltd", "uber", "12@ybl"]), merchant_id=draw.choice([None, None, None, 1, 2]), reference_id=draw.choice([None, None, f"R{draw.randrange(90)}"]), account_hint=draw.choice([None, "1", "2"]),
        ))
    got = sorted((r["user_id"], r["payment"], r["version"], r["kind"], r["status"], r["reference_id"] or "", r["account_hint"] or "", r["merchant_id"] or 0) for r in final(spark, rows).values())
    want = sorted(x for u in range(3) for x in plain_pass([r for r in rows if r["user_id"] == u]))
    assert got == want


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="the test tables are not here")
def test_query_like_a_plain_pass(spark):
    from spendlake.plans import flows

    by_user = {}
    for r in flows.reports(spark, TABLES).collect():
        by_user.setdefault(r["user_id"], []).append(r.asDict())
    want = sorted((p[1], p[2], p[3], p[4], p[5], p[6]) for rows in by_user.values() for p in plain_pass(rows))
    got = sorted((r["payment"], r["version"], r["kind"], r["status"], r["reference_id"] or "", r["account_hint"] or "") for r in flows.QUERIES["dedup_merge"](spark, TABLES).collect())
    assert len(got) > 500 and got == want


def test_islands(spark):
    hours = [0, 47, 48, 95, 200, 201, 400, 401]
    rows = spark.createDataFrame([(1, 5, h * 3_600_000_000) for h in hours] + [(2, 5, 0)], "user_id long, amount_paise long, micros long")
    got = {(r.user_id, r.micros // 3_600_000_000): r.island for r in merging.islands(rows).collect()}
    assert [got[1, h] for h in hours] == [1, 1, 1, 1, 2, 2, 3, 3] and got[2, 0] == 1


def test_no_reports(spark):
    assert merging.payments(frame(spark, [])).count() == 0
