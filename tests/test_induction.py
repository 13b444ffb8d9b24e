"""Rules learnt from samples; proposals that don't give back their samples; the cooldown."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from spendlake.operators import induction, parsing

T0 = datetime(2026, 10, 3)
NAMES = ["is_transaction", "amount", "direction", "channel", "status", "merchant_raw", "counterparty_vpa", "reference_id", "account_hint", "balance_after", "promised_refund_days"]
MESSAGE = f"event_id string, user_id long, sender string, source_app string, text string, posted_at timestamp_ntz, truth {parsing.EXTRACTION}"


def upi(n, amount, vpa, ref, user=1, **more):
    text = f"Sent Rs.{amount} from HDFC Bank A/c **1234 to {vpa} on 03/10/26 Ref {ref}"
    fields = dict(is_transaction=True, amount=amount, direction="DEBIT", channel="UPI", status="SUCCESS", merchant_raw=vpa, counterparty_vpa=vpa, reference_id=ref, account_hint="1234") | more
    return (f"e{n}", user, "AX-HDFCBK", None, text, T0 + timedelta(minutes=n), tuple(fields.get(c) for c in NAMES))


SAMPLES = [upi(1, "120.00", "chai@ybl", "512345678901"), upi(2, "1,050", "ola@axl", "51234567")]
GOOD = r"Sent Rs\.?(?P<amount>[\d,]+(?:\.\d{1,2})?) from HDFC Bank A/c \*\*(?P<acct>\d{4}) to (?P<vpa>[\w.\-]+@\w+) on [\d/]+ Ref (?P<ref>\d{6,})"
FIXED = {"direction": "DEBIT", "channel": "UPI", "status": "SUCCESS"}


def judged(spark, writer, rows=SAMPLES):
    groups = induction.newest(spark.createDataFrame(rows, MESSAGE))
    return induction.checked(induction.proposals(groups, writer)).collect()


def test_written_rules_are_checked(spark):
    rule = lambda regex=GOOD, **changed: lambda key, samples: {"regex": regex} | FIXED | changed
    (good,) = judged(spark, rule())
    assert good.reason is None and good.id.startswith("r_syn_") and good.id == judged(spark, rule())[0].id and good.n_samples == 2
    vpa, ref = r"(?P<vpa>[\w.\-]+@\w+)", r"(?P<ref>\d{6,})"
    cases = {
        "no_match": rule(GOOD.replace("Sent", "Paid")), "fields_differ": rule(GOOD.replace(ref, r"(?P<ref>\d{4})")), "channel_differs": rule(channel="CARD"), "literal_data": rule(GOOD.replace(vpa, "chai@ybl")),
        "bad_status": rule(status="X"), "does_not_compile": rule("("), "no_rule": lambda key, samples: None, "writer_error": lambda key, samples: 1 / 0,
    }
    for reason, writer in cases.items():
        assert [r.reason for r in judged(spark, writer)] == [reason], reason
    assert [r.reason for r in judged(spark, rule(direction="CREDIT"))] == ["fields_differ"]
    assert [r.reason for r in judged(spark, rule(), SAMPLES[:1])] == ["too_few_samples"]


def test_a_writer_that_fails_on_one_group_leaves_the_others(spark):
    rows = [*SAMPLES, *(upi(i, "5.00", "b@ybl", "99887766", user=2) for i in (3, 4))]
    writer = lambda key, samples: 1 / 0 if samples[0][1]["amount"] == "5.00" else {"regex": GOOD} | FIXED
    assert sorted(str(r.reason) for r in judged(spark, writer, rows)) == ["None", "writer_error"]


def test_learnt_rules_read_other_messages(spark):
    learnt = induction.learnt(spark.createDataFrame([*SAMPLES, (*SAMPLES[0][:1], 3, *SAMPLES[0][2:]), ("n", 1, None, None, "no sender", T0, SAMPLES[0][6]), ("t", 1, "AX-HDFCBK", None, None, T0, None)], MESSAGE), status="ACTIVE")
    other = [("x", "VM-HDFCBK", None, "Sent Rs.77.5 from HDFC Bank A/c **9876 to some.shop@oksbi on 29/11/27 Ref 600000001"), ("y", "VM-HDFCBK", None, "Paid Rs.77.5 from HDFC Bank")]
    got = {r.event_id: r for r in parsing.parse(spark.createDataFrame(other, "event_id string, sender string, source_app string, text string"), learnt).collect()}
    assert (got["x"].outcome, got["x"].amount_paise, got["x"].merchant_raw, got["x"].reference_id, got["x"].account_hint) == ("PARSED", 7750, "some.shop@oksbi", "600000001", "9876")
    assert got["y"].outcome == "FAILED"
    assert induction.learnt(spark.createDataFrame([], MESSAGE)).count() == 0


def test_what_differs_becomes_a_slot():
    fields = lambda amount, name: {"amount": amount, "direction": "DEBIT", "merchant_raw": name, "account_hint": "0042", "balance_after": "10"}
    rule = induction.induced("K", [("Card XX0042 used at Tea Stall for Rs 10 on 3Oct. Bal Rs 10.00 ok", fields("10", "Tea Stall")), ("Card XX0042 used at H&M for Rs 1,234.50 on 12Nov. Bal Rs 10.00 ok", fields("1234.5", "H&M"))])
    import re

    got = re.search(rule["regex"], "Card XX7777 used at Some Other Shop for Rs 9.99 on 1Dec. Bal Rs 5 ok").groupdict()
    assert got == {"acct": "7777", "merchant": "Some Other Shop", "amount": "9.99", "bal": "5"}
    assert parsing.fault(rule["regex"], "DEBIT") is None
    assert induction.induced("K", [("Rs 5 to a", {"amount": "5", "merchant_raw": "a", "direction": "DEBIT"}), ("b got Rs 5", {"amount": "5", "merchant_raw": "b", "direction": "DEBIT"})]) is None


def test_cooldown_like_a_plain_pass(spark):
    draw = random.Random(1)
    rows = [(draw.choice(["a", "b", "c", None]), T0 + timedelta(minutes=draw.randrange(20_000))) for _ in range(300)] + [("d", T0), ("d", T0), ("e", None)]
    got = induction.cooled(spark.createDataFrame(rows, "template string, at timestamp_ntz"), 6 * 3600).collect()
    assert len(got) == len(rows)
    for template in {r[0] for r in rows}:
        want, last = [], None
        for at in sorted(a for t, a in rows if t == template and a):
            want.append((at, last is None or at - last >= timedelta(hours=6)))
            last = at if want[-1][1] else last
        assert sorted((r["at"], r.ready) for r in got if r.template == template and r["at"]) == sorted(want)
    assert [r.ready for r in got if r.template == "e"] == [False]
    assert induction.cooled(spark.createDataFrame(rows, "template string, at timestamp_ntz"), 0).where(~F.col("ready")).count() <= 2


def test_samples_are_the_newest(spark):
    rows = [upi(i, f"{i}.00", f"shop{i}@ybl", str(100_000 + i)) for i in range(1, 60)]
    (group,) = induction.newest(spark.createDataFrame(rows, MESSAGE)).collect()
    assert [s.event_id for s in group.samples] == [f"e{i}" for i in range(59, 54, -1)]
