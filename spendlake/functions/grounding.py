"""Numbers in texts, held against the values that a text may state, and checks of extracted fields."""

import json
import math
import re
from datetime import date

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from spendlake.functions.binding import once
from spendlake.functions.money import all_number_amounts, rupees_to_paise

# Units of numbers, and the words that back a direction or status.
UNITS = {"k": 1_000, "lakh": 100_000, "lac": 100_000, "cr": 10_000_000}
NUMBER_TOKEN = r"(?i)(?<![\w.])(?:rs\.?|inr|₹)?\s*([0-9][0-9,]*(?:\.[0-9]+)?)\s*(k|lakh|lac|cr|st|nd|rd|th)?(?![a-z0-9])"
DEBIT_WORDS = r"(?i)\b(debited|paid|sent|spent|withdrawn|withdrawal|purchase|payment of|transferred to|dr\.?)\b"
CREDIT_WORDS = r"(?i)\b(credited|received|deposited|cr\.?|refunded|added to)\b"
FAILED_WORDS = r"(?i)\b(failed|failure|declined|unsuccessful|could not be|rejected)\b"
REVERSAL_WORDS = r"(?i)\b(revers\w*|refund\w*)\b"


def numbers(text: Column) -> Column:
    """Values (decimal) of the numbers in a text, in order; `1.2k` is 1200, `22nd` is 22."""
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(NUMBER_TOKEN), F.lit(1)).alias("digits"), F.regexp_extract_all(text, F.lit(NUMBER_TOKEN), F.lit(2)).alias("unit"))
    factors = F.create_map(*(F.lit(x) for item in UNITS.items() for x in item))

    def value(pair: Column) -> Column:
        digits = F.regexp_replace(pair["digits"], ",", "").cast("decimal(24,4)")
        return (digits * F.coalesce(factors[F.lower(pair["unit"])], F.lit(1))).cast("decimal(30,4)")

    return F.transform(pairs, value)


def allowed_values(paise: Column, counts: Column, dates: Column | None = None) -> Column:
    """Values that a text may state: amounts (array of paise) in rupees, exact and to the whole rupee (half to even), counts (array), and day, month and year of dates (array)."""
    rupees = lambda p: (p.cast("decimal(22,0)") / 100).cast("decimal(30,4)")
    exact = F.transform(paise, rupees)
    whole = F.transform(paise, lambda p: F.bround(rupees(p), 0).cast("decimal(30,4)"))
    of_dates = [F.transform(dates, lambda d: f(d).cast("decimal(30,4)")) for f in (F.dayofmonth, F.month, F.year)] if dates is not None else []  # noqa: B023
    return F.array_distinct(F.concat(exact, whole, F.transform(counts, lambda c: c.cast("decimal(30,4)")), *of_dates))


PARTS = "paise array<bigint>, counts array<bigint>, dates array<date>, texts array<string>"


def leaves(result: str | None) -> list[tuple[str, object]]:
    """(key, value) of every leaf of a JSON text, in order; items of a list have the list's key. None for what is no JSON."""
    try:
        waiting = [("", json.loads(result or "null"))]
    except ValueError:
        return []
    out = []
    while waiting:
        key, value = waiting.pop()
        if isinstance(value, dict):
            waiting += reversed(value.items())
        elif isinstance(value, list):
            waiting += [(key, v) for v in reversed(value)]
        else:
            out.append((key, value))
    return out


def parts_of(result: str | None) -> dict[str, list]:
    """What a result states: whole numbers under names that end in Paise are amounts, others counts; fractions count rounded, and shares from 0 to 1 also as percent; texts that begin with a date give it."""
    out: dict[str, list] = {"paise": [], "counts": [], "dates": [], "texts": []}
    for key, value in leaves(result):
        if isinstance(value, str):
            out["texts"].append(value)
            if re.match(r"\d{4}-\d{2}-\d{2}", value):
                try:
                    out["dates"].append(date.fromisoformat(value[:10]))
                except ValueError:
                    pass
        elif isinstance(value, float) and math.isfinite(value):
            out["counts"] += [round(value)] + [round(100 * value)] * (0 <= value <= 1)
        elif isinstance(value, int) and not isinstance(value, bool):
            out["paise" if key.endswith(("Paise", "_paise")) else "counts"].append(value)
    return out


def allowed_from_results(results: Column) -> Column:
    """Values that a text on results (array of JSON texts) may state: their amounts, counts, dates, and the numbers in their texts."""

    @F.pandas_udf(f"array<struct<{PARTS.replace(' ', ': ').replace(',: ', ', ')}>>")
    def read(rows: pd.Series) -> pd.Series:
        return rows.map(lambda own: [parts_of(r) for r in own] if own is not None else [])

    def values(parts: Column) -> Column:
        every = lambda name: F.flatten(F.transform(parts, lambda p: p[name]))
        return F.array_union(allowed_values(every("paise"), every("counts"), every("dates")), F.flatten(F.transform(every("texts"), numbers)))

    return once(read(results), values)


def ungrounded(text: Column, allowed: Column) -> Column:
    """The text's numbers that neither as they are nor to the whole rupee are allowed."""
    good = lambda v: F.array_contains(allowed, v) | F.array_contains(allowed, F.bround(v, 0).cast("decimal(30,4)"))
    return F.filter(numbers(text), lambda v: ~good(v))


def squeezed(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"\s+", ""))


def failure(x: Column, text: Column) -> Column:
    """The first thing wrong with an extraction (struct of is_transaction, amount, direction, status, reference_id, balance_after) of a text; null if it holds."""
    seen = F.struct(
        rupees_to_paise(x["amount"]).alias("amount"), rupees_to_paise(x["balance_after"]).alias("balance"), all_number_amounts(text).alias("stated"),
        text.rlike(DEBIT_WORDS).alias("debit"), text.rlike(CREDIT_WORDS).alias("credit"),
    )
    reference = F.coalesce(x["reference_id"], F.lit(""))

    def first_fault(s: Column) -> Column:
        return (
            F.when(x["amount"].isNull(), "MISSING_AMOUNT")
            .when(s["amount"].isNull() | (s["amount"] <= 0), "BAD_AMOUNT")
            .when(~F.array_contains(s["stated"], s["amount"]), "AMOUNT_NOT_IN_TEXT")
            .when((reference != "") & ~F.contains(squeezed(text), squeezed(reference)), "REFERENCE_NOT_IN_TEXT")
            .when(x["direction"].isNull(), "MISSING_DIRECTION")
            .when(((x["direction"] == "DEBIT") & s["credit"] & ~s["debit"]) | ((x["direction"] == "CREDIT") & s["debit"] & ~s["credit"]), "DIRECTION_MISMATCH")
            .when((x["status"] == "FAILED") & ~text.rlike(FAILED_WORDS), "FAILED_WITHOUT_KEYWORD")
            .when((x["status"] == "REVERSED") & ~text.rlike(REVERSAL_WORDS), "REVERSED_WITHOUT_KEYWORD")
            .when(x["balance_after"].isNotNull() & (s["balance"].isNull() | ~F.array_contains(s["stated"], F.abs(s["balance"]))), "BAD_BALANCE")
        )

    return F.when(~F.coalesce(x["is_transaction"], F.lit(False)), "NOT_TRANSACTION").otherwise(once(seen, first_fault))


def same_extraction(a: Column, b: Column) -> Column:
    """Whether two extractions agree on every field that a rule can give; amounts as paise, texts without case, accounts by their last four."""
    plain = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    tail = lambda c: F.right(F.coalesce(c, F.lit("")), F.lit(4))
    pairs = [(a["is_transaction"], b["is_transaction"]), (a["direction"], b["direction"]), (a["status"], b["status"])]
    pairs += [(f(a[c]), f(b[c])) for c, f in (("amount", rupees_to_paise), ("balance_after", rupees_to_paise), ("merchant_raw", plain), ("reference_id", plain), ("account_hint", tail))]
    out = F.lit(True)
    for x, y in pairs:
        out = out & x.eqNullSafe(y)
    return out
