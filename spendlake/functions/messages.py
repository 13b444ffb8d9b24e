"""Texts for users: dates, forecasts, a day's summary and logged cash. Wordings are fixed values."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from spendlake.functions.money import format_inr

LOGGED = {"CASH_SPEND": "Logged cash spend", "CASH_RECEIVED": "Logged cash received", "ATM_WITHDRAWAL": "Logged ATM withdrawal", "UNACCOUNTED": "Logged unaccounted cash"}


def short_day(day: Column) -> Column:
    """`18 Oct`."""
    return F.date_format(day, "d MMM")


def broke_label(day: Column, today: Column, horizon: Column) -> Column:
    """The day, or that it lies after the horizon."""
    return F.coalesce(short_day(day), F.concat(F.lit("after "), short_day(F.date_add(today, horizon))))


def broke_range(early: Column, late: Column, today: Column, horizon: Column) -> Column:
    """Both labels, or one if they are the same."""
    low, high = broke_label(early, today, horizon), broke_label(late, today, horizon)
    return F.when(low == high, low).otherwise(F.concat(low, F.lit(" – "), high))


def cash_state(balance: Column) -> Column:
    """Cash in hand; a negative balance is said as what was logged beyond it."""
    return F.when(balance >= 0, F.concat(F.lit("Cash in hand: "), format_inr(balance))).otherwise(F.concat(F.lit("You logged "), format_inr(-balance), F.lit(" more than tracked cash")))


def day_text(day: Column, total: Column, n: Column, cash: Column, top: Column, balance: Column) -> Column:
    """A day's summary; top: array of (name, paise)."""
    spent = F.concat(F.lit("Spent "), format_inr(total), F.lit(" in "), n.cast("string"), F.when(n == 1, " payment").otherwise(" payments"), F.when(cash > 0, F.concat(F.lit(" + "), format_inr(cash), F.lit(" cash"))).otherwise(""))
    names = F.when(F.size(top) > 0, F.concat(F.lit("Top: "), F.array_join(F.transform(top, lambda t: F.concat(t["name"], F.lit(" "), format_inr(t["paise"]))), ", ")))
    nothing = (n == 0) & (cash == 0)
    return F.concat_ws("\n", F.concat(F.lit("📊 Today, "), short_day(day)), F.when(nothing, "No spends recorded today. 🙌").otherwise(spent), F.when(~nothing, names), cash_state(balance))


def logged_text(entry_type: Column, amount: Column, note: Column, category: Column) -> Column:
    """What was logged, with its note and category, if it has them."""
    verb = F.element_at(F.create_map(*(F.lit(x) for kv in LOGGED.items() for x in kv)), entry_type)
    said = F.when(F.coalesce(note, F.lit("")) != "", F.concat(F.lit(" · "), note)).otherwise("")
    kind = F.when((category != "") & (category != "CASH_UNCATEGORIZED"), F.concat(F.lit(" ("), F.lower(F.replace(category, F.lit("_"), F.lit(" "))), F.lit(")"))).otherwise("")
    return F.concat(F.lit("✅ "), verb, F.lit(" "), format_inr(amount), said, kind)
