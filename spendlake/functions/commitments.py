"""Promises in free text: at most so many payments in a period, or none, and until when."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from spendlake.functions.binding import once

# Wordings, months and words for periods.
LIMIT = r"(?i)\b(?:limit|max(?:imum)?|only|at most|sirf|bas)\s+([a-z][a-z .&']{1,30}?)\s+(?:to\s+)?(\d{1,2})\s*(?:x|times?|orders?|baar)?\s*(?:a|per|/|every|each|ek)\s*(week|month|day|hafte|mahine)"
NONE = r"(?i)\b(?:no|stop|band|nahi)\s+([a-z][a-z .&']{1,30}?)\s+(?:this|for a|for the|is)\s+(week|month|hafta|mahina)"
UNTIL = r"(?i)\b(?:till|until|upto|by|tak)\s+(\d{1,2})\s*([a-z]{3})"
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
PERIODS = {"hafte": "week", "hafta": "week", "mahine": "month", "mahina": "month"}


def until(text: Column, today: Column) -> Column:
    """The date that a text names, this year or next; null where it names none that exists."""
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.regexp_extract(text, UNTIL, 2))).cast("int")
    year = F.year(today) + (month < F.month(today)).cast("int")
    day = F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"), F.lpad(F.regexp_extract(text, UNTIL, 1), 2, "0"))
    return F.when(month > 0, day.try_cast("date"))


def commitment(text: Column, today: Column) -> Column:
    """Struct of target, max_count, period, until and text; null where the text promises nothing."""
    words = F.create_map(*(F.lit(x) for kv in PERIODS.items() for x in kv))

    def found(clean: Column, pattern: str, count: Column, place: int) -> Column:
        period = F.lower(F.regexp_extract(clean, pattern, place))
        return F.struct(F.lower(F.trim(F.regexp_extract(clean, pattern, 1))).alias("target"), count.alias("max_count"), F.coalesce(F.try_element_at(words, period), period).alias("period"), until(clean, today).alias("until"), clean.alias("text"))

    def promise(clean: Column) -> Column:
        return F.when(clean.rlike(LIMIT), found(clean, LIMIT, F.regexp_extract(clean, LIMIT, 2).try_cast("int"), 3)).when(clean.rlike(NONE), found(clean, NONE, F.lit(0), 2))

    return once(F.trim(F.regexp_replace(text, r"\s+", " ")), promise)


def due_at(until_date: Column) -> Column:
    """UTC wall time of 23:59 IST on a date."""
    return until_date.cast("timestamp_ntz") + F.expr("INTERVAL '18:29' HOUR TO MINUTE")
