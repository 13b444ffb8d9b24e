"""Text rules: payees, senders, templates, message filters."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words left out of a payee's key, and the patterns of message filters.
STOP_WORDS = ["pvt", "private", "ltd", "limited", "llp", "inc", "india", "the", "co", "company", "and"]
PERSON_VPA = r"(?i)^p[0-9a-f]{8}@[a-z0-9]+$"
OTP = r"(?i)\b(otp|one[\s-]?time[\s-]?password|verification code|security code)\b"
PROMO = r"(?i)(cashback (?:of )?up ?to|get up ?to|\bupto\b.*\boff\b|pre-?approved|apply now|limited period|\bwin\b|\bexclusive offer|\bcoupon\b|click here|t&c apply)"
COLLECT = r"(?i)(has requested (?:money|rs|inr|₹)|collect request|requested a payment|approve the request)"
BALANCE = r"(?i)\b(avl\.? ?bal|available balance|a/c balance|account balance|bal:)"
MOVEMENT = r"(?i)\b(debited|credited|paid|sent|received|spent|withdrawn|withdrawal|purchase|transferred|deposited|refund(?:ed)?|reversed|failed|declined|txn|transaction)\b"
BANK_SENDER = r"^[A-Z]{2}-[A-Z0-9]{3,9}(-[A-Z])?$"
BLOCKED = {
    "BODY": ["fat", "moti", "mota", "ugly", "skinny", "weight", "belly", "face"],
    "HEALTH": ["diabetes", "diabetic", "sick", "disease", "depressed", "mental"],
    "FAMILY": ["your mom", "your mother", "your father", "your wife", "your husband", "maa", "baap"],
    "IDENTITY": ["caste", "religion", "hindu", "muslim", "christian", "sikh", "dalit", "gay", "girly"],
    "PROFANITY": ["fuck", "shit", "bitch", "bastard", "chutiya", "bc", "mc", "saala", "kamina"],
}
MAX_TEXT = 400


def is_person_vpa(raw: Column) -> Column:
    return F.coalesce(F.trim(raw).rlike(PERSON_VPA), F.lit(False))


def merchant_key(raw: Column) -> Column:
    """Lower-cased words of a payee before any `@`, without stop words; `&` is a word."""
    name = F.split(F.lower(F.trim(raw)), "@")[0]
    words = F.split(F.replace(name, F.lit("&"), F.lit(" & ")), "[^a-z&]+")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(STOP_WORDS)), " ")


def sender_key(sender: Column, source_app: Column) -> Column:
    """Last part of a sender, upper-cased; else the app's package."""
    own = F.upper(F.element_at(F.split(F.trim(sender), "-"), -1))
    return F.when(F.trim(sender) != "", own).otherwise(F.when(F.trim(source_app) != "", F.trim(source_app)))


def is_bank_sender(sender: Column) -> Column:
    return F.coalesce(sender.rlike(BANK_SENDER), F.lit(False))


def template_signature(text: Column, sender: Column) -> Column:
    """A message with addresses, accounts, numbers and capital words masked, after its sender's key."""
    steps = [(r"(?i)\b[\w.\-]+@[a-z][a-z0-9]+\b", "<vpa>"), (r"(?i)(?:\bXX|\*\*|\bx)\d{3,4}\b", "<acct>"), (r"\d[\d,]*(?:\.\d+)?", "<n>"), (r"\b[A-Z][A-Z0-9&.'-]{2,}\b", "<name>"), (r"\s+", " ")]
    masked = reduce(lambda t, s: F.regexp_replace(t, *s), steps, text)
    return F.concat(F.upper(F.element_at(F.split(F.coalesce(sender, F.lit("")), "-"), -1)), F.lit("|"), F.lower(F.trim(masked)))


def drop_reason(text: Column) -> Column:
    """Why a message is no payment; null if it may be one."""
    moves = text.rlike(MOVEMENT)
    return (
        F.when(text.isNull() | ~text.rlike(r"\S"), "EMPTY")
        .when(text.rlike(OTP), "OTP")
        .when(text.rlike(COLLECT), "COLLECT_REQUEST")
        .when(text.rlike(PROMO) & ~moves, "PROMO")
        .when(text.rlike(BALANCE) & ~moves, "BALANCE_ONLY")
        .when(~text.rlike("[0-9]"), "NO_AMOUNT")
    )


def blocked_reason(text: Column) -> Column:
    """Why a text must not be sent; null if it may be."""
    out = F.when(~text.rlike(r"\S"), "EMPTY").when(F.length(text) > MAX_TEXT, "TOO_LONG")
    for reason, words in BLOCKED.items():
        out = out.when(text.rlike(r"(?i)\b(" + "|".join(words) + r")\b"), reason)
    return out


def scrub_digits(text: Column) -> Column:
    """Runs of 13 digits or more keep their last four."""
    runs = F.regexp_extract_all(text, F.lit(r"(\d+|[^\d]+)"), F.lit(1))
    masked = lambda run: F.concat(F.repeat(F.lit("X"), F.length(run) - 4), F.substring(run, -4, 4))
    return F.array_join(F.transform(runs, lambda run: F.when(run.rlike(r"^\d{13,}$"), masked(run)).otherwise(run)), "")


def outer_trigrams(text: Column) -> Column:
    """Distinct trigrams of the whole string with two spaces before and one after."""
    padded = F.concat(F.lit("  "), text, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def overlap(a: Column, b: Column) -> Column:
    """Shared share of two arrays of distinct items; 0 where both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def payee_similarity(a: Column, b: Column) -> Column:
    """Of two payee keys: 1 if equal, 0 if one is empty, else the trigrams' shared share."""
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(overlap(outer_trigrams(a), outer_trigrams(b)))


def word_trigrams(text: Column) -> Column:
    """Distinct trigrams word by word, each with two spaces before and one after."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")
    return F.array_distinct(F.flatten(F.transform(words, outer_trigrams)))
