"""Money as whole paise: reading and writing rupee texts."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A number with optional Indian or Western grouping and up to two decimals.
NUMBER = r"(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]{1,2}(?:,[0-9]{2})+,[0-9]{3}|[0-9]+)(?:\.[0-9]{1,2})?"
MARKED = rf"(?i)(?:(?<![a-z])(?:rs\.?|inr)|₹)\s*({NUMBER})(?![0-9])"
ANY = rf"(?<![0-9])({NUMBER})(?![0-9])"
RUPEES = r"(?i)^\s*(?:rs\.?|inr|₹)?\s*([+-]?)\s*([0-9][0-9,]*)(?:\.([0-9]{1,2}))?\s*$"


def rupees_to_paise(text: Column) -> Column:
    """Paise of a rupee text such as `Rs.1,249.50`; null where it isn't one (more than two decimals, no digits, beyond 18 digits)."""
    sign, whole, frac = (F.regexp_extract(text, RUPEES, i) for i in (1, 2, 3))
    digits = F.regexp_replace(whole, ",", "")
    paise = F.try_to_number(F.concat(digits, F.rpad(frac, 2, "0")), F.lit("9" * 18)).cast("long")
    return F.when(whole == "", None).otherwise(F.when(sign == "-", -paise).otherwise(paise))


def paise_to_rupees(paise: Column) -> Column:
    return (paise.cast("decimal(20,2)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(20,2)")


def format_inr(paise: Column) -> Column:
    """`₹1,23,456.78`, `-₹5.00`: Indian grouping, two decimals."""
    size = F.abs(paise)
    whole = F.regexp_replace(F.floor(size / 100).cast("long").cast("string"), r"(\d)(?=(\d\d)+\d$)", "$1,")
    return F.concat(F.when(paise < 0, "-").otherwise(""), F.lit("₹"), whole, F.lit("."), F.lpad((size % 100).cast("string"), 2, "0"))


def _all_paise(numbers: Column) -> Column:
    """Paise of strings that NUMBER matches; those beyond 18 digits are left out."""
    return F.filter(F.transform(numbers, lambda x: (F.replace(x, F.lit(","), F.lit("")).try_cast("decimal(18,2)") * 100).cast("long")), lambda p: p.isNotNull())


def currency_amounts(text: Column) -> Column:
    """Paise of the amounts with a currency mark, in order."""
    return _all_paise(F.regexp_extract_all(text, F.lit(MARKED), F.lit(1)))


def all_number_amounts(text: Column) -> Column:
    """Paise of every number in the text read as rupees, each once."""
    return F.array_union(_all_paise(F.regexp_extract_all(text, F.lit(ANY), F.lit(1))), currency_amounts(text))
