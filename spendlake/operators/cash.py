"""The cash ledger, and cash lines typed by hand."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlake.functions.binding import once

INTO_WALLET = ["ATM_WITHDRAWAL", "CASH_RECEIVED"]
OUT_OF_WALLET = ["CASH_SPEND", "UNACCOUNTED"]


def balances(ledger: DataFrame) -> DataFrame:
    """Of each user: cash balance, cash in hand (never below 0), and what is logged beyond it."""
    sign = F.when(F.col("entry_type").isin(INTO_WALLET), F.col("amount_paise")).when(F.col("entry_type").isin(OUT_OF_WALLET), -F.col("amount_paise")).otherwise(0)
    out = ledger.groupBy("user_id").agg(F.sum(sign).alias("balance_paise"))
    return out.withColumn("in_hand_paise", F.greatest(F.lit(0), "balance_paise").cast("long")).withColumn("over_logged_paise", F.greatest(F.lit(0), -F.col("balance_paise")).cast("long"))


def habits(ledger: DataFrame, n: int = 6) -> DataFrame:
    """Of each user's n categories with most cash spends: count, whole median, sum and the first three notes."""
    spends = ledger.where("entry_type = 'CASH_SPEND'")
    each = spends.groupBy("user_id", "category").agg(F.count(F.lit(1)).alias("n"), F.median("amount_paise").cast("long").alias("median_paise"), F.sum("amount_paise").alias("total_paise"), F.array_join(F.slice(F.array_sort(F.collect_set("note")), 1, 3), ", ").alias("notes"))
    order = Window.partitionBy("user_id").orderBy(F.desc("n"), "category")
    return each.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def unaccounted(ledger: DataFrame) -> DataFrame:
    """For each withdrawal: cash logged since (at the same moment too), and what of it is not accounted for."""
    order = Window.partitionBy("user_id").orderBy(F.col("occurred_at").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    logged = F.sum(F.when(F.col("entry_type").isin(OUT_OF_WALLET), F.col("amount_paise")).otherwise(0)).over(order)
    out = ledger.withColumn("logged_paise", logged).where("entry_type = 'ATM_WITHDRAWAL'")
    return out.select("id", "user_id", "amount_paise", "logged_paise", F.greatest(F.lit(0), F.col("amount_paise") - F.col("logged_paise")).cast("long").alias("unaccounted_paise"))


STEP, WORTH_ASKING = 1_000, 5_000
USUAL = ["DINING_OUT", "TRANSPORT", "SHOPPING"]


def shares(total: Column, parts: Column, n: int) -> Column:
    """`total` paise dealt to the first n of parts (category, weight) in whole ten rupees; the last takes what is left."""
    weights = F.aggregate(F.slice(parts, 1, n), F.lit(0).cast("long"), lambda a, p: a + p["weight"])
    left, out = total, []
    for i in range(n):
        own = F.get(parts, F.lit(i))
        # whole numbers without overflow: the share goes by decimal division
        rounded = F.greatest(F.lit(STEP), F.floor(F.floor(total.cast("decimal(20,0)") * own["weight"] / weights) / STEP) * STEP).cast("long")
        amount = left if i == n - 1 else F.least(left - STEP * (n - i - 1), rounded)
        out.append(F.struct(own["category"].alias("category"), amount.cast("long").alias("amount_paise")))
        left = left - F.greatest(amount, F.lit(0))
    return F.filter(F.array(*out), lambda x: x["amount_paise"] > 0)


def breakdowns(withdrawals: DataFrame, habits_: DataFrame) -> DataFrame:
    """For each withdrawal (id, user_id, unaccounted_paise) with fifty rupees or more not accounted for: up to three ways it may have gone.

    habits_: user_id, category, place, total_paise (at most six rows a user). Ways go by the first one, two and
    three categories; with fewer than three, the first usual category that isn't among them stands for the third.
    """
    top = habits_.where("total_paise > 0").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("place", "category", F.col("total_paise").alias("weight")))).alias("h"))
    usual = F.array(*(F.struct(F.lit(c).alias("category"), F.lit(1).cast("long").alias("weight")) for c in USUAL))
    rows = withdrawals.where(F.col("unaccounted_paise") >= WORTH_ASKING).join(top, "user_id", "left")
    rows = rows.withColumn("parts", F.coalesce(F.transform("h", lambda x: F.struct(x["category"].alias("category"), x["weight"].alias("weight"))), usual)).drop("h")
    n, total, parts = F.size("parts"), F.col("unaccounted_paise"), F.col("parts")
    other = F.filter(usual, lambda u: ~F.exists(parts, lambda p: p["category"] == u["category"]))
    ways = F.array(shares(total, parts, 1), F.when(n >= 2, shares(total, parts, 2)), F.when(n >= 3, shares(total, parts, 3)).when(F.size(other) > 0, shares(total, other, 1)))
    return rows.select("id", "user_id", F.array_distinct(F.filter(ways, lambda w: w.isNotNull() & (F.size(w) > 0))).alias("ways"))


# Words of cash lines. Of the usual fillers one, a name in its own right, is not among them; it stays in a note.
AMOUNT = r"(?i)(?<![\w.])(?:rs\.?|inr|₹)?\s*([0-9]+(?:\.[0-9]{1,2})?)\s*(k|/-)?(?![\w.])"
RECEIVED = r"(?i)\b(got|received|recieved|mila|mile|milaa|from|credited)\b"
ATM = r"(?i)\b(atm|withdrew|withdrawn|withdrawal|nikale|nikala)\b"
FILLER = r"(?i)\b(rs|inr|rupees?|for|on|spent|paid|diye|diya|de diye)\b"
MAX_CASH_PAISE = 100_000_000
MAX_LINE = 120
CATEGORY_WORDS = {
    "DINING_OUT": ["chai", "tea", "coffee", "vada", "pav", "samosa", "lunch", "dinner", "breakfast", "biryani", "dosa", "idli", "momos", "pani puri", "golgappe", "snack", "juice", "canteen"],
    "GROCERIES": ["sabzi", "vegetables", "veggies", "milk", "doodh", "grocery", "kirana", "fruits", "eggs", "atta", "rice"],
    "TRANSPORT": ["auto", "rickshaw", "bus", "metro", "train", "cab", "taxi", "petrol", "diesel", "parking", "toll", "fuel"],
    "SHOPPING": ["shoes", "shirt", "clothes", "tshirt", "jeans", "bag", "gift"],
    "ENTERTAINMENT": ["movie", "cinema", "game", "party"],
    "HEALTH": ["medicine", "medical", "doctor", "pharmacy", "tablets"],
    "BILLS_UTILITIES": ["recharge", "electricity", "bill", "gas", "water"],
    "RENT": ["rent", "kiraya"],
}


def guess_category(note: Column) -> Column:
    """The first category with a word that stands in the note or begins it."""
    text = F.trim(F.lower(note))
    out = F.when(note.isNull(), "CASH_UNCATEGORIZED")
    for category, words in CATEGORY_WORDS.items():
        any_of = "|".join(words)
        out = out.when(text.rlike(f"(?:^| )(?:{any_of})(?: |$)|^(?:{any_of})"), category)
    return out.otherwise("CASH_UNCATEGORIZED")


def parse_cash_line(text: Column) -> Column:
    """Struct of entry_type, amount_paise, note and category of a line with exactly one amount; null for other lines."""

    def entry(p: Column) -> Column:
        kind = F.when(p["rest"].rlike(ATM), "ATM_WITHDRAWAL").when(p["rest"].rlike(RECEIVED), "CASH_RECEIVED").otherwise("CASH_SPEND")
        words = F.regexp_replace(F.regexp_replace(p["rest"], FILLER, " "), r"\s+", " ")
        note = F.nullif(F.regexp_replace(words, r"^[ \-,.:]+|[ \-,.:]+$", ""), F.lit(""))
        return F.struct(kind.alias("entry_type"), p["paise"].cast("long").alias("amount_paise"), note.alias("note"))

    def categorised(e: Column) -> Column:
        return F.struct(e["entry_type"].alias("entry_type"), e["amount_paise"].alias("amount_paise"), e["note"].alias("note"), F.when(e["entry_type"] == "CASH_SPEND", guess_category(e["note"])).alias("category"))

    line = F.trim(text)
    number, suffix = F.regexp_extract(line, AMOUNT, 1), F.lower(F.regexp_extract(line, AMOUNT, 2))
    paise = F.round(number.try_cast("decimal(30,2)") * F.when(suffix == "k", 100_000).otherwise(100), 0).cast("decimal(38,0)")
    parts = F.struct(paise.alias("paise"), F.trim(F.regexp_replace(line, AMOUNT, " ")).alias("rest"))
    good = (F.size(F.regexp_extract_all(line, F.lit(AMOUNT), F.lit(0))) == 1) & (F.length(line) <= MAX_LINE) & (paise > 0) & (paise <= MAX_CASH_PAISE)
    return F.when(good, once(once(parts, entry), categorised))
