"""Labelled messages: merging inputs, splits that keep templates apart, near-duplicates of protected rows, metrics."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendlake.functions.binding import once
from spendlake.functions.ids import hash_fraction
from spendlake.functions.money import rupees_to_paise
from spendlake.functions.text import template_signature
from spendlake.sources.scratch import cut

# Banks whose templates are never trained on.
HELD_OUT_SENDERS = ["CANBNK", "UBOI"]
SPLITS = ("train", "val", "gold_test")
PERMUTATIONS, BAND_ROWS, NEAR = 64, 4, 0.8
SHINGLE = 4
FIELDS = ("amount", "direction", "status", "merchant_raw", "reference_id")


def merge_inputs(inputs: list[DataFrame], key: str = "event_id") -> DataFrame:
    """One row for each key: of reviewed rows, else of all, the one of the last input."""
    rows = None
    for place, df in enumerate(inputs):
        ranked = df.withColumn("__place", F.lit(place))
        rows = ranked if rows is None else rows.unionByName(ranked)
    rest = [c for c in inputs[0].columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(F.coalesce("reviewed", F.lit(False)), "__place")).alias("r"))
    return best.select(key, *(F.col(f"r.{c}").alias(c) for c in rest)).select(*inputs[0].columns)


def template_of():
    return F.coalesce(F.nullif(F.col("template"), F.lit("")), template_signature(F.col("text"), F.col("sender")))


def template_splits(examples: DataFrame, salt: str, val_share: float = 0.1, gold_share: float = 0.15) -> DataFrame:
    """template and split (null: not used). Templates of a held-out bank are gold if all their rows are reviewed, else unused; others go by a salted hash, to gold only if reviewed."""
    held = F.coalesce(F.upper(F.element_at(F.split(F.coalesce("sender", F.lit("")), "-"), -1)).isin(HELD_OUT_SENDERS), F.lit(False))
    groups = examples.withColumn("template", template_of()).groupBy("template").agg(F.bool_and(F.coalesce("reviewed", F.lit(False))).alias("reviewed"), F.bool_or(held).alias("held"))
    share = hash_fraction(F.concat(F.lit(f"{salt}:"), F.col("template")))
    split = F.when(F.col("held"), F.when(F.col("reviewed"), "gold_test")).when(F.col("reviewed") & (share < gold_share), "gold_test").when(share < gold_share + val_share, "val").otherwise("train")
    return groups.select("template", split.alias("split"))


def shingles(text):
    """Distinct runs of four lower-cased words (all words, if fewer), digits as 0."""
    words = F.filter(F.split(F.lower(F.regexp_replace(text, r"\d+", "0")), r"\s+"), lambda w: w != "")

    def runs(words):
        return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - SHINGLE + 1)), lambda i: F.array_join(F.slice(words, i, SHINGLE), " "))

    return F.array_distinct(once(words, runs))


def signatures(rows: DataFrame, key: str) -> DataFrame:
    """key and signature: for each of 64 seeds the least hash of the text's shingles. A row's shingles never leave its task before they are down to one row."""
    each = rows.select(key, F.explode(shingles(F.coalesce("text", F.lit("")))).alias("s")).select(key, F.xxhash64("s").alias("h"))
    least = each.groupBy(key).agg(*(F.min(F.xxhash64(F.lit(k), "h")).alias(f"m{k}") for k in range(PERMUTATIONS)))
    return least.select(key, F.array(*(f"m{k}" for k in range(PERMUTATIONS))).alias("signature"))


def bands(signed: DataFrame, key: str) -> DataFrame:
    keys = [F.xxhash64(F.lit(i), *(F.col("signature")[i * BAND_ROWS + j] for j in range(BAND_ROWS))) for i in range(PERMUTATIONS // BAND_ROWS)]
    return signed.select(key, "signature", F.explode(F.array(*keys)).alias("band"))


def near_protected(candidates: DataFrame, protected: DataFrame, key: str = "event_id") -> DataFrame:
    """Keys of candidates that are near-duplicates of a protected row: a band in common, and 0.8 of their signatures.

    Equal signatures meet once: protected rows are held by distinct signature, candidates likewise.
    """
    ours, theirs = cut(signatures(candidates, key)), signatures(protected, key).select("signature").distinct()
    own = bands(ours.select("signature").distinct().withColumn("k", F.lit(0)), "k").drop("k")
    other = bands(theirs.withColumn("k", F.lit(0)), "k").select("band", F.col("signature").alias("other")).distinct()
    same = F.size(F.filter(F.zip_with("signature", "other", lambda a, b: a == b), lambda x: x))
    near = own.join(other, "band").where(same >= NEAR * PERMUTATIONS).select("signature").distinct()
    return ours.join(near, "signature", "left_semi").select(key)


def make_splits(examples: DataFrame, salt: str, key: str = "event_id") -> DataFrame:
    """examples with template and split; what is near gold leaves val, and what is near gold or val leaves train."""
    rows = examples.withColumn("template", template_of()).join(template_splits(examples, salt).where("split IS NOT NULL"), "template")
    part = lambda name: rows.where(F.col("split") == name)
    val = part("val").join(near_protected(part("val"), part("gold_test"), key), key, "left_anti")
    train = part("train").join(near_protected(part("train"), part("gold_test").unionByName(val), key), key, "left_anti")
    return part("gold_test").unionByName(val).unionByName(train)


def leaking(split_rows: DataFrame) -> DataFrame:
    """Templates in more than one split."""
    return split_rows.groupBy("template").agg(F.countDistinct("split").alias("splits")).where("splits > 1")


def judged(pairs: DataFrame) -> DataFrame:
    """pairs (sender, expected, predicted structs) with outcome (tp, fp, fn, tn), whether each field is right, and correct."""
    e, p = F.col("expected"), F.col("predicted")
    got, wanted = F.coalesce(p["is_transaction"], F.lit(False)), F.coalesce(e["is_transaction"], F.lit(False))
    outcome = F.when(wanted & got, "tp").when(wanted, "fn").when(got, "fp").otherwise("tn")
    plain = lambda c: F.lower(F.trim(c))
    right = {f: (rupees_to_paise(e[f]).eqNullSafe(rupees_to_paise(p[f])) if f == "amount" else plain(e[f]).eqNullSafe(plain(p[f]))) for f in FIELDS}
    rows = pairs.withColumn("outcome", outcome).withColumns({f"{f}_right": (F.col("outcome") == "tp") & r for f, r in right.items()})
    every = F.lit(True)
    for f in FIELDS:
        every = every & F.col(f"{f}_right")
    return rows.withColumn("correct", (F.col("outcome") == "tn") | every)


def metrics(pairs: DataFrame, by: str | None = None) -> DataFrame:
    """n, precision, recall, f1, exact match of each field over true positives, and of all fields over all rows; for each value of `by`."""
    count = lambda o: F.count_if(F.col("outcome") == o).cast("double")
    tp, fp, fn = count("tp"), count("fp"), count("fn")
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 4)
    rows = judged(pairs)
    grouped = rows.groupBy(F.coalesce(F.col(by), F.lit("unknown")).alias(by)) if by else rows.groupBy()
    return grouped.agg(
        F.count(F.lit(1)).alias("n"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        *(ratio(F.count_if(F.col(f"{f}_right")), F.greatest(F.lit(1.0), tp)).alias(f"{f}_match") for f in FIELDS), ratio(F.count_if(F.col("correct")), F.count(F.lit(1))).alias("all_match"),
    )


def gate(by_variant: DataFrame, candidate: str, teacher: str) -> DataFrame:
    """One row, from metrics by variant: passed, if the candidate's all_match is at most 0.03 below the teacher's and its amount_match is 0.99 or more."""
    of = lambda name, c: F.max(F.when(F.col("variant") == name, F.col(c)))
    row = by_variant.agg(of(candidate, "all_match").alias("all_match"), of(candidate, "amount_match").alias("amount_match"), of(teacher, "all_match").alias("teacher_match"))
    return row.withColumn("passed", F.coalesce((F.col("all_match") >= F.col("teacher_match") - 0.03) & (F.col("amount_match") >= 0.99), F.lit(False)))


def card(split_rows: DataFrame) -> DataFrame:
    """Rows of each source, bank and status in each split."""
    bank = F.upper(F.element_at(F.split(F.coalesce("sender", F.lit("")), "-"), -1))
    counted = split_rows.groupBy("source", bank.alias("bank"), "status").pivot("split", list(SPLITS)).count()
    return counted.na.fill(0, list(SPLITS))


def version_of(split_rows: DataFrame, key: str = "event_id") -> DataFrame:
    """One row: a hash of all (key, split) that no order of rows changes. Sums of 64-bit hashes in two halves, so nothing is collected."""
    h = F.xxhash64(F.col(key), F.col("split"))
    parts = split_rows.agg(F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"), F.sum(F.shiftrightunsigned(h, 32)).alias("high"), F.count(F.lit(1)).alias("n"))
    return parts.select(F.substring(F.sha2(F.concat_ws(":", "low", "high", "n"), 256), 1, 12).alias("version"), "n")


def review_queue(distilled: DataFrame, share: float = 0.1) -> DataFrame:
    """Rows to look at: the two labels disagree, one is missing, or the id is in the sample."""
    from spendlake.functions.ids import in_sample

    a, b = F.col("first_label"), F.col("second_label")
    reason = F.when(a.isNull() | b.isNull(), "FAILED").when(a != b, "DISAGREE").when(in_sample(F.col("event_id"), share), "SAMPLE")
    return distilled.withColumn("reason", reason).where("reason IS NOT NULL")


def unreviewed(queue: DataFrame, reviewed: DataFrame, key: str = "event_id") -> DataFrame:
    return queue.join(reviewed.select(key).distinct(), key, "left_anti")


def nearest_rank(rows: DataFrame, value: str, q: float, by: list[str]) -> DataFrame:
    """by and the value at place round(q * (n - 1)), half to even, of the ordered values."""
    order = Window.partitionBy(*by).orderBy(value)
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    ranked = rows.where(F.col(value).isNotNull()).withColumn("place", F.row_number().over(order) - 1).withColumn("wanted", F.least(n - 1, F.bround(F.lit(q) * (n - 1), 0).cast("long")))
    return ranked.where("place = wanted").select(*by, F.col(value).alias(f"{value}_q"))
