"""Reports of one payment merged into one payment, and the special kinds of payments.

Whether two reports are one payment depends on the user, the amount, the direction and the time between them
alone, so reports are dealt by user, amount and stretch of time (islands) and pass through their task one by one,
in order of arrival: a pass keeps what it must remember of a stretch's payments, never rows, and finds those
near a report in time by bisection. What depends on a user's other amounts (a credit that reverses or
refunds an earlier debit) is found by windows between two passes.
"""

from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spendlake.functions.ids import derived_hex
from spendlake.functions.text import merchant_key, payee_similarity
from spendlake.sources.scratch import cut

WINDOW = 15 * 60
WINDOW_WITH_REFERENCE = 48 * 3600
CLOSE = 3 * 60
SELF_TRANSFER = 10 * 60
REFUND_DAYS = 90
#: Scores in tenths: a sure match, and one that needs reports of different kinds.
SURE, MAYBE = 8, 6
ALIKE = 0.4


def base_kind(status, channel, direction):
    return F.when(status == "REVERSED", "REVERSAL").when((channel == "ATM") & (direction == "DEBIT"), "ATM_WITHDRAWAL").when(direction == "CREDIT", F.when(status == "REFUND_INITIATED", "REFUND").otherwise("INCOME")).otherwise("SPEND")


def alike(a, b):
    """Likeness of two payees: 1 for the same string, else by their keys' trigrams; 0 where one is missing."""
    plain = lambda c: F.lower(F.trim(c))
    return F.when(F.coalesce(a, F.lit("")).isin("") | F.coalesce(b, F.lit("")).isin(""), 0.0).when(plain(a) == plain(b), 1.0).otherwise(payee_similarity(merchant_key(a), merchant_key(b)))


def seconds_apart(a, b):
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return F.abs(micros(a) - micros(b)) / 1_000_000


def score(a: str, b: str):
    """Match score in tenths (4 to 10) of two reports (column prefixes) of one user, amount and direction."""
    x = lambda c: F.col(f"{a}{c}")
    y = lambda c: F.col(f"{b}{c}")
    account = (x("account_hint") != "") & (x("account_hint") == y("account_hint"))
    return 4 + 3 * (seconds_apart(x("txn_time"), y("txn_time")) <= CLOSE).cast("int") + 2 * (alike(x("merchant_raw"), y("merchant_raw")) >= ALIKE).cast("int") + F.coalesce(account, F.lit(False)).cast("int")


def candidate_pairs(reports: DataFrame) -> DataFrame:
    """Pairs of reports (id, other) of one user, amount and direction, `other` stored before, within 15 minutes (48 hours if `id` has a reference), with seconds apart and score.

    Time is dealt into bins as long as the window, so that a report meets its own bin and the two beside it:
    an equi-join, whatever share of reports one user and amount have.
    """
    columns = ["id", "user_id", "amount_paise", "direction", "txn_time", "merchant_raw", "account_hint", "reference_id", "seq"]

    def meet(new: DataFrame, window: int) -> DataFrame:
        at = F.floor(F.unix_micros(F.col("txn_time").cast("timestamp")) / (window * 1_000_000))
        left = new.select(*(F.col(c).alias(f"n_{c}") for c in columns), F.explode(F.array(at - 1, at, at + 1)).alias("bin"))
        right = reports.select(*(F.col(c).alias(f"o_{c}") for c in columns), at.alias("bin"))
        same = (left["bin"] == right["bin"]) & (F.col("n_user_id") == F.col("o_user_id")) & (F.col("n_amount_paise") == F.col("o_amount_paise")) & (F.col("n_direction") == F.col("o_direction"))
        return left.join(right, same & (F.col("o_seq") < F.col("n_seq")) & (seconds_apart(F.col("n_txn_time"), F.col("o_txn_time")) <= window))

    referenced = F.coalesce(F.col("reference_id"), F.lit("")) != ""
    pairs = meet(reports.where(referenced), WINDOW_WITH_REFERENCE).union(meet(reports.where(~referenced), WINDOW))
    return pairs.select(F.col("n_id").alias("id"), F.col("o_id").alias("other"), seconds_apart(F.col("n_txn_time"), F.col("o_txn_time")).alias("apart"), score("n_", "o_").alias("score"))


#: What the first pass gives of each report.
FIELDS = ["seq", "event_id", "user_id", "amount_paise", "direction", "txn_time", "micros", "payment", "version", "is_new", "merchant_raw", "merchant_id", "category", "reference_id", "account_hint", "balance_after_paise", "status", "channel", "parse_method"]
#: Rows that a pass hands on at once.
ROWS = 5_000


def trigrams(key: str) -> frozenset:
    padded = f"  {key} "
    return frozenset(padded[i : i + 3] for i in range(len(padded) - 2))


class Payment:
    """What the first pass remembers of a payment."""

    __slots__ = ("payment", "version", "micros", "plain", "grams", "sources", "row")

    def __init__(self, r):
        self.payment, self.version, self.micros, self.row = r["seq"], 1, r["micros"], r
        self.plain, self.grams = r["plain"], trigrams(r["key"]) if r["key"] else None
        self.sources = {(r["raw_type"], r["source_app"])}

    def apart(self, r) -> float:
        return abs(self.micros - r["micros"]) / 1_000_000

    def tenths(self, r) -> int:
        out = 4 + 3 * (self.apart(r) <= CLOSE)
        if self.plain and r["plain"]:
            if self.plain == r["plain"]:
                out += 2
            elif self.grams and r["key"]:
                g = trigrams(r["key"])
                out += 2 * (len(g & self.grams) >= ALIKE * len(g | self.grams))
        return out + bool(r["account_hint"] and r["account_hint"] == self.row["account_hint"])

    def takes(self, r) -> bool:
        if r["reference_id"] and r["reference_id"] == self.row["reference_id"]:
            return True
        if r["raw_type"] == "RAW_NOTIFICATION" and (r["raw_type"], r["source_app"]) in self.sources:
            return False
        s = self.tenths(r)
        return s >= SURE or (s >= MAYBE and any(kind != r["raw_type"] for kind, _ in self.sources))

    def add(self, r) -> None:
        """Fills what is missing; a final status replaces PENDING; a merchant brings its category."""
        own = self.row
        for c in ("reference_id", "account_hint", "balance_after_paise"):
            if own[c] is None:
                own[c] = r[c]
        if own["merchant_raw"] is None and r["merchant_raw"] is not None:
            own["merchant_raw"], self.plain, self.grams = r["merchant_raw"], r["plain"], trigrams(r["key"]) if r["key"] else None
        if own["merchant_id"] is None and r["merchant_id"] is not None:
            own["merchant_id"], own["category"] = r["merchant_id"], r["category"]
        if own["status"] == "PENDING":
            own["status"] = r["status"]
        self.sources.add((r["raw_type"], r["source_app"]))
        self.version += 1


def islands(rows: DataFrame) -> DataFrame:
    """rows (user_id, amount_paise, micros) with `island`: stretches of time between which nothing is looked up.

    Time is dealt into bins as long as the longest window; where a bin of a user and amount is empty, what lies
    before it and after it is further apart than that. Bins are made distinct before they are numbered.
    """
    at = F.floor(F.col("micros") / (WINDOW_WITH_REFERENCE * 1_000_000))
    key = ["user_id", "amount_paise"]
    bins = rows.select(*key, at.alias("bin")).distinct()
    order = Window.partitionBy(*key).orderBy("bin")
    new = F.coalesce((F.col("bin") - F.lag("bin").over(order) > 1).cast("int"), F.lit(1))
    numbered = bins.withColumn("new", new).withColumn("island", F.sum("new").over(order)).drop("new")
    return rows.withColumn("bin", at).join(numbered, [*key, "bin"]).drop("bin")


class Near:
    """Values by time; those within a window of a moment."""

    def __init__(self):
        self.times: list[int] = []
        self.values: list = []

    def add(self, micros: int, value) -> None:
        at = bisect_right(self.times, micros)
        self.times.insert(at, micros)
        self.values.insert(at, value)

    def within(self, micros: int, seconds: int) -> list:
        reach = seconds * 1_000_000
        return self.values[bisect_left(self.times, micros - reach) : bisect_right(self.times, micros + reach)]


def in_order(df: DataFrame, names: list[str], schema: T.StructType, memory_of, step) -> DataFrame:
    """Rows of `names` that step(memory, row) returns for each row of df (with `island`), in order of arrival within each user, amount and island; memory_of() makes an island's memory.

    txn_time goes through the pass as a text (without zone) or as microseconds, so that no objects of Python are made of it.
    """
    key = ["user_id", "amount_paise", "island"]
    kind = schema["txn_time"].dataType
    plain = kind == T.TimestampNTZType()
    sent = F.col("txn_time").cast("string") if plain else F.unix_micros("txn_time")
    back = F.col("txn_time").cast(kind) if plain else F.timestamp_micros("txn_time")
    dealt = df.withColumn("txn_time", sent).repartition(*key).sortWithinPartitions(*key, "seq")
    schema = T.StructType([T.StructField("txn_time", T.StringType() if plain else T.LongType()) if f.name == "txn_time" else f for f in schema])
    arrow = to_arrow_schema(schema)

    def run(batches):
        group, memory = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                out = []
                for r in batch.slice(at, ROWS).to_pylist():
                    own = tuple(r[c] for c in key)
                    if own != group:
                        group, memory = own, memory_of()
                    out += [{c: x[c] for c in names} for x in step(memory, r)]
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return dealt.mapInArrow(run, schema).withColumn("txn_time", back)


def merged(reports: DataFrame) -> DataFrame:
    """For each report: the payment it belongs to (seq of its first report), that payment's version, its fields from then on, and the report's island.

    reports: seq (order of arrival), event_id, user_id, raw_type, source_app, amount_paise, direction, status,
    channel, txn_time, merchant_raw, merchant_id, category, reference_id, account_hint, balance_after_paise,
    parse_method. A report of an event that has come before changes nothing and is left out.
    """
    firsts = reports.groupBy("user_id", "event_id").agg(F.min("seq").alias("seq"))
    own = reports.join(firsts, ["user_id", "event_id", "seq"], "left_semi")
    rows = own.withColumn("micros", F.unix_micros(F.col("txn_time").cast("timestamp"))).withColumn("plain", F.lower(F.trim("merchant_raw"))).withColumn("key", merchant_key(F.col("merchant_raw")))
    kinds = {"payment": T.LongType(), "version": T.IntegerType(), "is_new": T.BooleanType()}
    rows = islands(rows)
    names = [*FIELDS, "island"]
    schema = T.StructType([T.StructField(c, kinds.get(c) or rows.schema[c].dataType) for c in names])

    def step(known: dict[str, Near], r: dict) -> list[dict]:
        stored = known.setdefault(r["direction"], Near())
        window = WINDOW_WITH_REFERENCE if r["reference_id"] else WINDOW
        near = sorted((p.apart(r), p.payment, p) for p in stored.within(r["micros"], window))
        own = next((p for _, _, p in near if p.takes(r)), None)
        if own:
            own.add(r)
        else:
            own = Payment(dict(r))
            stored.add(own.micros, own)
        return [r | {c: own.row[c] for c in FIELDS[10:]} | {"payment": own.payment, "version": own.version, "is_new": own.version == 1}]

    return in_order(rows, names, schema, dict, step)


def special_credits(steps: DataFrame) -> DataFrame:
    """seq and kind of new credits that reverse an earlier debit (same reference) or refund one (same merchant, up to 90 days before).

    Earlier means stored before: a debit's reference or merchant counts from the report that brought it.
    """
    debits = steps.where("direction = 'DEBIT'")
    new = steps.where("direction = 'CREDIT' AND is_new")
    known = debits.where("reference_id <> ''").groupBy("user_id", "reference_id").agg(F.min("seq").alias("since"))
    reversals = new.join(known, ["user_id", "reference_id"]).where("since < seq").select("seq", F.lit("REVERSAL").alias("kind"))
    sides = lambda df, since: df.where("merchant_id IS NOT NULL").select("user_id", "merchant_id", "txn_time", "seq", since.alias("since"))
    rows = sides(debits, F.col("seq")).union(sides(new, F.lit(None).cast("long")))
    frame_ = Window.partitionBy("user_id", "merchant_id").orderBy(F.unix_micros(F.col("txn_time").cast("timestamp"))).rangeBetween(-REFUND_DAYS * 86_400_000_000, Window.currentRow)
    refunds = rows.withColumn("paid", F.min("since").over(frame_)).where("since IS NULL AND paid < seq").select("seq", F.lit("REFUND").alias("kind"))
    return reversals.union(refunds).groupBy("seq").agg(F.max("kind").alias("special"))  # REVERSAL before REFUND


def payments(reports: DataFrame) -> DataFrame:
    """The changelog of payments: id, version, kind, category and fields after each report that made or changed one.

    A new credit is a reversal or refund by special_credits; a new payment and a stored one of the same amount,
    other direction and other account within ten minutes are a transfer to oneself, which changes both. The
    latest version of each id is the payment.
    """
    steps = cut(merged(reports))
    rows = steps.join(special_credits(steps), "seq", "left").withColumn("kind", F.coalesce("special", base_kind(F.col("status"), F.col("channel"), F.col("direction")))).drop("special")

    def step(memory: tuple[dict, Near], r: dict) -> list[dict]:
        stored, by_time = memory
        if not r["is_new"]:
            own = stored[r["payment"]]
            kept = {"kind": own["kind"], "bumps": own["bumps"], "category": own["category"] if own["kind"] == "SELF_TRANSFER" else r["category"], "txn_time": own["txn_time"], "micros": own["micros"]}
            own.update(r)
            own.update(kept, version=r["version"] + own["bumps"])
            return [dict(own)]
        own, partner = r | {"bumps": 0}, None
        if r["account_hint"] and r["kind"] in ("SPEND", "INCOME"):
            near = [p for p in by_time.within(r["micros"], SELF_TRANSFER) if own_transfer(p, r)]
            partner = min(near, key=lambda p: p["payment"], default=None)
        stored[r["payment"]] = own
        by_time.add(own["micros"], own)
        if not partner:
            return [dict(own)]
        for p in (own, partner):
            p["kind"], p["category"] = "SELF_TRANSFER", "TRANSFERS"
        partner["bumps"] += 1
        partner["version"] += 1
        return [dict(own), dict(partner)]

    return in_order(rows, rows.columns, rows.schema, lambda: ({}, Near()), step).drop("micros", "island")


def own_transfer(p: dict, r: dict) -> bool:
    """Whether a stored payment may be the other end of a transfer to oneself."""
    near = abs(p["micros"] - r["micros"]) <= SELF_TRANSFER * 1_000_000
    return near and p["direction"] != r["direction"] and p["kind"] in ("SPEND", "INCOME") and p["account_hint"] not in (None, r["account_hint"])


def latest(changelog: DataFrame) -> DataFrame:
    """The last version of each payment."""
    rest = [c for c in changelog.columns if c != "payment"]
    return changelog.groupBy("payment").agg(F.max_by(F.struct(*rest), "version").alias("r")).select("payment", "r.*")


def payment_id(event_id):
    """Id of the payment that an event's report begins."""
    return derived_hex("t_", F.lit("txn"), event_id)


def atm_cash(changelog: DataFrame) -> DataFrame:
    """A cash entry for each successful withdrawal at a machine."""
    rows = latest(changelog).where("kind = 'ATM_WITHDRAWAL' AND status = 'SUCCESS'")
    return rows.select(F.concat(F.lit("at_"), "payment").alias("id"), "user_id", F.lit("ATM_WITHDRAWAL").alias("entry_type"), "amount_paise", F.col("txn_time").alias("occurred_at"))
