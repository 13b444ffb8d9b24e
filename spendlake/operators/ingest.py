"""Uploads, idempotent writes, corrections and deletions as table operations."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlake.functions.ids import short_hash
from spendlake.functions.text import merchant_key

MAX_TEXT = 2_000
KEPT_DAYS, AHEAD_MINUTES = 400, 5


def rejection(now):
    """The first upload rule that an event (redacted, text, posted_at, replay) breaks; null if none."""
    return (
        F.when(~F.coalesce("redacted", F.lit(False)), "NOT_REDACTED")
        .when(F.length("text") > MAX_TEXT, "TEXT_TOO_LONG")
        .when(F.col("posted_at") < now - F.expr(f"INTERVAL {KEPT_DAYS} DAYS"), "TOO_OLD")
        .when(F.col("posted_at") > now + F.expr(f"INTERVAL {AHEAD_MINUTES} MINUTES"), "IN_FUTURE")
        .when(F.coalesce("replay", F.lit(False)), "REPLAY")
    )


def classify(uploads: DataFrame, stored: DataFrame, now) -> DataFrame:
    """uploads (event_id, user_id, …, seq) with status ACCEPTED, DUPLICATE or REJECTED and reason.

    An id stored for the same user, or that came before in the uploads, is a duplicate; one that another user
    owns is rejected. Rules on content come first. stored: event_id, user_id.
    """
    owners = stored.select("event_id", F.col("user_id").alias("stored_owner")).dropDuplicates(["event_id"])
    checked = uploads.withColumn("rule", rejection(now))
    firsts = checked.where("rule IS NULL").groupBy("event_id").agg(F.min_by(F.struct(F.col("user_id").alias("u"), F.col("seq").alias("s")), "seq").alias("first"))
    rows = checked.join(owners, "event_id", "left").join(firsts, "event_id", "left")
    owner = F.coalesce("stored_owner", "first.u")
    again = F.col("stored_owner").isNotNull() | (F.col("seq") > F.col("first.s"))
    status = F.when(F.col("rule").isNotNull(), "REJECTED").when(owner != F.col("user_id"), "REJECTED").when(again, "DUPLICATE").otherwise("ACCEPTED")
    reason = F.coalesce("rule", F.when(owner != F.col("user_id"), "OTHER_OWNER"))
    return rows.select(*uploads.columns, status.alias("status"), reason.alias("reason"))


def insert_new(stored: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """stored and the rows whose key it lacks, the first of each key."""
    return stored.unionByName(rows.dropDuplicates(key).join(stored.select(*key).distinct(), key, "left_anti").select(*stored.columns))


def upsert(stored: DataFrame, rows: DataFrame, key: list[str], version: str) -> DataFrame:
    """For each key the row of the largest version, of stored and rows; of equal versions the one of rows."""
    rest = [c for c in stored.columns if c not in key]
    both = stored.withColumn("__new", F.lit(0)).unionByName(rows.select(*stored.columns).withColumn("__new", F.lit(1)))
    best = both.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(version, "__new")).alias("r"))
    return best.select(*key, *(F.col(f"r.{c}").alias(c) for c in rest)).select(*stored.columns)


def correct(payments: DataFrame, corrections: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """payments with users' corrections (id, user_id, category, merchant_name) applied: version up by one, corrected set.

    A corrected name stands for the merchant whose alias (alias, merchant_id) has its key, else for a merchant of its
    own, whose id follows from the name.
    """
    named = corrections.select("id", "user_id", F.col("category").alias("__category"), F.col("merchant_name").alias("__name"), F.lit(True).alias("__own"))
    own_id = F.when(F.trim("__name") != "", short_hash("um_", F.lower(F.trim("__name"))))
    if aliases is None:
        named = named.withColumn("__merchant", own_id)
    else:
        known = aliases.select(F.col("alias").alias("__alias"), F.col("merchant_id").cast("string").alias("__known")).where("__alias <> ''").groupBy("__alias").agg(F.min("__known").alias("__known"))
        named = named.withColumn("__alias", merchant_key(F.col("__name"))).join(known, "__alias", "left").withColumn("__merchant", F.coalesce("__known", own_id))
    rows = payments.join(named.select("id", "user_id", "__category", "__merchant", "__own"), ["id", "user_id"], "left")
    own = F.coalesce("__own", F.lit(False))
    return rows.select(
        *(c for c in payments.columns if c not in ("category", "merchant_id", "version", "user_corrected")),
        F.coalesce("__category", "category").alias("category"), F.coalesce("__merchant", F.col("merchant_id").cast("string")).alias("merchant_id"),
        (F.col("version") + own.cast("int")).alias("version"), (own | F.coalesce("user_corrected", F.lit(False))).alias("user_corrected"),
    )


def overrides_from(payments: DataFrame, corrections: DataFrame) -> DataFrame:
    """What corrections teach: user_id, alias, category, merchant_name for the corrected payment's payee."""
    rows = corrections.join(payments.select("id", "user_id", "merchant_raw"), ["id", "user_id"]).withColumn("alias", merchant_key(F.col("merchant_raw"))).where("alias <> ''")
    return rows.groupBy("user_id", "alias").agg(F.max_by(F.struct("category", "merchant_name"), "id").alias("c")).select("user_id", "alias", "c.*")


def delete_users(tables: dict[str, DataFrame], users: DataFrame, links: dict[str, tuple[str, str, str]] | None = None) -> dict[str, DataFrame]:
    """tables without the rows of users (user_id). links: child table to (its column, parent table, the parent's column), for tables without user_id."""
    gone = users.select("user_id").distinct()
    out = {}
    for name, df in tables.items():
        if links and name in links:
            column, parent, parent_column = links[name]
            ids = tables[parent].join(gone, "user_id", "left_semi").select(F.col(parent_column).alias(column)).distinct()
            out[name] = df.join(ids, column, "left_anti")
        else:
            out[name] = df.join(gone, "user_id", "left_anti")
    return out


def undo_cash(ledger: DataFrame, undone: DataFrame) -> DataFrame:
    """ledger without the undone entries (id), by their own id or the one derived from it."""
    ids = undone.select(F.explode(F.array("id", F.concat(F.lit("c_"), "id"))).alias("id")).distinct()
    return ledger.join(ids, "id", "left_anti")


def promote(registry: DataFrame, model_id: str) -> DataFrame:
    """registry (id, kind, status, gate_passed) with a model made active, if its gate is passed; the kind's active one retires."""
    from pyspark.sql import Window

    is_it = F.col("id") == model_id
    good = F.max(F.when(is_it & F.coalesce("gate_passed", F.lit(False)), True)).over(Window.partitionBy("kind"))
    status = F.when(good & is_it, "ACTIVE").when(good & (F.col("status") == "ACTIVE"), "RETIRED").otherwise(F.col("status"))
    return registry.withColumn("status", status)


def register(registry: DataFrame, manifests: DataFrame, kind: str = "PARSER") -> DataFrame:
    """registry (id, kind, status, gate_passed, sha256) and a candidate for each manifest (version, quant, sha256) that it lacks; a model's id follows from kind, version and quantization."""
    model = F.concat_ws("-", F.lit(kind.lower()), "version", F.lower("quant"))
    rows = manifests.select(model.alias("id"), F.lit(kind).alias("kind"), F.lit("CANDIDATE").alias("status"), F.lit(False).alias("gate_passed"), "sha256")
    return insert_new(registry, rows.groupBy("id").agg(*(F.min(c).alias(c) for c in rows.columns if c != "id")), ["id"])


def labelling_export(users: DataFrame, events: DataFrame, sources: DataFrame, payments: DataFrame) -> DataFrame:
    """Events of users who agreed, with their text scrubbed and the first payment they led to, if any."""
    from spendlake.functions.text import scrub_digits

    first = sources.groupBy(F.col("raw_event_id").alias("event_id")).agg(F.min("transaction_id").alias("id"))
    known = payments.select("id", "user_id", "amount_paise", "direction", "status", "merchant_raw")
    agreed = events.join(users.where("consent").select("user_id"), "user_id", "left_semi")
    return agreed.select("event_id", "user_id", "sender", "source_app", scrub_digits(F.col("text")).alias("text")).join(first, "event_id", "left").join(known, ["id", "user_id"], "left").drop("id", "user_id")
