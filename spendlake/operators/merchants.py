"""From payee strings to merchants: a user's own choice, exact names, names alike."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlake.functions.text import is_person_vpa, merchant_key, word_trigrams

ALIKE = 0.6


def aliases_of(merchants: DataFrame) -> DataFrame:
    """alias, merchant_id, name, category of merchants (id, name, category, aliases array); of one alias given twice, the smallest id stands."""
    each = merchants.select("id", "name", "category", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("raw"))
    keyed = each.withColumn("alias", merchant_key(F.col("raw"))).where("alias <> ''")
    return keyed.groupBy("alias").agg(F.min(F.struct("id", "name", "category")).alias("m")).select("alias", F.col("m.id").alias("merchant_id"), "m.name", "m.category")


def alike(keys: DataFrame, aliases: DataFrame, least: float = ALIKE) -> DataFrame:
    """key and the alias most like it (merchant_id, name, category, similarity): an equi-join on trigrams, then their shared share.

    Only keys and aliases that share a trigram meet. Ties go to the alias first in the alphabet.
    """
    grams = lambda df, name: df.withColumn("grams", word_trigrams(F.col(name))).withColumn(f"n_{name}", F.size("grams")).withColumn("gram", F.explode("grams")).drop("grams")
    shared = grams(keys.select("key").distinct(), "key").join(grams(aliases, "alias"), "gram").groupBy("key", "alias", "n_key", "n_alias", "merchant_id", "name", "category").agg(F.count(F.lit(1)).alias("shared"))
    scored = shared.withColumn("similarity", F.col("shared") / (F.col("n_key") + F.col("n_alias") - F.col("shared"))).where(F.col("similarity") >= least)
    best = scored.groupBy("key").agg(F.min_by(F.struct("alias", "merchant_id", "name", "category", "similarity"), F.struct((-F.col("similarity")).alias("apart"), F.col("alias"))).alias("b"))
    return best.select("key", "b.*")


def resolve(rows: DataFrame, aliases: DataFrame, overrides: DataFrame) -> DataFrame:
    """rows (user_id, merchant_raw, …) with merchant_id, merchant_name, resolved_category and method.

    In this order: a user's own choice for the key, persons' addresses (TRANSFERS), the exact alias, the alias
    most alike, none (OTHER). Each distinct payee string is looked up once, whatever share of rows has it.
    overrides: user_id, alias, merchant_id, name, category.
    """
    raws = rows.select("merchant_raw").where(F.col("merchant_raw") != "").distinct().withColumn("key", merchant_key(F.col("merchant_raw")))
    exact = raws.join(aliases.withColumnRenamed("alias", "key"), "key", "left").withColumn("method", F.when(F.col("merchant_id").isNotNull(), "EXACT"))
    open_keys = exact.where((F.col("key") != "") & F.col("method").isNull() & ~is_person_vpa(F.col("merchant_raw"))).select("key")
    near = alike(open_keys, aliases).select("key", F.struct("merchant_id", "name", "category").alias("near"))
    general = exact.join(near, "key", "left")
    person = is_person_vpa(F.col("merchant_raw"))
    pick = lambda c, other: F.when(person, None).when(F.col("method") == "EXACT", F.col(c)).otherwise(F.coalesce(F.col(f"near.{c}"), other))
    none = F.lit(None).cast("string")
    found = general.select(
        "merchant_raw", "key", pick("merchant_id", none.cast(aliases.schema["merchant_id"].dataType)).alias("g_id"), pick("name", none).alias("g_name"),
        F.when(person, "TRANSFERS").otherwise(pick("category", F.lit("OTHER"))).alias("g_category"),
        F.when(person, "PERSON").when(F.col("method") == "EXACT", "EXACT").when(F.col("near").isNotNull(), "TRIGRAM").otherwise("NONE").alias("g_method"),
    )
    own = overrides.select("user_id", F.col("alias").alias("key"), F.struct("merchant_id", "name", "category").alias("own")).where("key <> ''")
    out = rows.join(found, "merchant_raw", "left").join(own, ["user_id", "key"], "left")
    chosen = F.col("own").isNotNull()
    return out.select(
        *rows.columns,
        F.when(chosen, F.col("own.merchant_id")).otherwise(F.col("g_id")).alias("merchant_id"), F.when(chosen, F.col("own.name")).otherwise(F.col("g_name")).alias("merchant_name"),
        F.when(chosen, F.col("own.category")).otherwise(F.coalesce("g_category", F.lit("OTHER"))).alias("resolved_category"), F.when(chosen, F.lit("USER")).otherwise(F.coalesce("g_method", F.lit("NONE"))).alias("method"),
    )
