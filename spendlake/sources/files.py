"""Reading and writing labelled examples, seeds and topics."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Schemas of labelled examples and of topic messages, and the topics.
EXAMPLE = "eventId string, sender string, sourceApp string, text string, source string, reviewed boolean, template string, label struct<isTransaction: boolean, amount: string, direction: string, channel: string, status: string, merchantRaw: string, counterpartyVpa: string, referenceId: string, accountHint: string, balanceAfter: string, promisedRefundDays: int>"
ENVELOPE = "eventId string, userId string, type string, schemaVersion int, occurredAt timestamp, producedAt timestamp, producer string, causationId string, payload string"
RAW_PAYLOAD = "sourceApp string, sender string, title string, text string, postedAt timestamp, deviceParse struct<modelVersion: string, result: struct<amountPaise: bigint, direction: string, channel: string, status: string, merchantRaw: string, referenceId: string>, latencyMs: int>"

#: name -> (partitions, days kept); each has a twin for dead letters, kept 30 days.
TOPICS = {"raw-events": (12, 7), "parsed-transactions": (12, 7), "clean-transactions": (12, 7), "cash-events": (12, 7), "agent-tasks": (12, 3), "agent-results": (12, 7), "user-feedback": (12, 30), "nudge-outcomes": (12, 30), "model-shadow": (12, 7)}
DEAD_LETTER, DEAD_LETTER_DAYS = ".DLT", 30


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """Labelled examples of JSON lines; a line that doesn't fit the schema raises."""
    return spark.read.schema(EXAMPLE).option("mode", "FAILFAST").json(path)


def write_examples(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rows.write.mode(mode).option("ignoreNullFields", "false").json(path)


def read_merchants(spark: SparkSession, path: str) -> DataFrame:
    """id, name, category and aliases of seed lines `id: [Name, CATEGORY, [alias, alias]]`; other lines are comments."""
    pattern = r"^\s*([\w-]+)\s*:\s*\[\s*(.+?)\s*,\s*([A-Z_]+)\s*(?:,\s*\[(.*?)\])?\s*\]\s*$"
    lines = spark.read.text(path).where(F.col("value").rlike(pattern))
    part = lambda i: F.regexp_replace(F.regexp_extract("value", pattern, i), r"^[\"']|[\"']$", "")
    aliases = F.filter(F.transform(F.split(F.regexp_extract("value", pattern, 4), ","), lambda a: F.regexp_replace(F.trim(a), r"^[\"']|[\"']$", "")), lambda a: a != "")
    return lines.select(part(1).alias("id"), part(2).alias("name"), part(3).alias("category"), aliases.alias("aliases"))


RULE = "id string, sender string, regex string, direction string, channel string, status string"
MOST_RULES = 10_000


def read_rules(spark: SparkSession, path: str) -> list[dict]:
    """Rules of JSON lines for parsing.rule_table; an unsafe rule, a line that doesn't fit, or more than MOST_RULES raise."""
    from spendlake.operators.parsing import fault

    rows = spark.read.schema(RULE).option("mode", "FAILFAST").json(path).limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"{path} has more than {MOST_RULES} rules")
    rules = [r.asDict() | {"channel": r.channel or "UNKNOWN", "status": r.status or "SUCCESS"} for r in rows]
    for r in rules:
        if reason := fault(r["regex"], r["direction"], r["channel"], r["status"]):
            raise ValueError(f"rule {r['id']}: {reason}")
    return rules


def exported_schemas() -> dict[str, str]:
    """The schemas of wire formats by name, as Spark's JSON."""
    from pyspark.sql.types import StructType

    return {name: StructType.fromDDL(ddl).json() for name, ddl in (("labeled-example", EXAMPLE), ("envelope", ENVELOPE), ("raw-event-payload", RAW_PAYLOAD), ("rule", RULE))}


def from_envelopes(messages: DataFrame) -> DataFrame:
    """Raw events of topic messages (key, value): the envelope's fields beside its payload's; what can't be read has `fault` set."""
    e = messages.select(F.col("value").cast("string").alias("value")).withColumn("e", F.from_json("value", ENVELOPE)).withColumn("p", F.from_json("e.payload", RAW_PAYLOAD))
    fault = F.when(F.col("e.eventId").isNull() | F.col("e.userId").isNull(), "BAD_ENVELOPE").when(F.col("p.postedAt").isNull(), "BAD_PAYLOAD")
    return e.select(
        F.col("e.eventId").alias("event_id"), F.col("e.userId").alias("user_id"), F.col("e.type").alias("raw_type"), F.col("p.sourceApp").alias("source_app"), F.col("p.sender").alias("sender"),
        F.col("p.title").alias("title"), F.col("p.text").alias("text"), F.col("p.deviceParse").alias("device_parse"), F.col("p.postedAt").alias("posted_at"), F.col("e.producedAt").alias("received_at"), "value", fault.alias("fault"),
    )


def to_envelopes(rows: DataFrame, kind: str, producer: str, payload: list[str]) -> DataFrame:
    """key and value of topic messages for rows (event_id, user_id, occurred_at and the payload's columns); one key for a user keeps a user's order."""
    body = F.struct(
        F.col("event_id").alias("eventId"), F.col("user_id").cast("string").alias("userId"), F.lit(kind).alias("type"), F.lit(1).alias("schemaVersion"), F.col("occurred_at").alias("occurredAt"),
        F.current_timestamp().alias("producedAt"), F.lit(producer).alias("producer"), F.lit(None).cast("string").alias("causationId"), F.to_json(F.struct(*payload), {"ignoreNullFields": "false"}).alias("payload"),
    )
    return rows.select(F.col("user_id").cast("string").alias("key"), F.to_json(body, {"ignoreNullFields": "false"}).alias("value"))


def topic_stream(spark: SparkSession, servers: str, topic: str, per_trigger: int = 100_000) -> DataFrame:
    """A topic as a stream of (key, value) from its start; needs the Kafka package of Spark on the cluster."""
    if topic.removesuffix(DEAD_LETTER) not in TOPICS:
        raise ValueError(f"unknown topic {topic}")
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest", "maxOffsetsPerTrigger": str(per_trigger)}
    return spark.readStream.format("kafka").options(**options).load().select("key", "value")
