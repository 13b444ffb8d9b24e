"""Extractors, teachers and embedders of any kind, plugged in.

A plug-in is a function without arguments that is called once in a worker and gives a function from a list of
texts to a list of answers, one for each, null where it has none. Texts are asked in batches of bounded size. A
batch that fails is asked once more; if it fails again its texts are asked one by one, so that one bad answer
costs one row its answer and no task its work.
"""

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from spendlake.functions.grounding import failure
from spendlake.operators import parsing, tiers

Ask = Callable[[list[str]], list]
PlugIn = Callable[[], Ask]
#: Texts that a plug-in is asked at once, and how often.
BATCH, TRIES = 64, 2


def tried(ask: Ask, texts: list[str], tries: int, fits: Callable[[list], pa.Array]) -> tuple[pa.Array | None, str | None]:
    """The answers as an Arrow array, or the reason of the last try."""
    reason = None
    for _ in range(tries):
        try:
            answers = ask(texts)
            if len(answers) != len(texts):
                raise ValueError("as many answers as texts are needed")
            return fits(list(answers)), None
        except Exception as e:  # a plug-in may fail in any way
            reason = type(e).__name__
    return None, reason


def asked(ask: Ask, texts: list[str], tries: int, fits: Callable[[list], pa.Array]) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """Answers and failures of a batch, in order."""
    answers, reason = tried(ask, texts, tries, fits)
    if answers is not None:
        yield answers, [None] * len(texts)
    elif len(texts) == 1:
        yield fits([None]), [reason]
    else:
        for text in texts:
            yield from asked(ask, [text], tries, fits)


def answered(rows: DataFrame, plugin: PlugIn, kind: T.DataType | str, text: str = "text", name: str = "answer", batch: int = BATCH, tries: int = TRIES) -> DataFrame:
    """rows with `name` (the plug-in's answer to the text, of type `kind`) and `name`_failure (why there is none).

    Null texts aren't asked. An answer that isn't of the type counts as a failure (the name of the error). Rows
    come out one for one.
    """
    kind = T._parse_datatype_string(kind) if isinstance(kind, str) else kind
    arrow = to_arrow_type(kind)

    def fits(values: list) -> pa.Array:
        return pa.array(values, arrow)

    def run(batches):
        ask = None
        for part in batches:
            texts = part.column(text).to_pylist()
            known = [i for i, t in enumerate(texts) if t is not None]
            ask = ask or (plugin() if known else None)
            found = [r for a in range(0, len(known), batch) for r in asked(ask, [texts[i] for i in known[a : a + batch]], tries, fits)]
            answers = pa.concat_arrays([fits([None]), *(f[0] for f in found)])
            reasons = [None, *(reason for f in found for reason in f[1])]
            place = dict(zip(known, range(1, len(known) + 1), strict=True))
            spots = pa.array([place.get(i, 0) for i in range(len(texts))], pa.int64())
            yield pa.RecordBatch.from_arrays([*part.columns, answers.take(spots), pa.array(reasons, pa.string()).take(spots)], names=[*part.schema.names, name, f"{name}_failure"])

    fields = [T.StructField(name, kind), T.StructField(f"{name}_failure", T.StringType())]
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *fields]))


PARSED = ["amount_paise", "direction", "channel", "status", "merchant_raw", "counterparty_vpa", "reference_id", "account_hint", "balance_after_paise", "promised_refund_days", "parse_method", "rule_id", "confidence"]


def parse(messages: DataFrame, rules: DataFrame, extractors: dict[str, PlugIn]) -> DataFrame:
    """`operators.parsing.parse`, with extractors (method to plug-in; their answers are extractions or JSON texts of them) as the tiers after the rules.

    A tier is asked for the messages only that no tier before it could answer. A plug-in that fails on a message
    leaves it to the next tier; of one that no tier answers, reason is the last failure.
    """
    rows = parsing.parse(messages, rules)
    for method, plugin in extractors.items():
        rows = rows.withColumn("__ask", F.when(F.col("outcome") == "FAILED", F.col("text")))
        rows = answered(rows, plugin, parsing.EXTRACTION, "__ask", "__x")
        x = F.col("__x")
        rows = rows.withColumn("__wrong", F.when(F.col("__ask").isNotNull(), F.when(x.isNull(), F.coalesce(F.upper("__x_failure"), F.lit("NO_TIER"))).otherwise(failure(x, F.col("text")))))
        won = F.col("__ask").isNotNull() & F.col("__wrong").isNull()
        fields = parsing.parsed_fields(x, F.lit(method), F.lit(None).cast("string"))
        changed = {c: F.when(won, f).otherwise(F.col(c)) for c, f in zip(PARSED, fields, strict=True)}
        outcome = F.when(won, "PARSED").when(F.col("__wrong") == "NOT_TRANSACTION", "NOT_TRANSACTION").otherwise(F.col("outcome"))
        reason = F.when(won, None).when(F.col("__wrong").isNotNull() & ((F.col("__wrong") != "NO_TIER") | F.col("reason").isNull()), F.col("__wrong")).otherwise(F.col("reason"))
        rows = rows.withColumns(changed | {"outcome": outcome, "reason": reason}).drop("__ask", "__x", "__x_failure", "__wrong")
    return rows


def distill(messages: DataFrame, first: PlugIn, second: PlugIn) -> DataFrame:
    """messages with first_label and second_label: what two teachers read in each text, as canonical JSON; null where a teacher has no answer. `datasets.review_queue` takes it from there."""
    out = messages
    for name, teacher in (("first", first), ("second", second)):
        out = answered(out, teacher, parsing.EXTRACTION, name=f"__{name}").withColumn(f"{name}_label", tiers.canonical(F.col(f"__{name}"))).drop(f"__{name}").withColumnRenamed(f"__{name}_failure", f"{name}_failure")
    return out


def embed(rows: DataFrame, embedder: PlugIn, width: int, text: str = "text", batch: int = BATCH) -> DataFrame:
    """rows with `embedding`, of `width` numbers; an answer of another width is a failure."""

    def load() -> Ask:
        ask = embedder()

        def checked(texts: list[str]) -> list:
            vectors = ask(texts)
            if any(v is not None and len(v) != width for v in vectors):
                raise ValueError("width")
            return [None if v is None else [float(x) for x in v] for v in vectors]

        return checked

    return answered(rows, load, T.ArrayType(T.DoubleType()), text, "embedding", batch)
