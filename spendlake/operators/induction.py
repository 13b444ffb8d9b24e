"""Parse rules learnt from samples: messages of one template that a teacher has read.

A group's samples are few, whatever its share of the messages: the newest of each salt of a group are found
first, then the newest of all. What differs between samples of a template becomes a slot: a named one where it is
a field that the teacher found, else one of a type. A rule is accepted only if it gives back every sample.
"""

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlake.functions.grounding import same_extraction
from spendlake.functions.ids import short_hash
from spendlake.functions.text import sender_key, template_signature
from spendlake.operators.parsing import EXTRACTION, MARK, MAX_TEXT, fault, extraction, written

MIN_SAMPLES, MAX_SAMPLES = 2, 5
COOLDOWN_S = 6 * 3600
SALTS = 64
GROUP = ["user_id", "sender_key", "template"]

NUMBER = r"[\d,]+(?:\.\d{1,2})?"
#: Slot of each field, by the name that the teacher's answer has for it; what is looked for first comes first, so of two equal numbers the first is the amount.
SLOTS = {
    "counterparty_vpa": ("vpa", r"[\w.\-]+@\w+"),
    "merchant_raw": ("merchant", r".+?"),
    "reference_id": ("ref", r"\w{4,}"),
    "amount": ("amount", NUMBER),
    "balance_after": ("bal", NUMBER),
    "account_hint": ("acct", r"\d{3,4}"),
    "promised_refund_days": ("days", r"\d+"),
}
TOKEN = re.compile(r"\d+|[^\W\d_]+|\s+|.", re.DOTALL)
KINDS = ((re.compile(r"\d+"), r"\d+"), (re.compile(r"[^\W\d_]+"), r"[^\W\d_]+"), (re.compile(r"\w+"), r"\w+"))


def same_number(a: str, b: str) -> bool:
    plain = lambda x: re.sub(r"(\.\d*?)0+$", r"\1", x.replace(",", "")).rstrip(".") or "0"
    return plain(a) == plain(b)


def spans(text: str, fields: dict) -> list[tuple[int, int, str]]:
    """Where the fields stand in a text: start, end and field, in order; fields that don't stand in it are left out."""
    found: list[tuple[int, int, str]] = []
    free = lambda a, b: all(b <= x or a >= y for x, y, _ in found)
    for field in SLOTS:
        value = fields.get(field)
        if value in (None, "") or field == "merchant_raw" and value == fields.get("counterparty_vpa"):
            continue
        if field in ("amount", "balance_after"):
            places = [(m.start(), m.end()) for m in re.finditer(r"\d[\d,]*(?:\.\d{1,2})?", text) if same_number(m.group(), str(value))]
        else:
            places = [(m.start(), m.end()) for m in re.finditer(rf"(?<![^\W_X]){re.escape(str(value))}(?!\w)", text)]
        place = next((p for p in places if free(*p)), None)
        if place:
            found.append((*place, field))
    return sorted(found)


def between(literals: list[str]) -> str:
    """A pattern for what stands in one place of all samples: numbers and tokens that differ are typed, the rest is literal."""
    rows = [TOKEN.findall(x) for x in literals]
    if len({len(r) for r in rows}) > 1:
        return ".+?" if all(literals) else ".*?"
    out = []
    for tokens in zip(*rows, strict=True):
        if tokens[0].isdigit():
            out.append(r"\d+")
        elif len(set(tokens)) == 1:
            out.append(r"\s+" if tokens[0].isspace() else re.escape(tokens[0]))
        else:
            out.append(next((pattern for kind, pattern in KINDS if all(kind.fullmatch(t) for t in tokens)), r"\S+"))
    return "".join(out)


def induced(key: str, samples: list[tuple[str, dict]]) -> dict | None:
    """regex, direction, channel and status of a rule that samples (text, fields) of one template have in common; None if their fields stand in different orders."""
    cuts = [spans(text, fields) for text, fields in samples]
    order = [field for *_, field in cuts[0]]
    if "amount" not in order or any([f for *_, f in c] != order for c in cuts):
        return None
    parts = []
    for (text, _), c in zip(samples, cuts, strict=True):
        edges = [0, *(x for a, b, _ in c for x in (a, b)), len(text)]
        parts.append([text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)])
    regex = ""
    for n, field in enumerate(order):
        name, pattern = SLOTS[field]
        last = n == len(order) - 1 and pattern.endswith("+?") and not any(p[-1] for p in parts)
        regex += between([p[n] for p in parts]) + f"(?P<{name}>{pattern.rstrip('?') if last else pattern})"
    regex += between([p[-1] for p in parts])
    first = samples[0][1]
    return {"regex": regex, "direction": first["direction"], "channel": first.get("channel") or "UNKNOWN", "status": first.get("status") or "SUCCESS"}


def newest(messages: DataFrame, n: int = MAX_SAMPLES) -> DataFrame:
    """GROUP and samples (posted_at, event_id, text, truth; newest first, at most n) of each group of messages with a truth.

    A group's messages are dealt by salts first, so that no task orders all of a large one.
    """
    rows = messages.where(F.col("text").isNotNull() & F.col("truth").isNotNull() & (F.length("text") <= MAX_TEXT))
    keyed = rows.withColumn("sender_key", sender_key(F.col("sender"), F.col("source_app"))).withColumn("template", template_signature(F.col("text"), F.col("sender")))
    keyed = keyed.where("sender_key IS NOT NULL").select(*GROUP, "posted_at", "event_id", "text", "truth", F.pmod(F.xxhash64("event_id"), F.lit(SALTS)).alias("salt"))
    order = [F.desc("posted_at"), F.col("event_id")]
    few = keyed.withColumn("place", F.row_number().over(Window.partitionBy(*GROUP, "salt").orderBy(*order))).where(F.col("place") <= n)
    least = few.withColumn("place", F.row_number().over(Window.partitionBy(*GROUP).orderBy(*order))).where(F.col("place") <= n)
    sample = F.struct("place", "event_id", "text", "truth")
    return least.groupBy(*GROUP).agg(F.sort_array(F.collect_list(sample)).alias("samples"))


PROPOSED = T.StructType([T.StructField(c, T.StringType()) for c in ("pattern", "regex", "groups", "direction", "channel", "txn_status", "fault")])


def proposals(groups: DataFrame, writer: Callable[[str, list[tuple[str, dict]]], dict | None] = induced) -> DataFrame:
    """groups with the rule that `writer` writes from each group's samples, and its fault: one that must not be used, TOO_FEW_SAMPLES, no rule, or a writer that failed (writer_error; other groups go on)."""

    def propose(key: str, samples: list[dict]) -> tuple:
        if len(samples) < MIN_SAMPLES:
            return (*[None] * 6, "too_few_samples")
        try:
            rule = writer(key, [(s["text"], s["truth"]) for s in samples])
        except Exception:  # a writer may be anything, and one that fails must not stop the others
            return (*[None] * 6, "writer_error")
        if rule is None:
            return (*[None] * 6, "no_rule")
        direction, channel, status = rule.get("direction"), rule.get("channel", "UNKNOWN"), rule.get("status", "SUCCESS")
        wrong = fault(rule["regex"], direction, channel, status)
        return (rule["regex"], *(written(rule["regex"]) if wrong is None else (None, None)), direction, channel, status, wrong)

    names = PROPOSED.fieldNames()

    def run(batches):
        for batch in batches:
            keys, samples = batch.column("sender_key").to_pylist(), batch.column("samples").to_pylist()
            rows = [propose(k, s) for k, s in zip(keys, samples, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([r[i] for r in rows], pa.string()) for i in range(len(names)))], names=[*batch.schema.names, *names])

    return groups.mapInArrow(run, T.StructType([*groups.schema.fields, *PROPOSED.fields]))


def checked(proposed: DataFrame) -> DataFrame:
    """GROUP, id, pattern, regex, groups, direction, channel, txn_status, n_samples and reason of each proposal: null if it gives back every sample, else its fault, or no_match, fields_differ or channel_differs of the first sample that it fails."""
    taken = lambda s: F.split(F.call_function("regexp_replace", F.replace(s["text"], F.lit(MARK), F.lit(" ")), F.col("regex"), F.col("groups")), MARK)
    rows = proposed.withColumn("id", short_hash("r_syn_", F.concat_ws("\n", "sender_key", "pattern")))
    each = rows.select(*GROUP, "id", "pattern", "regex", "groups", "direction", "channel", "txn_status", "fault", F.size("samples").alias("n_samples"), F.explode("samples").alias("s"))
    rule = {c: F.col(c) for c in ("direction", "channel", "txn_status")}
    each = each.withColumn("__taken", F.when(F.col("fault").isNull(), taken(F.col("s")))).withColumn("__x", extraction(rule, F.col("__taken")).cast(EXTRACTION))
    x, truth = F.col("__x"), F.col("s.truth")
    reason = (
        F.when(F.col("fault").isNotNull(), F.col("fault")).when(x.isNull(), "no_match").when(~F.coalesce(same_extraction(x, truth), F.lit(False)), "fields_differ")
        .when((F.coalesce(truth["channel"], F.lit("UNKNOWN")) != "UNKNOWN") & (x["channel"] != truth["channel"]), "channel_differs")
    )
    each = each.withColumn("reason", reason)
    key = [*GROUP, "id", "pattern", "regex", "groups", "direction", "channel", "txn_status", "n_samples"]
    return each.groupBy(*key).agg(F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("s.place"))).alias("reason"))


def learnt(messages: DataFrame, writer: Callable[[str, list[tuple[str, dict]]], dict | None] = induced, status: str = "CANDIDATE") -> DataFrame:
    """The accepted rules, in the form that `operators.parsing` takes, each once however many groups have come to it.

    messages: event_id, user_id, sender, source_app, text, posted_at, truth (an extraction, by a teacher or by
    hand). Samples of a rule are of one user, sender and template. Null texts and truths, messages without a
    sender's key and texts longer than any rule reads take no part; repeats of an event count as samples of their
    own.
    """
    accepted = checked(proposals(newest(messages), writer)).where("reason IS NULL")
    once = accepted.groupBy("id", "sender_key", "regex", "groups", "direction", "channel", "txn_status").agg(F.count(F.lit(1)).alias("n"))
    return once.select("id", "sender_key", F.lit(status).alias("status"), F.lit(0).cast("long").alias("created_at"), "regex", "groups", "direction", "channel", "txn_status")


def cooled(attempts: DataFrame, seconds: int = COOLDOWN_S) -> DataFrame:
    """attempts (template, at, …) with `ready`: whether no attempt of the template was made within `seconds` before; one that wasn't ready counts as none.

    Which attempts are ready follows from the ones before, in order of time. Where a stretch of `seconds` of a
    template is empty, the next attempt is ready whatever came before, so such stretches part a template's
    attempts into tasks' units; a task remembers one moment. Of attempts at one moment one is ready. An attempt
    without time is never ready.
    """
    span = seconds * 1_000_000
    rows = attempts.withColumn("__m", F.unix_micros(F.col("at").cast("timestamp"))).withColumn("__bin", F.floor(F.col("__m") / max(1, span)))
    bins = rows.select("template", "__bin").distinct()
    order = Window.partitionBy("template").orderBy("__bin")
    unit = bins.withColumn("__new", F.coalesce((F.col("__bin") - F.lag("__bin").over(order) > 1).cast("int"), F.lit(1))).withColumn("__unit", F.sum("__new").over(order)).drop("__new")
    same = rows["template"].eqNullSafe(unit["template"]) & rows["__bin"].eqNullSafe(unit["__bin"])
    dealt = rows.join(unit, same, "left").select(rows["*"], "__unit").repartition("template", "__unit").sortWithinPartitions("template", "__unit", "__m")

    def run(batches):
        unit_, last = None, None
        for batch in batches:
            ready = []
            for own in zip(*(batch.column(c).to_pylist() for c in ("template", "__unit", "__m")), strict=True):
                if own[:2] != unit_:
                    unit_, last = own[:2], None
                good = own[2] is not None and (last is None or own[2] - last >= max(1, span))
                last = own[2] if good else last
                ready.append(good)
            kept = [n for n in batch.schema.names if not n.startswith("__")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(ready, pa.bool_())], names=[*kept, "ready"])

    return dealt.mapInArrow(run, T.StructType([*attempts.schema.fields, T.StructField("ready", T.BooleanType())]))
