"""Reports of a stream merged into payments one event after another, with keyed state that forgets.

The rules are those of `operators.merging`; a user's reports meet what the state holds of the user. Payments lie
in the state by stretches of time as long as the longest window, so a report looks at three of them; events,
references and merchants lie packed in a few texts each. So a trigger's calls of the state grow with what it touches
of a user, not with its reports. A timer in event time clears what nothing can match any more: payments after the longest window, events,
references and merchants of debits after a horizon.
"""

import json
from datetime import UTC, datetime
from zlib import crc32

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from spendlake.functions.text import merchant_key
from spendlake.operators.merging import FIELDS, REFUND_DAYS, SELF_TRANSFER, WINDOW, WINDOW_WITH_REFERENCE, Payment, own_transfer
from spendlake.streaming.jobs import written_once
from spendlake.streaming.processors import stateful

SECOND = 1_000_000
DAY = 86_400 * SECOND
BIN = WINDOW_WITH_REFERENCE * SECOND
#: Texts that a user's events, references or merchants are dealt over.
PACKS = 8
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What a stored payment holds beside its fields.
HELD = [c for c in FIELDS if c not in ("txn_time", "payment", "version", "is_new")] + ["plain", "key", "kind", "bumps"]


def kind_of(r: dict) -> str:
    """Kind of a new payment by its own fields, as `base_kind` gives it."""
    if r["status"] == "REVERSED":
        return "REVERSAL"
    if r["direction"] == "CREDIT":
        return "REFUND" if r["status"] == "REFUND_INITIATED" else "INCOME"
    return "ATM_WITHDRAWAL" if r["channel"] == "ATM" else "SPEND"


def packed(payments: list[Payment]) -> str:
    return json.dumps([[p.payment, p.version, sorted(p.sources, key=repr), [p.row.get(c) for c in HELD]] for p in payments])


def unpacked(text: str) -> list[Payment]:
    out = []
    for payment, version, sources, values in json.loads(text):
        row = dict(zip(HELD, values, strict=True))
        p = Payment(row | {"seq": payment, "raw_type": None, "source_app": None})
        p.row, p.version, p.sources = row, version, {tuple(s) for s in sources}
        out.append(p)
    return out


class Known:
    """A map of texts in the state, read at most once a key and trigger (not at all while it is empty), and written where it changed."""

    def __init__(self, state):
        self.state, self.values, self.changed = state, {}, set()
        self.filled = state.exists()

    def get(self, key: tuple):
        if key not in self.values:
            self.values[key] = self.state.getValue(key)[0] if self.filled and self.state.containsKey(key) else None
        return self.values[key]

    def put(self, key: tuple, value) -> None:
        self.values[key] = value
        self.changed.add(key)

    def write(self) -> None:
        for key in self.changed:
            self.state.updateValue(key, (self.values[key],))


class Packed:
    """Values by key, dealt over PACKS texts of the state, so that a trigger's many keys cost few calls of the state."""

    def __init__(self, state):
        self.known, self.packs = Known(state), {}

    def pack(self, name: str) -> tuple[tuple, dict]:
        spot = (crc32(name.encode()) % PACKS,)
        if spot not in self.packs:
            self.packs[spot] = json.loads(self.known.get(spot) or "{}")
        return spot, self.packs[spot]

    def get(self, key):
        name = named(key)
        return self.pack(name)[1].get(name)

    def put(self, key, value) -> None:
        name = named(key)
        spot, own = self.pack(name)
        own[name] = value
        self.known.put(spot, None)

    def write(self) -> None:
        for spot in self.known.changed:
            self.known.values[spot] = json.dumps(self.packs[spot])
        self.known.write()


def named(key) -> str:
    """A key as a name in JSON; null is a name of its own."""
    return "" if key is None else f"={key}"


def left_of(state, kept) -> bool:
    """Lets go of the values in packed state for which kept(value) is null, and puts kept(value) in place of the others; whether any are left."""
    left = False
    for spot, (text,) in list(state.iterator()):
        old = json.loads(text)
        new = {name: k for name, value in old.items() if (k := kept(value)) is not None}
        left = left or bool(new)
        if not new:
            state.removeKey(spot)
        elif new != old:
            state.updateValue(spot, (json.dumps(new),))
    return left


class Merger(StatefulProcessor):
    """A user's reports into versions of payments."""

    def __init__(self, names: list[str], horizon: int):
        self.names, self.horizon = names, horizon

    def init(self, handle) -> None:
        self.handle = handle
        self.payments = handle.getMapState("payments", "bin long", "packed string")
        self.events, self.references, self.merchants = (handle.getMapState(name, "pack long", "packed string") for name in ("events", "references", "merchants"))

    def handleInputRows(self, key, rows, timerValues):
        stored = Known(self.payments)
        events, references, merchants = (Packed(s) for s in (self.events, self.references, self.merchants))
        lists: dict[int, dict[int, list[Payment]]] = {}

        def at(amount: int, number: int) -> list[Payment]:
            if number not in lists:
                own = lists[number] = {}
                text = stored.get((number,))
                for p in unpacked(text) if text else []:
                    own.setdefault(p.row["amount_paise"], []).append(p)
            return lists[number].setdefault(amount, [])

        def within(r: dict, seconds: int) -> list[Payment]:
            reach = seconds * SECOND
            bins = range((r["micros"] - reach) // BIN, (r["micros"] + reach) // BIN + 1)
            return [p for b in bins for p in at(r["amount_paise"], b) if abs(p.micros - r["micros"]) <= reach]

        def dirty(p: Payment) -> None:
            stored.put((p.micros // BIN,), None)

        def debit_seen(row: dict, micros: int) -> None:
            if row["reference_id"]:
                references.put(row["reference_id"], max(micros, references.get(row["reference_id"]) or micros))
            if row["merchant_id"] is not None:
                days = merchants.get(row["merchant_id"]) or {}
                low, high = days.get(str(micros // DAY), (micros, micros))
                days[str(micros // DAY)] = min(low, micros), max(high, micros)
                merchants.put(row["merchant_id"], days)

        def refunds(r: dict) -> bool:
            if r["merchant_id"] is None:
                return False
            days = merchants.get(r["merchant_id"]) or {}
            return any(low <= r["micros"] and high >= r["micros"] - REFUND_DAYS * DAY for low, high in days.values())

        out = []
        for r in sorted((x.asDict() for x in rows), key=lambda x: x["seq"]):
            if events.get(r["event_id"]) is not None:
                continue
            events.put(r["event_id"], r["micros"])
            near = sorted(((p.apart(r), p.payment, p) for p in within(r, WINDOW_WITH_REFERENCE if r["reference_id"] else WINDOW) if p.row["direction"] == r["direction"]), key=lambda x: x[:2])
            own = next((p for _, _, p in near if p.takes(r)), None)
            changed = []
            if own:
                category = own.row["category"]
                own.add(r)
                if own.row["kind"] == "SELF_TRANSFER":
                    own.row["category"] = category
                own.row |= {"seq": r["seq"], "event_id": r["event_id"]}
                changed = [own]
            else:
                own = Payment({c: r.get(c) for c in {*HELD, "raw_type", "source_app"}} | {"bumps": 0})
                kind = kind_of(r)
                if r["direction"] == "CREDIT":
                    kind = "REVERSAL" if r["reference_id"] and references.get(r["reference_id"]) is not None else "REFUND" if refunds(r) else kind
                own.row["kind"] = kind
                partner = None
                if r["account_hint"] and kind in ("SPEND", "INCOME"):
                    partner = min((p for p in within(r, SELF_TRANSFER) if own_transfer(p.row, r)), key=lambda p: p.payment, default=None)
                at(r["amount_paise"], own.micros // BIN).append(own)
                changed = [own]
                if partner:
                    for p in (own, partner):
                        p.row["kind"], p.row["category"] = "SELF_TRANSFER", "TRANSFERS"
                    partner.row["bumps"] += 1
                    changed.append(partner)
            if r["direction"] == "DEBIT":
                debit_seen(own.row, r["micros"])
            for p in changed:
                dirty(p)
                out.append(self.row(key[0], p))
        for spot in stored.changed:
            stored.values[spot] = packed([p for own in lists[spot[0]].values() for p in own])
        for known in (stored, events, references, merchants):
            known.write()
        if not any(True for _ in self.handle.listTimers()):
            self.later(timerValues)
        yield from out

    def row(self, user, p: Payment) -> Row:
        version = p.version + p.row["bumps"]
        values = p.row | {"user_id": user, "payment": p.payment, "version": version, "is_new": p.version == 1, "txn_time": datetime.fromtimestamp(p.micros // SECOND, UTC).replace(microsecond=p.micros % SECOND, tzinfo=None)}
        return Row(**{c: values[c] for c in self.names})

    def later(self, timerValues) -> None:
        self.handle.registerTimer(timerValues.getCurrentWatermarkInMs() + DAY // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs() * 1000
        left = False
        for (number,) in list(self.payments.keys()):
            if (number + 2) * BIN < now:
                self.payments.removeKey((number,))
            else:
                left = True
        fresh = lambda micros: micros if micros + self.horizon * DAY >= now else None
        recent = lambda days: {d: v for d, v in days.items() if v[1] + REFUND_DAYS * DAY >= now} or None
        for state, kept in ((self.events, fresh), (self.references, fresh), (self.merchants, recent)):
            left = left_of(state, kept) or left
        if left:
            self.later(timerValues)
        yield from ()

    def close(self) -> None:
        pass


def merged_stream(reports: DataFrame, late: str = "7 days", horizon: int = REFUND_DAYS) -> DataFrame:
    """The changelog of payments (as `operators.merging.payments` gives it) of a stream of reports.

    reports: the columns that `operators.merging.merged` takes; reports of a user are taken by seq within a
    trigger, and triggers in order. A report later than `late` behind the latest is left out. An event, and the
    reference of a debit, are known for `horizon` days; payments leave the state when nothing within 48 hours can
    come any more, so its size follows what comes in that time, not the stream's length. Reports without
    user_id are one user's. The state needs Spark's RocksDB store, which is set here.
    """
    reports.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = reports.withColumn("micros", F.unix_micros(F.col("txn_time").cast("timestamp"))).withColumn("plain", F.lower(F.trim("merchant_raw"))).withColumn("key", merchant_key(F.col("merchant_raw")))
    rows = rows.withColumn("__at", F.col("txn_time").cast("timestamp")).withWatermark("__at", late)
    kinds = {"payment": T.LongType(), "version": T.IntegerType(), "is_new": T.BooleanType(), "kind": T.StringType(), "txn_time": T.TimestampNTZType()}
    names = [c for c in FIELDS if c != "micros"] + ["kind"]
    schema = T.StructType([T.StructField(c, kinds.get(c) or rows.schema[c].dataType) for c in names])
    return stateful(rows.groupBy("user_id"), Merger(names, horizon), schema)


def merge(reports: DataFrame, folder: str, checkpoint: str, late: str = "7 days", horizon: int = REFUND_DAYS) -> StreamingQuery:
    """Merges what a stream of reports has now and writes the changelog to `folder`, batch by batch; a batch that runs again replaces what it had written."""
    return written_once(merged_stream(reports, late, horizon), folder, checkpoint)
