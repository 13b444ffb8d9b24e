"""Chat formatting: a state machine over roles, a declarative template, and text segments with loss flags."""

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An escaped role name: its own colons have a backslash before them.
NAME = re.compile(r"(?:\\.|[^\\:])*", re.DOTALL)

#: Which role may follow which; None stands for the start.
FOLLOWS = {None: {"system", "user"}, "system": {"user"}, "user": {"assistant"}, "assistant": {"user"}}


@dataclass(frozen=True)
class Template:
    """A header for each role, the end of a turn, and the roles whose texts are learned.

    Texts are escaped so that neither headers nor ends can stand in them: a backslash before each backslash
    and each `#`, and one inside each `</`. A role without a header of its own has `other` around its name.
    """

    headers: dict[str, str] = field(default_factory=lambda: {"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "})
    other: tuple[str, str] = ("### @", ": ")
    end: str = "</turn>\n"
    learned: frozenset[str] = frozenset({"assistant"})

    def header(self, role: str) -> str:
        return self.headers.get(role) or self.other[0] + escape(role).replace(":", "\\:") + self.other[1]

    def segments(self, role: str, text: str) -> list[dict]:
        """Header, escaped text and end of a turn; only a learned role's text has the loss flag."""
        return [{"text": self.header(role), "loss": False}, {"text": escape(text), "loss": role in self.learned}, {"text": self.end, "loss": False}]

    def parse(self, turn: str) -> tuple[str, str]:
        """Role and text of a formatted turn, from the string alone."""
        body = turn.removesuffix(self.end)
        for role, header in self.headers.items():
            if body.startswith(header):
                return role, unescape(body[len(header) :])
        rest = body.removeprefix(self.other[0])
        name = NAME.match(rest)[0]
        return unescape(name), unescape(rest[len(name) + len(self.other[1]) :])


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("#", "\\#").replace("</", "<\\/")


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    out, at = [], 0
    while (found := text.find("\\", at)) >= 0:
        out.append(text[at:found])
        out.append(text[found + 1 : found + 2])
        at = found + 2
    return "".join(out) + text[at:]


SEGMENTS = "array<struct<text: string, loss: boolean>>"


def by_turn(conversations: DataFrame) -> DataFrame:
    """Rows of each conversation together, by turn; rows of one turn by role, then text."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def formatted(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, place, segments and fault of each turn, conversations one after another and turns in order.

    fault tells what the state machine holds against a turn (null if nothing): a role it doesn't know, or one
    that may not stand here. Turns with faults are formatted like others. Null roles and texts are empty;
    rows without conv_id make one conversation; repeated rows are turns of their own. A conversation passes
    through its task turn by turn, so its length doesn't matter.
    """
    template = template or Template()
    kind = conversations.schema["conv_id"].dataType.simpleString()
    segment = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))

    def run(batches):
        conv, state, place = object(), None, 0
        for batch in batches:
            places, segments, faults = [], [], []
            for own, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if own != conv:
                    conv, state, place = own, None, 0
                fault = f"unknown role {role}" if role not in FOLLOWS else None if role in FOLLOWS.get(state, ()) else f"{role} after {state or 'the start'}"
                places.append(place)
                segments.append(template.segments(role, text))
                faults.append(fault)
                state, place = role, place + 1
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(places, pa.int64()), pa.array(segments, segment), pa.array(faults, pa.string())], names=["conv_id", "place", "segments", "fault"])

    return by_turn(conversations).mapInArrow(run, f"conv_id {kind}, place long, segments {SEGMENTS}, fault string")


def read_back(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """A row for each conversation of `formatted`: digests of the turns and of the text under the loss flags, and lengths.

    A conversation is read as one text with a mask; where a turn ends, and what its role and text are, only the
    template tells. What follows the last end that was found waits for more text; text that no end follows
    raises ValueError.
    """
    template = template or Template()
    kind = turns.schema["conv_id"].dataType.simpleString()
    fields = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "fault"]

    def run(batches):
        conv, now = object(), None
        for batch in batches:
            done = []
            for own, segments, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segments", "fault")), strict=True):
                if own != conv:
                    if now:
                        done.append(finish(now))
                    conv, now = own, {"conv_id": own, "n_turns": 0, "turns": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(), "formatted_chars": 0, "fault": None, "rest": ""}
                now["rest"] += "".join(s["text"] for s in segments)
                for role, text in parsed(now):
                    now["n_turns"] += 1
                    now["turns"].update(f"{role}\n{text}\n".encode())
                learned = "".join(unescape(s["text"]) for s in segments if s["loss"])
                now["loss_chars"] += len(learned)
                now["loss"].update(learned.encode())
                now["fault"] = now["fault"] or fault
            yield rows(done)
        yield rows([finish(now)] if now else [])

    def parsed(now: dict):
        """Role and text of each turn that has ended; the rest is kept."""
        while (at := now["rest"].find(template.end)) >= 0:
            stop = at + len(template.end)
            turn, now["rest"] = now["rest"][:stop], now["rest"][stop:]
            now["formatted_chars"] += len(turn)
            yield template.parse(turn)

    def finish(now: dict) -> dict:
        if now["rest"]:
            raise ValueError(f"conversation {now['conv_id']} ends within a turn")
        return now | {"turns_sha256": now["turns"].hexdigest(), "loss_sha256": now["loss"].hexdigest()}

    def rows(done: list[dict]) -> pa.RecordBatch:
        columns = {f: [d[f] for d in done] for f in fields}
        kinds = {"turns_sha256": pa.string(), "loss_sha256": pa.string(), "fault": pa.string(), "conv_id": id_type}
        return pa.RecordBatch.from_arrays([pa.array(columns[f], kinds.get(f, pa.int64())) for f in fields], names=fields)

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(turns.schema["conv_id"].dataType)
    return turns.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, fault string")


SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
escaped AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '#', '\#'), '</', '<\/') AS body,
    CASE role WHEN 'system' THEN '### System: ' WHEN 'user' THEN '### User: ' WHEN 'assistant' THEN '### Assistant: '
      ELSE '### @' || replace(replace(replace(replace(role, '\', '\\'), '#', '\#'), '</', '<\/'), ':', '\:') || ': ' END AS header
  FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(length(header) + length(body) + 8) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""
