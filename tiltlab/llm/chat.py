"""Chat formatting: a state machine over roles and a declarative template.

Turns of a conversation, in order of (turn, role, text), become text segments: an opening, the escaped text and a closing
for each turn. Every segment has a loss flag, set for the texts of the template's ``loss`` roles. The machine's
transitions say which role may follow which; a conversation that breaks them is still formatted, and its segments
say from which turn on it is not valid.

Escaping is reversible and leaves no control string in any text: a backslash and the first characters of the control
strings are replaced by a backslash and a letter each.

Conversations are dealt by id and sorted by turn; tasks stream over them and hold one turn at a time, so a
conversation of any length needs no memory of its own. Segments are rows; nothing is concatenated.

Defined results: null texts and roles are empty; null turns come first, and a null conv_id is one conversation; equal rows are
turns of their own; a row cut off by no assistant has no loss text; an empty table gives no segment. Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEMPLATE = {
    "start": "### Conversation\n",
    "open": "### {role}:\n",
    "close": "\n</turn>\n",
    "names": {"user": "User", "assistant": "Assistant", "system": "System", "tool": "Tool"},
    "loss": ("assistant",),
    # From each state, the roles that may come next; a state is the last role, or "start".
    "follows": {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user", "tool"), "tool": ("assistant",)},
    "ends": ("assistant",),
    # What stands for the escape character and for the characters that begin control strings.
    "escapes": {"\\": "\\b", "#": "\\h", "<": "\\l"},
}

SEGMENTS = "conv_id long, place long, turn long, role string, kind string, segment string, loss boolean, valid boolean"


def escape(text: str, template: dict = TEMPLATE) -> str:
    return re.sub("[" + re.escape("".join(template["escapes"])) + "]", lambda m: template["escapes"][m.group()], text)


def unescape(text: str, template: dict = TEMPLATE) -> str:
    back = {v: k for k, v in template["escapes"].items()}
    return re.sub("|".join(map(re.escape, back)), lambda m: back[m.group()], text)


class RoleMachine:
    """Follows one conversation; ``valid`` turns false at the first role that may not come next."""

    def __init__(self, template: dict):
        self.follows, self.state, self.valid = template["follows"], "start", True

    def step(self, role: str) -> bool:
        self.valid = self.valid and role in self.follows.get(self.state, ())
        self.state = role
        return self.valid


def _ordered(turns: DataFrame) -> DataFrame:
    narrow = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return narrow.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_turns(turns: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """Segments of all conversations, in ``place`` order within each, partitioned by conv_id."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("kind", pa.string()), ("segment", pa.string()), ("loss", pa.bool_()), ("valid", pa.bool_())])
        machine, current, place = None, object(), 0
        for batch in batches:
            rows: list[tuple] = []
            for conv, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if machine is None or conv != current:
                    machine, current, place = RoleMachine(template), conv, 0
                    rows.append((conv, place, None, None, "start", template["start"], False, True))
                    place += 1
                valid = machine.step(role)
                name = escape(template["names"].get(role, role), template)
                for kind, segment in (("open", template["open"].format(role=name)), ("text", escape(text, template)), ("close", template["close"])):
                    rows.append((conv, place, turn, role, kind, segment, kind == "text" and role in template["loss"], valid))
                    place += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return _ordered(turns).mapInArrow(segments, SEGMENTS)


def read_back(segments: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """Digests of conversations from their segments: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Expects the rows of a conversation together and in order, as ``format_turns`` returns them. Roles and texts are recovered
    from the segments' strings alone.
    """
    roles = {v: k for k, v in template["names"].items()}
    head, tail = template["open"].split("{role}")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
        state: dict | None = None

        def result(s: dict) -> tuple:
            return s["conv"], s["turns"], s["all"].hexdigest(), s["chars"], s["loss"].hexdigest(), s["formatted"]

        for batch in batches:
            done: list[tuple] = []
            for conv, place, kind, segment, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "kind", "segment", "loss")), strict=True):
                if place == 0:
                    if state is not None:
                        done.append(result(state))
                    state = {"conv": conv, "turns": 0, "all": hashlib.sha256(), "loss": hashlib.sha256(), "chars": 0, "formatted": 0}
                state["formatted"] += len(segment)
                if kind == "open":
                    name = unescape(segment[len(head) : len(segment) - len(tail)], template)
                    state["turns"] += 1
                    state["all"].update((roles.get(name, name) + "\n").encode())
                elif kind == "text":
                    text = unescape(segment, template)
                    state["all"].update((text + "\n").encode())
                    if loss:
                        state["loss"].update(text.encode())
                        state["chars"] += len(text)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(result(state), schema, strict=True)], schema=schema)

    return segments.mapInArrow(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
