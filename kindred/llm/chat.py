"""Chat formatting from event logs.

A conversation is a log of events: ``conv_id, seq, event, msg_id, role, text``.
Rows are dealt by conversation and sorted by sequence, and a fold over them gives the
final messages, which a template then renders.

Events: ``message`` opens a message that holds ``text``; ``start`` opens an empty one;
``delta`` appends ``text`` to message ``msg_id`` (the latest one if null; opens it if
unknown); ``edit`` replaces its text; ``regenerate`` drops what came after it and begins
its text anew with ``text``; ``delete`` drops it.  Other kinds are errors.

The template writes ``<|im_start|>role``, a line end, the text, ``<|im_end|>`` and a
line end.  In roles and texts a backslash follows every ``<``, ``[`` and backslash, so
no control string of this or another template survives inside a text, and the escape
can be undone.  A line end in a role becomes backslash, n.

Cases: null text is empty, a null role is empty; rows with a null ``conv_id`` are one
conversation; rows without a sequence come first; ties in sequence go by event, message,
role and text; a repeated ``message`` row is a message of its own.  An edit, regenerate
or delete of an unknown message does nothing.  A conversation is held whole while it is
folded, and so is a very long text; conversations are written some at a time.  Other
columns are ignored, whatever their names; an empty log gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import small_batches

START, END = "<|im_start|>", "<|im_end|>"
_SPECIAL = re.compile(r"[<\[\\]")
_ESCAPED = re.compile(r"([<\[\\])\\")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)

#: Conversations, and characters of these, that are written together, about.
ROWS, CHARS = 256, 4_000_000

SCHEMA = "conv_id long, formatted string, loss_spans array<struct<start:long,end:long>>"


def escape(text: str) -> str:
    return _SPECIAL.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def _unescape_role(role: str) -> str:
    out, i = [], 0
    while i < len(role):
        if role[i] in "<[\\" and role[i + 1 : i + 2] == "\\":
            out.append(role[i])
            i += 2
        elif role[i] == "\\":  # only a line end is left: a backslash of the role is two
            out.append("\n")
            i += 2
        else:
            out.append(role[i])
            i += 1
    return "".join(out)


class Fold:
    """The state of one conversation while its events go by."""

    def __init__(self) -> None:
        self.order: list[object] = []
        self.messages: dict[object, list] = {}

    def _open(self, key: object, role: str | None) -> list:
        if key is None or key in self.messages:
            key = ("unnamed", len(self.order), object())
        self.order.append(key)
        self.messages[key] = [role or "", []]
        return self.messages[key]

    def add(self, event: str, key: object, role: str | None, text: str | None) -> None:
        text = text or ""
        if event in ("message", "start"):
            self._open(key, role)[1].append(text if event == "message" else "")
        elif event == "delta":
            if key is None:
                key = self.order[-1] if self.order else None
            (self.messages.get(key) or self._open(key, role))[1].append(text)
        elif event in ("edit", "regenerate", "delete"):
            if key not in self.messages:
                return
            if event == "edit":
                self.messages[key][1] = [text]
                return
            at = self.order.index(key)
            if event == "regenerate":
                self.messages[key][1] = [text]
                gone, self.order = self.order[at + 1 :], self.order[: at + 1]
            else:
                gone = [self.order.pop(at)]
            for k in gone:
                del self.messages[k]
        else:
            raise ValueError(f"unknown event {event!r}")

    def final(self) -> list[tuple[str, str]]:
        return [(self.messages[k][0], "".join(self.messages[k][1])) for k in self.order]


def render(messages: list[tuple[str, str]], loss_role: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the spans of it that the loss counts."""
    parts, spans, at = [], [], 0
    for role, text in messages:
        head, body = f"{START}{_escape_role(role)}\n", escape(text)
        if role == loss_role:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, f"{END}\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The messages that a formatted conversation holds; the inverse of ``render``."""
    return [(_unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def format_chats(events: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """``conv_id, formatted, loss_spans``: one row per conversation with an event."""
    small_batches(events.sparkSession)
    log = events.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("seq").cast("long").alias("seq"), "event",
        F.col("msg_id").cast("string").alias("msg_id"), F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"),
    )

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, size = None, None, 0
        done: list[tuple[int | None, str, list[dict]]] = []

        def close() -> None:
            nonlocal size
            formatted, spans = render(state.final(), loss_role)
            done.append((now, formatted, [{"start": a, "end": b} for a, b in spans]))
            size += len(formatted)

        def written() -> pd.DataFrame:
            nonlocal size
            ids, texts, spans = zip(*done, strict=True)
            frame = pd.DataFrame({"conv_id": pd.array(ids, dtype="Int64"), "formatted": texts, "loss_spans": list(spans)})
            done.clear()
            size = 0
            return frame

        for batch in batches:
            for conv, event, key, role, text in zip(
                *(batch[c] for c in ("conv_key", "event", "msg_id", "role", "text")), strict=True
            ):
                conv = None if pd.isna(conv) else int(conv)
                if state is None or conv != now:
                    if state is not None:
                        close()
                        if len(done) >= ROWS or size >= CHARS:
                            yield written()
                    now, state = conv, Fold()
                state.add(event, *(None if pd.isna(x) else x for x in (key, role, text)))
        if state is not None:
            close()
            yield written()

    dealt = log.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "event", "msg_id", "role", "text")
    dealt = dealt.select(F.col("conv_id").cast("string").alias("conv_key"), "event", "msg_id", "role", "text")
    return dealt.mapInPandas(fold, SCHEMA)


#: Characters of a streamed delta.
DELTA_CHARS = 256


def conversation_events(conversations: DataFrame) -> DataFrame:
    """An event log whose fold is a finished table of turns ``conv_id, turn, role, text``.

    Turns are logged in four ways, by a hash: as a message; as a stream of deltas; as a
    draft that is edited; as a draft that another message follows and that is then
    regenerated as a stream.  Turns with one number come by role, then text.
    """
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("role").cast("string").alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.row_number().over(W.partitionBy("conv_id").orderBy("turn", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))).cast("long").alias("at"),
    )
    name, draft = F.col("at").cast("string"), F.concat(F.lit("draft: "), F.reverse("text"))

    def event(kind: str, msg: Column = name, text: Column | None = None, role: Column | None = None) -> Column:
        none = F.lit(None).cast("string")
        return F.struct(F.lit(kind).alias("event"), msg.alias("msg_id"), (none if role is None else role).alias("role"), (none if text is None else text).alias("text"))

    pieces = F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{DELTA_CHARS}}}"), F.lit(0))
    deltas = F.transform(pieces, lambda p: event("delta", text=p))
    role = F.col("role")
    way = F.pmod(F.xxhash64("conv_id", "at"), F.lit(4))
    log = (
        F.when(way == 0, F.array(event("message", text=F.col("text"), role=role)))
        .when(way == 1, F.concat(F.array(event("start", role=role)), deltas))
        .when(way == 2, F.array(event("start", role=role), event("delta", text=draft), event("edit", text=F.col("text"))))
        .otherwise(F.concat(
            F.array(event("message", text=draft, role=role), event("message", F.concat(name, F.lit("-follow")), F.lit("stale"), F.lit("user")), event("regenerate")), deltas
        ))
    )
    # a turn's events have consecutive numbers, the turns' are so far apart that no text has more deltas
    each = turns.select("conv_id", "at", F.posexplode(log).alias("step", "e"))
    return each.select("conv_id", (F.col("at") * (1 << 31) + F.col("step")).alias("seq"), "e.event", "e.msg_id", "e.role", "e.text")
