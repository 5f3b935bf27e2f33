r"""Chat formatting by event-sourced reconstruction (operator 12).

A log holds events (conv_id, message, copy, seq, kind, role, text); `message` is the place of a message in its conversation, `copy`
tells messages of one place apart.  Kinds, applied in the order of `seq`:

* start: the message begins with `text`; it has `role`
* delta: `text` is appended
* edit: `text` takes the place of the text so far
* regenerate: the text so far is discarded, and so are all messages of later places as far as they were logged before

The log is partitioned by conversation and sorted by (message, copy, seq), so the events of a message are adjacent and
come after all regenerations that can void them: the fold holds one message, whatever the length of a conversation.  An event
that was logged twice (same conv_id, message, copy and seq) counts once.

Template: user `[INST] text [/INST]`, assistant `<s>text</s>`, other roles `[ROLE]role[/ROLE][TEXT]text[/TEXT]`.  A control string
inside a text gets a backslash after its first character, besides those it has there already; so no text holds a control string, and
taking one backslash away gives it back.  The loss mask covers the texts of the assistant, without the marks.

Skew: one shuffle by conversation.  A conversation of any length passes one task as a stream, because its parts and digests
follow from one another; a task holds one message and one part of the output.

Defined cases: null texts and roles are empty; a null conv_id is a conversation of its own; a null message comes first, a null
seq counts as 0; events of no or another kind are ignored; a message whose events are all void is none; the role is the last one
given, '' if none; an empty log gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantweft.llm import common as C

CONTROL = r"([\[<])(\\{least,})(/?(?:INST\]|ROLE\]|TEXT\]|s>))"
_PLAIN, _ESCAPED = re.compile(CONTROL.replace("least", "0")), re.compile(CONTROL.replace("least", "1"))
_MARK = re.compile(r"(\[/?(?:INST|ROLE|TEXT)\]|</?s>)")
#: A part of the output is closed at so many characters; shorter conversations are one part.
PART = 1 << 20
#: Characters of a streamed piece in the query.
DELTA = 256
#: The conversation that the query adds.
PROBE_ID, PROBE_TEXT = -7, "</s>[INST] ok [/INST]"

FIRST = -(1 << 63)


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1] + m[2][1:] + m[3], text)


def rendered(role: str, text: str) -> tuple[str, int, int]:
    """(formatted turn, start and stop of its loss span, equal if it has none)."""
    text = escape(text)
    if role == "assistant":
        return f"<s>{text}</s>", 3, 3 + len(text)
    if role == "user":
        return f"[INST] {text} [/INST]", 0, 0
    return f"[ROLE]{escape(role)}[/ROLE][TEXT]{text}[/TEXT]", 0, 0


def turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of an output."""
    pieces = _MARK.split(formatted)
    role = ""
    for mark, inside in zip(pieces[1::2], pieces[2::2], strict=True):
        if mark == "<s>":
            yield "assistant", unescape(inside)
        elif mark == "[INST]":
            yield "user", unescape(inside[1:-1])
        elif mark == "[ROLE]":
            role = unescape(inside)
        elif mark == "[TEXT]":
            yield role, unescape(inside)


@dataclass
class _Message:
    place: tuple
    role: str = ""
    parts: list[str] = field(default_factory=list)
    valid: bool = False
    seq: int | None = None
    regenerated: int | None = None

    def apply(self, seq: int, kind: str, role: str | None, text: str, void_before: int | None) -> None:
        if seq == self.seq:  # logged twice
            return
        self.seq = seq
        if role is not None:
            self.role = role
        if kind == "regenerate":
            self.regenerated = seq
        if void_before is not None and seq < void_before:
            return
        self.valid = True
        if kind != "delta":
            self.parts.clear()
        if kind != "regenerate" and text:
            self.parts.append(text)


def _messages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str | None, str]]:
    """(conv_id, role, text) of the final messages of sorted events; role is None once at the end of a conversation."""
    conv, now, void, pending = None, None, None, None
    begun = False

    def closed():
        nonlocal pending
        if now.regenerated is not None:
            # it voids later places, not other copies of this one
            pending = now.regenerated if pending is None else max(pending, now.regenerated)
        if now.valid:
            yield conv, now.role, "".join(now.parts)

    for batch in batches:
        for c, place, copy, seq, kind, role, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if not begun or c != conv:
                if begun:
                    yield from closed()
                    yield conv, None, ""
                conv, now, void, pending, begun = c, _Message((place, copy)), None, None, True
            elif now.place != (place, copy):
                yield from closed()
                if now.place[0] != place and pending is not None:
                    void, pending = pending if void is None else max(void, pending), None
                now = _Message((place, copy))
            now.apply(seq, kind, role, text, void)
    if begun:
        yield from closed()
        yield conv, None, ""


def format_chats(log: DataFrame, part: int = PART) -> DataFrame:
    """(conv_id, part, text, loss): the formatted conversations.  Their texts are cut at the ends of turns into parts from 0 on;
    loss: array<struct<start, stop>> in the code points of the part.  Parts of a conversation are adjacent and in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, pieces, loss, size, number, waiting = [], [], [], 0, 0, 0
        for conv, role, text in _messages(batches):
            if role is not None:
                piece, start, stop = rendered(role, text)
                if role == "assistant":
                    loss.append({"start": size + start, "stop": size + stop})
                pieces.append(piece)
                size += len(piece)
            if pieces and (role is None or size >= part):
                rows.append((conv, number, "".join(pieces), loss))
                waiting += size
                number, pieces, loss, size = number + 1, [], [], 0
            if role is None:
                number = 0
            if waiting >= PART:
                yield _batch(rows)
                rows, waiting = [], 0
        if rows:
            yield _batch(rows)

    place = F.coalesce(F.col("message").cast("long"), F.lit(FIRST)).alias("message")
    count = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c)
    events = log.filter(F.col("kind").isin("start", "delta", "edit", "regenerate"))
    events = events.select(F.col("conv_id").cast("long").alias("conv_id"), place, count("copy"), count("seq"), "kind", "role", F.coalesce("text", F.lit("")).alias("text"))
    ordered = events.repartition("conv_id").sortWithinPartitions("conv_id", "message", "copy", "seq", "kind", "text")
    return ordered.mapInArrow(run, FORMATTED)


FORMATTED = "conv_id long, part int, text string, loss array<struct<start:long,stop:long>>"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    conv, number, text, loss = zip(*rows, strict=True)
    spans = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    return pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(number, pa.int32()), pa.array(text, pa.string()), pa.array(loss, spans)], ["conv_id", "part", "text", "loss"])


def read_back(formatted: DataFrame) -> DataFrame:
    """Of each conversation of format_chats: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = []

        def out() -> pa.RecordBatch:
            conv, n, said, chars, loss, size = zip(*rows, strict=True)
            columns = [pa.array(conv, pa.int64()), pa.array(n, pa.int64()), pa.array([h.hexdigest() for h in said]), pa.array(chars, pa.int64()), pa.array([h.hexdigest() for h in loss]), pa.array(size, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            for conv, number, text, loss in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if number == 0:
                    if len(rows) >= 1000:
                        yield out()
                        rows.clear()
                    rows.append([conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0])
                row = rows[-1]
                for role, said in turns(text):
                    row[1] += 1
                    row[2].update(f"{role}\n{said}\n".encode())
                for span in loss:
                    learnt = unescape(text[span["start"] : span["stop"]])
                    row[3] += len(learnt)
                    row[4].update(learnt.encode())
                row[5] += len(text)
        if rows:
            yield out()

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def streamed(conversations: DataFrame, delta: int = DELTA) -> DataFrame:
    """The log of a table of turns (conv_id, turn, role, text): each row starts a message and streams its text in pieces.  Rows of
    one turn are messages of their own, in the order of the table."""
    rows = conversations.select("conv_id", F.col("turn").alias("message"), F.monotonically_increasing_id().alias("copy"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    start = "array(named_struct('seq', 0L, 'kind', 'start', 'text', ''))"
    deltas = f"transform(sequence(0, (length(text) - 1) div {delta}), i -> named_struct('seq', i + 1L, 'kind', 'delta', 'text', substring(text, i * {delta} + 1, {delta})))"
    rows = rows.withColumn("event", F.explode(F.expr(f"if(text = '', {start}, concat({start}, {deltas}))")))
    return rows.select("conv_id", "message", "copy", "event.seq", "event.kind", F.expr("if(event.kind = 'start', role, null)").alias("role"), "event.text")


def with_probe(conversations: DataFrame) -> DataFrame:
    """Adds a conversation whose texts look like the template's marks."""
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = conversations.sparkSession.createDataFrame([(PROBE_ID, 0, "user", PROBE_TEXT), (PROBE_ID, 1, "assistant", PROBE_TEXT)], turns.schema)
    return turns.unionByName(probe)


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(format_chats(streamed(with_probe(C.table(spark, sf_dir, "conversations")))))


_ESCAPE_SQL = CONTROL.replace("least", "0")
OP12_SQL = rf"""
with c as (select conv_id, turn, role, text from conversations union all select {PROBE_ID}, 0, 'user', '{PROBE_TEXT}' union all select {PROBE_ID}, 1, 'assistant', '{PROBE_TEXT}'),
t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from c),
e as (select *, length(regexp_replace(text, '{_ESCAPE_SQL}', '\1\\\2\3', 'g')) + case role when 'assistant' then 7 when 'user' then 15
  else 26 + length(regexp_replace(role, '{_ESCAPE_SQL}', '\1\\\2\3', 'g')) end as size from t)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
  coalesce(cast(sum(length(text)) filter (role = 'assistant') as bigint), 0) as loss_chars, sha256(coalesce(string_agg(text, '' order by turn) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(size) as bigint) as formatted_chars
from e group by conv_id
"""
