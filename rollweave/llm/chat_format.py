"""Conversations in one marked text, with the spans that a loss is taken on, and the way back.

Turns come from ``chat_layouts``. A template marks each turn; inside texts a control string gets one backslash more after its
first letter, which reading takes away again, so a text can say anything. Formatted conversations are written in segments of
about a million characters, and a conversation is sorted by its turns on disk, never held: a segment is the most a task has in
memory, whatever the conversation's size. Conversations are dealt out by ranges of (conv_id, turn), so a long one is formatted by
several tasks. Only the digests of a whole conversation, which are sequential by nature, are one task's stream over its segments.

Defined results: turns are in order of turn (NULL first), place in their record, role and text; repeated rows are turns of their
own; a missing text or role is an empty one; rows without a conv_id are one conversation; roles other than user, assistant and
system are written by name; a table without rows gives no rows; columns that no layout names are not looked at, whatever
their names; records of no known layout are told apart by ``chat_layouts.fingerprinted``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollweave.llm import chat_layouts
from rollweave.llm.common import bounded_batches, rows_of, saved

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]")
TEMPLATE = {"user": ("<s>[INST] ", " [/INST]"), "assistant": (" ", " </s>"), "system": ("<<SYS>>\n", "\n<</SYS>>\n\n")}
OTHER = ("[ROLE]", "[/ROLE] ", " </s>")
SEGMENT_CHARS = 1 << 20

_RESTS = "|".join(re.escape(c[1:]) for c in sorted(CONTROLS, key=len, reverse=True))
_PLAIN = re.compile(rf"([<\[])(\\*)({_RESTS})")
_ESCAPED = re.compile(rf"([<\[])\\(\\*)({_RESTS})")


def _turn_pattern() -> re.Pattern:
    marked = [f"{re.escape(a)}(?P<{role}>.*?){re.escape(b)}" for role, (a, b) in TEMPLATE.items()]
    marked.append(f"{re.escape(OTHER[0])}(?P<name>.*?){re.escape(OTHER[1])}(?P<other>.*?){re.escape(OTHER[2])}")
    return re.compile("|".join(marked), re.S)


_TURN = _turn_pattern()


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def marked(role: str, text: str) -> tuple[str, int, int]:
    """A turn in its marks, and where its text begins and ends there."""
    said = escape(text)
    if role in TEMPLATE:
        before, after = TEMPLATE[role]
    else:
        before, after = OTHER[0] + escape(role) + OTHER[1], OTHER[2]
    return before + said + after, len(before), len(before) + len(said)


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """Role and text of every turn of a formatted segment."""
    at = 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if found is None:
            raise ValueError(f"no turn begins at character {at}")
        at = found.end()
        if found.group("other") is not None:
            yield unescape(found.group("name")), unescape(found.group("other"))
        else:
            yield found.lastgroup, unescape(found.group(found.lastgroup))


SEGMENTS = "conv_id long, first_turn long, segment long, formatted string, loss array<struct<start int, end int>>"
_SEGMENTS = pa.schema([("conv_id", pa.int64()), ("first_turn", pa.int64()), ("segment", pa.int64()), ("formatted", pa.string()),
                       ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, first_turn, segment, formatted, loss: segments of a conversation in order of first_turn and segment.

    loss: the spans of ``formatted``, in code points, that assistants said.
    """
    bounded_batches(turns.sparkSession)
    order = ["conv_id", "turn", "place", "role", "text"]
    dealt = turns.select(*order).repartitionByRange("conv_id", "turn").sortWithinPartitions(*order)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, conv, first, texts, size, loss, done = 0, None, None, [], 0, [], []

        def close() -> None:
            nonlocal number, texts, size, loss
            if texts:
                done.append((conv, first, number, "".join(texts), loss))
                number += 1
            texts, size, loss = [], 0, []

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), _SEGMENTS, strict=True)], schema=_SEGMENTS)
            done.clear()
            return out

        for convs, turn, roles, said in rows_of(batches, "conv_id", "turn", "role", "text"):
            for c, t, role, text in zip(convs, turn, roles, said, strict=True):
                if c != conv or size >= SEGMENT_CHARS:
                    close()
                    conv, first = c, t
                piece, start, end = marked(role, text)
                if role == "assistant":
                    loss.append({"start": size + start, "end": size + end})
                texts.append(piece)
                size += len(piece)
            if done:
                yield flush()
        close()
        if done:
            yield flush()

    return dealt.mapInArrow(segments, SEGMENTS)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                      ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def digests(segments: DataFrame) -> DataFrame:
    """What formatted segments say, read back from them: turns, and the text under the loss spans."""
    bounded_batches(segments.sparkSession)
    dealt = segments.repartition("conv_id").sortWithinPartitions("conv_id", "first_turn", "segment")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, done = None, []

        def close() -> None:
            if open_ is not None:
                conv, n, turns, chars, loss, size = open_
                done.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size))

        for convs, formatted, spans in rows_of(batches, "conv_id", "formatted", "loss"):
            for conv, text, loss in zip(convs, formatted, spans, strict=True):
                if open_ is None or open_[0] != conv:
                    close()
                    open_ = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in read_turns(text):
                    open_[1] += 1
                    open_[2].update(f"{role}\n{said}\n".encode())
                for span in loss:
                    said = unescape(text[span["start"] : span["end"]])
                    open_[3] += len(said)
                    open_[4].update(said.encode())
                open_[5] += len(text)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), _DIGESTS, strict=True)], schema=_DIGESTS)
                done.clear()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), _DIGESTS, strict=True)], schema=_DIGESTS)

    return dealt.mapInArrow(told, DIGESTS)


def format_conversations(tables: list[DataFrame], records: DataFrame | None = None, column: str = "record") -> DataFrame:
    """The formatted segments, as a saved table, of typed tables and JSON records of any known layouts."""
    turns = [chat_layouts.table_turns(t) for t in tables]
    if records is not None:
        turns.append(chat_layouts.record_turns(chat_layouts.fingerprinted(records, column)))
    every = turns[0]
    for more in turns[1:]:
        every = every.unionByName(more)
    return saved(format_turns(every), "chat")
