"""Formats conversations with a template that is treated as a black box, and reads turns and loss spans back.

The template is a function from a list of (role, text) to a string. Successive prefixes of a conversation are rendered
and consecutive outputs compared: what the longer output adds is the new turn's span. A template whose longer output
doesn't keep the shorter one (apart from a trailer that moves along) rewrites history; such conversations are flagged and
have no spans. Where the text stands inside a span is found by rendering the turn with two probe texts: what both
outputs share at either end is markup.

Rows are dealt by conversation and sorted by turn. A black box may look at any turn, so every prefix is rendered from the
conversation's first turn on: a task holds one conversation, and its cost grows with the square of its length. What comes
out is cut into segments of SEGMENT turns; joined, they are what the template makes of the whole conversation.

Defined results: null texts and roles are empty; equal turn numbers stand in the order of role, then text; repeated rows
are turns of their own; rows without a conversation id form one conversation. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factmill.llm.scratch import arrow_rows, shuffle_partitions

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

#: Turns of a row that comes out.
SEGMENT = 32

START, END = "<|im_start|>", "<|im_end|>"
_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + "\n", re.DOTALL)


def escape(text: str) -> str:
    """The text without any '<|': a backslash comes between, after those already there."""
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def chat_template(turns: list[Turn]) -> str:
    """Marks each turn's start, role and end. Control strings inside texts and roles are escaped, reversibly."""
    return "".join(f"{START}{_role(role)}\n{escape(text)}{END}\n" for role, text in turns)


def _role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _plain_role(written: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(written))


def read_turns(formatted: str) -> list[Turn]:
    """The turns of a string that chat_template made."""
    return [(_plain_role(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def _common(a: str, b: str) -> int:
    """The length of the longest common beginning."""
    if b.startswith(a):
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Rewrites(ValueError):
    """The template changes what it had rendered for earlier turns."""


def _located(render: Template, before: list[Turn], turns: list[Turn]) -> tuple[str, list[tuple[int, int, int, int]]]:
    """What the template makes of all turns, and the span in it of each of `turns`: start, end, and its text's start and end."""
    out = render([*before])
    spans = []
    done = list(before)
    for role, text in turns:
        longer = render([*done, (role, text)])
        start = _common(out, longer)
        trailer = out[start:]
        if trailer and not longer.endswith(trailer):
            raise Rewrites
        end = len(longer) - len(trailer)
        one, two = (render([*done, (role, probe)]) for probe in ("0", "1"))
        first = _common(one, two)
        last = _common(one[first:][::-1], two[first:][::-1])
        if one == two:  # the template doesn't show this text
            first, last = end, len(trailer)
        if first < start or last < len(trailer):
            raise Rewrites
        spans.append((start, end, first, len(longer) - last))
        done.append((role, text))
        out = longer
    return out, spans


def _moved(spans: list[tuple[int, int, int, int]], base: int) -> list[tuple[int, int, int, int]]:
    return [tuple(x - base for x in s) for s in spans]


def locate(render: Template, before: list[Turn], turns: list[Turn]) -> tuple[str, list[tuple[int, int, int, int]]]:
    """What the template adds for `turns` after `before`, and each turn's span in that."""
    out, spans = _located(render, before, turns)
    return (out[spans[0][0] : spans[-1][1]], _moved(spans, spans[0][0])) if spans else ("", [])


def segments(render: Template, turns: list[Turn]) -> list[tuple[str, list[tuple[int, int, int, int]]]]:
    """The whole conversation's rendering, cut where every SEGMENT-th turn starts, each piece with its turns' spans."""
    out, spans = _located(render, [], turns)
    cuts = [0, *(spans[k][0] for k in range(SEGMENT, len(turns), SEGMENT)), len(out)]
    return [(out[x:y], _moved(spans[k * SEGMENT : (k + 1) * SEGMENT], x)) for k, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]


def format_conversations(conversations: DataFrame, template: Template = chat_template, loss_role: str = "assistant", conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per segment, in order within a conversation: conv_id, segment, the formatted text, each turn's spans in it
    (start, end, text_start, text_end in code points, and whether loss counts on its text), and rewrites. A conversation
    that the template rewrites is one row, whole and without spans.

    Rows of a conversation lie in one partition, segment after segment.
    """
    spark = conversations.sparkSession
    arrow_rows(spark)
    base = conversations.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    )
    dealt = base.repartition(shuffle_partitions(spark), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    kind = base.schema["conv_id"].dataType.simpleString()
    span = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "end", "text_start", "text_end")] + [("loss", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        key, held, none = None, [], True

        def flush() -> None:
            try:
                found, bad = segments(template, held), False
            except Rewrites:
                found, bad = [(template([*held]), [])], True
            for number, (formatted, spans) in enumerate(found):
                mine = held[number * SEGMENT : (number + 1) * SEGMENT]
                rows.append((key, number, formatted, [(*s, r == loss_role) for s, (r, _) in zip(spans, mine, strict=False)], bad))

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            ids, numbers, texts, spans, flags = zip(*found, strict=True)
            listed = [[dict(zip(("start", "end", "text_start", "text_end", "loss"), s, strict=True)) for s in x] for x in spans]
            return pa.RecordBatch.from_arrays([pa.array(ids, type_), pa.array(numbers, pa.int64()), pa.array(texts, pa.string()), pa.array(listed, span), pa.array(flags)], ["conv_id", "segment", "formatted", "spans", "rewrites"])

        type_ = None
        for batch in batches:
            type_ = batch.column(0).type
            for k, r, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if none or k != key:
                    if held:
                        flush()
                    key, held, none = k, [], False
                held.append((r, t))
            if rows:
                yield batch_of(rows)
                rows = []
        if held:
            flush()
            yield batch_of(rows)

    return dealt.mapInArrow(run, f"conv_id {kind}, segment long, formatted string, spans array<struct<start:long,end:long,text_start:long,text_end:long,loss:boolean>>, rewrites boolean")


def read_back(segments: DataFrame) -> DataFrame:
    """Digests of what format_conversations made with chat_template, read from its formatted text, a row per conversation."""
    kind = segments.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, type_, none = None, None, None, True
        for batch in batches:
            type_ = batch.column(0).type
            out = []
            for k, formatted, spans, bad in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if none or k != key:
                    if not none:
                        out.append(_finished(key, state))
                    key, none, state = k, False, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, False]
                for role, text in read_turns(formatted):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                for s in spans:
                    if s["loss"]:
                        text = unescape(formatted[s["text_start"] : s["text_end"]])
                        state[2] += len(text)
                        state[3].update(text.encode())
                state[4] += len(formatted)
                state[5] = state[5] or bad
            if out:
                yield _batch(out, names, type_)
        if not none:
            yield _batch([_finished(key, state)], names, type_)

    return segments.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites boolean")


def _finished(key, state: list) -> tuple:
    return key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5]


def _batch(rows: list[tuple], names: list[str], type_: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(columns[0], type_), *(pa.array(c) for c in columns[1:])], names)
