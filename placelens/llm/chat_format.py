"""Chat formatting with a template that is treated as a black box.

A template turns a list of turns into one string. The operator renders the prefixes of a conversation
one after the other and compares consecutive outputs: what a prefix adds to the one before it is the
span of its last turn. A template that changes what it had written before rewrites history; that is
detected at the first such turn, and the conversation gets no spans.

Within a turn's span, the content stands between what the template writes before and after a mark that
is rendered in place of the text; the loss mask covers the content of assistant turns, and the text is
read back from the formatted string alone.

Every prefix is rendered from the first turn on, which takes work quadratic in the length of a
conversation. A template that declares itself local (``local``: what it writes for a turn depends on that
turn and no other, or on nothing before the given window) is rendered from a window of turns that moves on
by half, so that work stays linear; each time it moves, the turns in both windows must get the same
spans, else the declaration was wrong and the conversation counts as rewriting.

Rows stream through a task sorted by conversation and turn; a task holds one conversation (of a local
template one window of turns) and, for
``format_conversations``, what one conversation formats to.

Defined results: null roles and texts are empty; rows of a null conversation id form one conversation;
turns are ordered by turn, then role, then text (nulls first); an empty table gives none.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

START, END = "<|im_start|>", "<|im_end|>"
WINDOW = 64  # turns, for local templates


def local(template: Template) -> Template:
    """Declare that what a template writes for a turn never depends on turns further back than a window."""
    template.local = True
    return template


#: No text, once escaped, has "<|" in it: every "<" gets a mark behind it, and marks are doubled.
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "<\\-")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\" if m[1] == "\\" else "", text)


@local
def chatml(turns: list[Turn]) -> str:
    """Each turn between its marks; a role ends at the first newline, so its own are escaped."""
    return "".join(
        f"{START}{escape(role).replace(chr(10), chr(92) + 'n')}\n{escape(text)}{END}\n" for role, text in turns
    )


_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.DOTALL)


def _unescape_role(role: str) -> str:
    return _ESCAPED.sub(lambda m: {"\\": "\\", "n": "\n"}.get(m[1], ""), role)


def parse_chatml(formatted: str) -> list[Turn]:
    return [(_unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


class HistoryRewritten(ValueError):
    """The template changed text that an earlier prefix had already rendered."""


def turn_spans(turns: Iterator[Turn], template: Template, window: int | None = None) -> Iterator[tuple[Turn, str, int, int]]:
    """For each turn: the turn, the string it adds, and where its content starts and ends in that. Without
    a ``window``, local templates take ``WINDOW`` and all others are rendered from the first turn on."""
    if window is None and getattr(template, "local", False):
        window = WINDOW
    held: list[Turn] = []
    spans: list[str] = []
    rendered = template([])
    for turn in turns:
        if window is not None and len(held) >= window:
            held, old = held[window // 2:], spans[window // 2:]
            rendered, spans = template([]), []
            for k in range(len(held)):
                longer = template(held[: k + 1])
                if not longer.startswith(rendered) or longer[len(rendered):] != old[k]:
                    raise HistoryRewritten
                spans.append(longer[len(rendered):])
                rendered = longer
        held.append(turn)
        longer = template(held)
        if not longer.startswith(rendered):
            raise HistoryRewritten
        span = longer[len(rendered):]
        mark = _mark_for(turn)
        marked = template([*held[:-1], (turn[0], mark)])
        if not marked.startswith(rendered):
            raise HistoryRewritten
        start, end = _content(span, marked[len(rendered):], mark)
        yield turn, span, start, end
        spans.append(span)
        rendered = longer


def _mark_for(turn: Turn) -> str:
    """A private-use character that the turn does not hold."""
    return next(c for c in map(chr, range(0xE000, 0xF900)) if c not in turn[0] and c not in turn[1])


def _content(span: str, marked: str, mark: str) -> tuple[int, int]:
    """Where the content is, from the span of the same turn with the mark as its text."""
    head = marked.find(mark)
    tail = marked[head + 1:]
    if head < 0 or mark in tail or len(span) < head + len(tail):
        raise HistoryRewritten
    if not (span.startswith(marked[:head]) and span.endswith(tail)):
        raise HistoryRewritten
    return head, len(span) - len(tail)


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[Turn]]]:
    """Conversations one after the other; the turns of one must be used up before the next."""
    rows = (
        row
        for batch in batches
        for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True)
    )
    ahead = next(rows, None)

    def one(conv_id) -> Iterator[Turn]:
        nonlocal ahead
        while ahead is not None and ahead[0] == conv_id:
            turn = (ahead[1] or "", ahead[2] or "")
            ahead = next(rows, None)
            yield turn

    while ahead is not None:
        conv_id = ahead[0]
        turns = one(conv_id)
        yield conv_id, turns
        for _ in turns:
            pass


def _sorted(conversations: DataFrame) -> DataFrame:
    ship(conversations.sparkSession)
    return (
        conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
        .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")
    )


def _batched(rows: Iterator[dict], schema: pa.Schema, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += 400 + 4 * row["formatted_chars"]
        if size > limit:
            yield pa.RecordBatch.from_pylist(out, schema)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


_SPAN = pa.struct([("role", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_FORMATTED = pa.schema([
    ("conv_id", pa.int64()), ("formatted", pa.string()), ("formatted_chars", pa.int64()),
    ("spans", pa.list_(_SPAN)), ("loss_spans", pa.list_(_SPAN)), ("rewrites", pa.bool_()),
])
_FORMATTED_DDL = (
    "conv_id long, formatted string, formatted_chars long, spans array<struct<role:string,start:long,end:long>>, "
    "loss_spans array<struct<role:string,start:long,end:long>>, rewrites boolean"
)


def _format(template: Template, learn: str, window: int | None):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for conv_id, turns in _turns(batches):
            parts, spans, loss, at = [template([])], [], [], 0
            at = len(parts[0])
            try:
                for (role, _), span, start, end in turn_spans(turns, template, window):
                    spans.append({"role": role, "start": at, "end": at + len(span)})
                    if role == learn:
                        loss.append({"role": role, "start": at + start, "end": at + end})
                    parts.append(span)
                    at += len(span)
                formatted, rewrites = "".join(parts), False
            except HistoryRewritten:
                formatted, rewrites, spans, loss = None, True, [], []
            yield {"conv_id": conv_id, "formatted": formatted, "formatted_chars": len(formatted or ""),
                   "spans": spans, "loss_spans": loss, "rewrites": rewrites}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batched(rows(batches), _FORMATTED)

    return run


def format_conversations(
    conversations: DataFrame, template: Template = chatml, learn: str = "assistant", window: int | None = None
) -> DataFrame:
    """One row per conversation: the formatted string (null if the template rewrites history), the span
    of each turn, and the spans under the loss mask."""
    return _sorted(conversations).mapInArrow(_format(template, learn, window), _FORMATTED_DDL)


_DIGEST = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
    ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[dict]:
        for batch in batches:
            for row in batch.to_pylist():
                turns, loss = hashlib.sha256(), hashlib.sha256()
                formatted, n, chars = row["formatted"], 0, 0
                for role, text in parse_chatml(formatted):
                    turns.update(f"{role}\n{text}\n".encode())
                    n += 1
                for span in row["loss_spans"]:
                    text = unescape(formatted[span["start"]:span["end"]])
                    loss.update(text.encode())
                    chars += len(text)
                yield {"conv_id": row["conv_id"], "n_turns": n, "turns_sha256": turns.hexdigest(),
                       "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": row["formatted_chars"]}

    return _batched(rows(), _DIGEST)


def chatml_digests(conversations: DataFrame) -> DataFrame:
    """What is read back from the formatted strings: turns, and the text under the loss mask."""
    formatted = format_conversations(conversations)
    return formatted.mapInArrow(
        _digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
