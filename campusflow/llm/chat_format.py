"""Chat formatting with a template that is only called, never read.

Successive prefixes of a conversation are rendered and compared: what a turn adds to the output is its span,
and a template that changes earlier output is reported.  Where a turn's text lies inside its span is found by
rendering it with two probe texts: what both renderings share frames the text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = dict[str, str]
Template = Callable[[list[Turn]], str]

# Rendering every prefix costs the square of the turns.  For a template that its caller declares turn-local, the
# oldest half is dropped beyond this many, as long as the others are rendered the same without them.
WINDOW = 64
PROBES = ("0", "1")
FORMATTED = (
    "conv_id long, turn long, place long, role string, text string, start long, end long, piece string, "
    "text_start long, text_end long, trained boolean, rewrites boolean"
)


def _shared(a: str, b: str) -> int:
    """How long a beginning the two have in common, by halving."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class _Conversation:
    """The rendering of one conversation so far; ``before`` counts the code points of turns let go."""

    def __init__(self, template: Template, window: int, turn_local: bool) -> None:
        self.template, self.window = template, window
        self.turns: list[Turn] = []
        self.output = ""
        self.before = 0
        self.local = turn_local

    def add(self, role: str, text: str) -> dict:
        prefix = [*self.turns]
        self.turns.append({"role": role, "text": text})
        output = self.template(self.turns)
        start = _shared(self.output, output)
        rewrites = start < len(self.output)
        first, second = (self.template([*prefix, {"role": role, "text": probe}]) for probe in PROBES)
        at = _shared(first, second)
        tail = len(first) - at - len(PROBES[0])
        framed = tail >= 0 and at + tail <= len(output) and output.startswith(first[:at])
        framed = framed and output.endswith(first[len(first) - tail :])
        span = {
            "start": self.before + start,
            "end": self.before + len(output),
            "piece": output[start:],
            "text_start": self.before + at if framed else None,
            "text_end": self.before + len(output) - tail if framed else None,
            "rewrites": rewrites,
        }
        self.output = output
        if self.local and len(self.turns) > self.window:
            self._let_go()
        return span

    def _let_go(self) -> None:
        """Drop the older half if what remains is rendered as before, seen from the turn after the cut."""
        cut = len(self.turns) // 2
        kept = self.turns[cut:]
        old, lead = self.template(self.turns[: cut + 1]), self.template(kept[:1])
        new = self.template(kept)
        self.local = self.output.startswith(old) and new.startswith(lead) and self.output[len(old) :] == new[len(lead) :]
        if self.local:
            self.before += len(self.output) - len(new)
            self.turns, self.output = kept, new


def format_turns(
    rows: Iterable[dict], template: Template, train: tuple[str, ...], window: int = WINDOW, turn_local: bool = False
) -> Iterator[dict]:
    """The spans of each turn, from rows in the order of conversation and turn."""
    current, place, now = None, 0, None
    for row in rows:
        if now is None or row["conv_id"] != current:
            current, place, now = row["conv_id"], 0, _Conversation(template, window, turn_local)
        role, text = row["role"] or "", row["text"] or ""
        span = now.add(role, text)
        given = {"conv_id": row["conv_id"], "turn": row["turn"], "role": role, "text": text}
        yield given | span | {"place": place, "trained": role in train}
        place += 1


def arrow_schema(frame_schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in frame_schema.split(","))])


def in_batches(rows: Iterator[dict], schema: pa.Schema, size: int = 512) -> Iterator[pa.RecordBatch]:
    batch = []
    for row in rows:
        batch.append(row)
        if len(batch) == size:
            yield pa.RecordBatch.from_pylist(batch, schema)
            batch = []
    if batch:
        yield pa.RecordBatch.from_pylist(batch, schema)


def format_conversations(
    conversations: DataFrame,
    template: Template,
    train: tuple[str, ...] = ("assistant",),
    window: int = WINDOW,
    turn_local: bool = False,
) -> DataFrame:
    """One row per turn: its span and text span in the conversation's output, its piece of output, its loss flag.

    ``conversations`` has ``conv_id``, ``turn``, ``role`` and ``text``; other columns are not carried.  Turns go
    by ``turn`` (NULL first), ties by role and text; repeated rows are turns of their own.  A NULL role or text
    is empty, and rows without ``conv_id`` form one conversation.  Places are code points.  ``rewrites`` marks a
    turn whose rendering changed earlier output (``start`` is then the first changed place); ``text_start`` and
    ``text_end`` are NULL if the template changes the text so that its frame cannot be told.  The rows of a
    conversation stay together and in order within a partition.

    Every prefix is rendered whole, which costs the square of a conversation's turns, and a task holds one conversation.
    ``turn_local`` declares that the template renders a turn the same whatever the number of the others; a task then
    streams its turns and holds at most ``window`` of them, as long as a comparison bears the declaration out.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"),
    )
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = arrow_schema(FORMATTED)

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (row for batch in batches for row in batch.to_pylist())
        return in_batches(format_turns(each, template, train, window, turn_local), schema)

    return ordered.mapInArrow(formatted, FORMATTED)


# The template of the checked query.  Fixed values: its marks.  No mark can occur inside an escaped text.
TURN_OPEN, ROLE_CLOSE, TURN_CLOSE = "[INST]", "[/INST]", "</s>"
_ESCAPES = {"\\": "\\\\", "<": "\\l", ">": "\\g", "[": "\\o", "]": "\\c"}
_PLAIN = {v: k for k, v in _ESCAPES.items()}


def escape(text: str) -> str:
    return text.translate(str.maketrans(_ESCAPES))


def unescape(text: str) -> str:
    parts, at = [], 0
    while (found := text.find("\\", at)) >= 0:
        parts += [text[at:found], _PLAIN[text[found : found + 2]]]
        at = found + 2
    return "".join(parts) + text[at:]


def marked_template(turns: list[Turn]) -> str:
    """``[INST]role[/INST]text</s>`` for each turn, with role and text escaped."""
    return "".join(f"{TURN_OPEN}{escape(t['role'])}{ROLE_CLOSE}{escape(t['text'])}{TURN_CLOSE}" for t in turns)


def read_marked(piece: str) -> tuple[str, str]:
    """Role and text of one turn of the template's output."""
    role, text = piece.removeprefix(TURN_OPEN).removesuffix(TURN_CLOSE).split(ROLE_CLOSE, 1)
    return unescape(role), unescape(text)
