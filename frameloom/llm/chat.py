"""Chat formatting that is checked by a grammar round trip.

A template renders each turn with the marks of its role; a deterministic parser reads
the rendered text back by the same marks and rejects a mark within a text. A turn's text
is rendered as it is and read back; only if it is rejected or the turn that comes back
differs is the text escaped, and the check is made again until both agree. Escaping puts one backslash more into whatever looks like
a mark, behind its first character (`</s>` becomes `<\\/s>`, `<\\/s>` becomes
`<\\\\/s>`), and the parser takes one away from each, so nothing is lost.

The loss mask covers what assistants say, without marks and escapes. A conversation's
turns are ordered by turn, then role and text, nulls first; equal rows are turns of
their own. They pass through a task one by one, so that its memory does not grow with
a conversation. Null roles and texts count as empty, a null conversation is one as
well, and an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What is written before and after a turn of these roles (fixed values of the template).
MARKS = {
    "system": ("<<SYS>>\n", "\n<</SYS>>\n"),
    "user": ("[INST] ", " [/INST]"),
    "assistant": ("<s>", "</s>"),
}
#: Any other role is named in its first mark, percent-encoded.
OTHER_OPEN, OTHER_NAMED, OTHER_CLOSE = "<<ROLE ", ">>", "<</ROLE>>"
#: Strings that the parser may take for marks, with any number of backslashes in them.
CONTROL = re.compile(r"([<\[])(\\*)(/?INST\]|/?s>|</?SYS>>|<ROLE |</ROLE>>)")
RAW = re.compile(r"[<\[](?:/?INST\]|/?s>|</?SYS>>|<ROLE |</ROLE>>)")
ESCAPED = re.compile(r"([<\[])\\(\\*)(/?INST\]|/?s>|</?SYS>>|<ROLE |</ROLE>>)")
#: A turn is rendered at most so often: as it is, then escaped.
TRIES = 3


def escape(text: str) -> str:
    return CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2\3", text)


def _marks(role: str) -> tuple[str, str]:
    if role in MARKS:
        return MARKS[role]
    name = "".join(c if c.isascii() and c.isalnum() else "".join(f"%{b:02x}" for b in c.encode()) for c in role)
    return OTHER_OPEN + name + OTHER_NAMED, OTHER_CLOSE


def _role(name: str) -> str:
    data = re.sub(rb"%([0-9a-f]{2})", lambda m: bytes([int(m[1], 16)]), name.encode())
    return data.decode()


@dataclass(frozen=True)
class Turn:
    role: str
    text: str
    #: Where the text, escaped as it may be, stands in what was parsed.
    start: int
    end: int


def parse(rendered: str) -> list[Turn] | None:
    """The turns of a rendered text, or None if it does not follow the grammar."""
    turns, at = [], 0
    while at < len(rendered):
        for role, (before, after) in MARKS.items():  # noqa: B007
            if rendered.startswith(before, at):
                start = at + len(before)
                break
        else:
            named = rendered.find(OTHER_NAMED, at)
            if not rendered.startswith(OTHER_OPEN, at) or named < 0:
                return None
            role, after = _role(rendered[at + len(OTHER_OPEN) : named]), OTHER_CLOSE
            start = named + len(OTHER_NAMED)
        end = rendered.find(after, start)
        if end < 0 or RAW.search(rendered, start, end):
            return None
        turns.append(Turn(role, unescape(rendered[start:end]), start, end))
        at = end + len(after)
    return turns


def render(role: str, text: str) -> tuple[str, Turn]:
    """A turn in the template's form, and the turn that the parser reads from it."""
    before, after = _marks(role)
    written = text
    for _ in range(TRIES):
        rendered = before + written + after
        turns = parse(rendered)
        if turns is not None and len(turns) == 1 and (turns[0].role, turns[0].text) == (role, text):
            return rendered, turns[0]
        written = escape(text)
    raise ValueError("a turn does not survive formatting")


def ordered_turns(conversations: DataFrame, conversation="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """`conv_id`, `role` and `text`, a conversation's turns in order within one partition."""
    rows = conversations.select(
        F.col(conversation).cast("bigint").alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def format_turns(turns: DataFrame) -> DataFrame:
    """Of each ordered turn: `formatted`, the span of its text there in code points, the
    role and text that were read back, and whether it is under the loss mask.

    The formatted conversation is its turns' `formatted` in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [
                render(role, text)
                for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)
            ]
            columns = [
                batch.column("conv_id"),
                pa.array([rendered for rendered, _ in done], pa.string()),
                pa.array([turn.start for _, turn in done], pa.int32()),
                pa.array([turn.end for _, turn in done], pa.int32()),
                pa.array([turn.role for _, turn in done], pa.string()),
                pa.array([turn.text for _, turn in done], pa.string()),
                pa.array([turn.role == "assistant" for _, turn in done], pa.bool_()),
            ]
            names = ["conv_id", "formatted", "start", "end", "role", "text", "in_loss"]
            yield pa.RecordBatch.from_arrays(columns, names)

    kinds = 'conv_id bigint, formatted string, start int, `end` int, role string, text string, in_loss boolean'
    return turns.mapInArrow(run, kinds)


def digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation of `format_turns`, from what was read back."""

    class Sums:
        def __init__(self, conversation: int | None):
            self.conversation, self.turns, self.loss_chars, self.chars = conversation, 0, 0, 0
            self.all, self.loss = sha256(), sha256()

        def add(self, formatted: str, role: str, text: str, in_loss: bool) -> None:
            self.turns += 1
            self.chars += len(formatted)
            self.all.update(f"{role}\n{text}\n".encode())
            if in_loss:
                self.loss_chars += len(text)
                self.loss.update(text.encode())

        def row(self) -> tuple:
            return self.conversation, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars

    kinds = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string())]
    kinds += [("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, k[1]) for c, k in zip(columns, kinds, strict=True)], [k[0] for k in kinds])

        now = None
        for batch in batches:
            done = []
            for conversation, *turn in zip(*[batch.column(n).to_pylist() for n in ("conv_id", "formatted", "role", "text", "in_loss")], strict=True):
                if now is None or now.conversation != conversation:
                    if now is not None:
                        done.append(now.row())
                    now = Sums(conversation)
                now.add(*turn)
            if done:
                yield out(done)
        if now is not None:
            yield out([now.row()])

    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return formatted.mapInArrow(run, schema)
