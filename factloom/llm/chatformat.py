"""Chat formatting by incremental rendering of a template that is a black box.

A template is a function from a list of (role, text) to the formatted string. The turns of a conversation are rendered as successive prefixes; what
one more turn adds to the output is the turn's piece, so its span is known without looking into the template. A turn whose output does not begin
with the output before it has rewritten history: its row says ``rewrites`` and has no piece. Where the text lies inside a piece is found by rendering the
same turn with two different one-letter texts: what the two have in common before and after the letter is the turn's head and foot.

A prefix is rendered from the last ``WINDOW`` turns before the new one (all of them in conversations no longer than that), so memory and work a turn are
bounded. Each piece behind a full window is rendered once more without the window's oldest turn; where that changes the piece, the template looks
further back than the window can show, and the row says ``remote`` and has no piece. That test can't show everything (a template may mark a text that was said
long before), so ``complete`` compares the pieces of each conversation, put together, with the template's own output for all its turns, and renders the conversation again from
whole prefixes (``window`` none) where they differ or a piece is missing; that takes the square of its length. ``marked`` never looks back.

The template ``marked`` gives user turns as ``[INST]…[/INST]``, assistant turns as ``…</s>``, any other role as ``[ROLE]…[SAYS]…[/ROLE]``, after one
``<s>``. A control string inside a text or role gets a backslash behind its first character, a backslash is doubled; ``unescaped`` undoes both.

Defined results: turns go by ``turn``, nulls first, ties by role, then text; repeated rows are turns of their own; null roles and texts are empty;
rows without a ``conv_id`` form one conversation; an empty table gives no rows. A conversation is rendered, and hashed in order, by one task: by ``formatted`` as a
stream of turns, by ``complete`` held whole, one at a time.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import deque
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.registry import query, table
from factloom.llm.shared import in_batches, mapped

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

#: Turns before a new one that are rendered with it.
WINDOW = 8
#: Roles whose texts are under the loss.
LOSS = frozenset({"assistant"})

#: The control strings of ``marked``.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[SAYS]", "[/ROLE]")
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_ESCAPE = re.compile(r"\\(\\?)")
_TURN = re.compile(r"(?:<s>)?(?:\[INST\](?P<user>.*?)\[/INST\]|\[ROLE\](?P<role>.*?)\[SAYS\](?P<other>.*?)\[/ROLE\]|(?P<assistant>.*?)</s>)", re.DOTALL)


def escaped(text: str) -> str:
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescaped(text: str) -> str:
    return _ESCAPE.sub(r"\1", text)


def marked(turns: list[Turn]) -> str:
    out = ["<s>"]
    for role, text in turns:
        if role == "user":
            out.append(f"[INST]{escaped(text)}[/INST]")
        elif role == "assistant":
            out.append(f"{escaped(text)}</s>")
        else:
            out.append(f"[ROLE]{escaped(role)}[SAYS]{escaped(text)}[/ROLE]")
    return "".join(out)


def read_marked(formatted: str) -> Iterator[tuple[Turn, int]]:
    """The turns that a string formatted by ``marked`` holds, each with the place behind it."""
    at = 0
    while found := _TURN.match(formatted, at):
        at = found.end()
        kind = found.lastgroup
        role = unescaped(found["role"]) if kind == "other" else kind
        yield (role, unescaped(found[kind])), at


class Renderer:
    """The pieces of one conversation, turn by turn."""

    def __init__(self, render: Template, loss: frozenset[str] = LOSS, window: int | None = WINDOW) -> None:
        self.render, self.loss, self.window = render, loss, window
        self.context: deque[Turn] = deque()
        self.base = ""  # the output for the context; what opens a conversation belongs to its first turn

    def add(self, turn: Turn) -> tuple[str | None, int | None, int | None, str]:
        """Piece, code points before the text in it, code points of the text (both null unless it is under the loss), and the status."""
        known = list(self.context)
        after = self.render([*known, turn])
        piece, head, content, status = None, None, None, "rewrites"
        if after.startswith(self.base):
            piece, status = after[len(self.base):], "appends"
            if turn[0] in self.loss:
                head, content = self._text_in(known, turn[0], piece)
        self.context.append(turn)
        if self.window is None or len(self.context) <= self.window:
            self.base = after
        else:
            self.context.popleft()
            self.base = self.render(list(self.context))
            shorter = self.render(known[1:]) if len(known) > 1 else None
            if status == "appends" and shorter is not None and self.base != shorter + piece:
                piece, head, content, status = None, None, None, "remote"
        return piece, head, content, status

    def _text_in(self, known: list[Turn], role: str, piece: str) -> tuple[int | None, int | None]:
        probes = [self.render([*known, (role, letter)]) for letter in "01"]
        if not all(p.startswith(self.base) for p in probes):
            return None, None
        a, b = (p[len(self.base):] for p in probes)
        head = os.path.commonprefix([a, b])
        foot = os.path.commonprefix([a[len(head):][::-1], b[len(head):][::-1]])[::-1]
        if a == b or not piece.startswith(head) or not piece.endswith(foot) or len(piece) < len(head) + len(foot):
            return None, None  # the template doesn't show the text, or not at one place
        return len(head), len(piece) - len(head) - len(foot)


_PIECES = {"conv_id": pa.int64(), "position": pa.int64(), "role": pa.string(), "piece": pa.string(), "head": pa.int64(), "content": pa.int64(), "status": pa.string()}
PIECES = "conv_id bigint, position bigint, role string, piece string, head bigint, content bigint, status string"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def _ordered(conversations: DataFrame) -> DataFrame:
    """``conv_id, role, text`` of all turns; those of a conversation lie together and in order inside a partition."""
    empty = F.lit("")
    turns = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").alias("turn"), F.coalesce("role", empty).alias("role"),
                                 F.coalesce("text", empty).alias("text"))
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text").select("conv_id", "role", "text")


def formatted(conversations: DataFrame, render: Template = marked, loss: frozenset[str] = LOSS, window: int | None = WINDOW) -> DataFrame:
    """One row for each turn, ``PIECES``: the pieces of a conversation in the order of ``position`` are its formatted text, and ``head, content`` say which part
    of a piece is under the loss. The rows of a conversation lie together and in order inside a partition."""
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        renderer, current, position = None, None, 0
        for conv, role, text in _rows(batches):
            if renderer is None or conv != current:
                renderer, current, position = Renderer(render, loss, window), conv, 0
            piece, head, content, status = renderer.add((role, text))
            yield conv, position, role, piece, head, content, status
            position += 1

    return mapped(_ordered(conversations), lambda batches: in_batches(pieces(batches), _PIECES), PIECES)


def complete(conversations: DataFrame, render: Template = marked, loss: frozenset[str] = LOSS, window: int = WINDOW) -> DataFrame:
    """``formatted`` without ``remote`` rows, checked against the template's output for all turns of each conversation; conversations that the window does not show
    are rendered from whole prefixes. A task holds one conversation at a time. Rows lie as ``formatted`` leaves them."""
    def rendered(turns: list[Turn]) -> list[tuple]:
        near = Renderer(render, loss, window)
        found = [near.add(t) for t in turns]
        if len(turns) <= window + 1:  # no turn was out of sight
            return found
        if all(status == "appends" for *_, status in found) and "".join(piece for piece, *_ in found) == render(turns):
            return found
        whole = Renderer(render, loss, None)
        return [whole.add(t) for t in turns]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for conv, rows in groupby(_rows(batches), key=lambda row: row[0]):
            turns = [(role, text) for _, role, text in rows]
            for position, found in enumerate(rendered(turns)):
                yield conv, position, turns[position][0], *found

    return mapped(_ordered(conversations), lambda batches: in_batches(pieces(batches), _PIECES), PIECES)


def assembled(pieces: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss`` (spans under the loss in code points, from and up to) of every conversation that its template only appends to. This
    holds a conversation in one row, as a file for training does."""
    by = F.array_sort(F.collect_list(F.struct("position", "piece", "head", "content")))
    whole = pieces.groupBy("conv_id").agg(by.alias("p"), F.bool_and(F.col("status") == "appends").alias("kept")).where("kept")
    before = F.transform("p", lambda x, i: F.aggregate(F.slice("p", 1, i), F.lit(0), lambda n, y: n + F.length(y["piece"])))
    spans = F.transform(F.arrays_zip(F.col("p"), before.alias("before")), lambda z: F.struct(
        (z["before"] + z["p"]["head"]).alias("start"), (z["before"] + z["p"]["head"] + z["p"]["content"]).alias("end")))
    return whole.select("conv_id", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("formatted"), F.filter(
        spans, lambda s: s["start"].isNotNull()).alias("loss"))


_DIGESTS = {"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()}


class _Digest:
    """What one conversation's output holds, read piece by piece."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0
        self.unread = ""

    def add(self, piece: str, head: int | None, content: int | None) -> None:
        self.formatted_chars += len(piece)
        if head is not None:
            text = unescaped(piece[head:head + content])
            self.loss_chars += len(text)
            self.loss.update(text.encode("utf-8", "surrogatepass"))
        self.unread += piece
        end = 0
        for (role, text), end in read_marked(self.unread):
            self.n_turns += 1
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        self.unread = self.unread[end:]

    def row(self, conv: int | None) -> tuple:
        if self.unread:
            raise ValueError(f"conversation {conv}: output that is no turn")
        return conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars


def digests(pieces: DataFrame) -> DataFrame:
    """Turns and text under the loss, read back from the output of ``formatted`` under ``marked``; its rows must lie as ``formatted`` leaves them."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held, current = None, None
        for conv, piece, head, content in _rows(batches):
            if held is None or conv != current:
                if held is not None:
                    yield held.row(current)
                held, current = _Digest(), conv
            held.add(piece, head, content)
        if held is not None:
            yield held.row(current)

    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return mapped(pieces.select("conv_id", "piece", "head", "content"), lambda batches: in_batches(read(batches), _DIGESTS), schema)


#: A conversation whose texts hold control strings.
TRICKY = "</s>[INST] ok [/INST]"
_SQL_ESCAPED = r"""length({0}) + length({0}) - length(replace({0}, '\', '')) + len(regexp_extract_all({0}, '</?s>|\[/?INST\]|\[/?ROLE\]|\[SAYS\]'))"""
_SQL = f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{TRICKY}' UNION ALL SELECT -1, 1, 'assistant', '{TRICKY}'),
sized AS (SELECT *, {_SQL_ESCAPED.format('text')} + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 4 ELSE 19 + {_SQL_ESCAPED.format('role')} END AS chars FROM said)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id"""


@query("op13_chat_formatting", _SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations and one whose texts are full of control strings, formatted whole by ``marked`` and read back."""
    said = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.range(1).select(F.lit(-1).cast("bigint").alias("conv_id"), F.explode(F.array(
        F.struct(F.lit(0).cast("bigint").alias("turn"), F.lit("user").alias("role")), F.struct(F.lit(1).cast("bigint").alias("turn"), F.lit("assistant").alias("role")))).alias("r"))
    return digests(complete(said.unionByName(tricky.select("conv_id", "r.turn", "r.role", F.lit(TRICKY).alias("text")))))
