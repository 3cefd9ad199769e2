"""Chat formatting by a grammar round trip.

    conversation  "<s>" turn* 
    turn          "[INST" mode " " role "]" text "[/INST]</s>"     mode: "" plain, "+" escaped

Roles are escaped always. A text is first rendered plain; a deterministic parser reads the rendered turn back; where the
recovered turn isn't the source, the text's conflicting content (control strings, and the escape character) is escaped, and the turn is
rendered and parsed again until it is identical. The escape is a backslash before each control string and each backslash.

Turns of a conversation are taken as a stream, in order of turn (ties: by role, then text; nulls first), so a conversation of any size needs
memory for one turn only. The digest is taken of the formatted pieces as they stand in a table, read and put in order again. Defined cases: null text and null role count as empty; a null conv_id is a conversation of its own;
repeated rows are turns of their own; an empty table gives no row; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import Out, rows_of, written

#: The control strings, longest first where one could begin another.
CONTROLS = ("[/INST]", "[INST", "</s>", "<s>")
_CONFLICT = re.compile(r"\\|" + "|".join(re.escape(c) for c in CONTROLS) + "|]")
_IN_TEXT = re.compile(r"\\|" + "|".join(re.escape(c) for c in CONTROLS))
START = "<s>"


def escape(text: str, role: bool = False) -> str:
    return (_CONFLICT if role else _IN_TEXT).sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(?s:(.))", r"\1", text)


def _render(role: str, text: str, escaped: bool) -> str:
    return f"[INST{'+' if escaped else ''} {escape(role, True)}]{escape(text) if escaped else text}[/INST]</s>"


class ParseError(ValueError):
    pass


def parse_turn(s: str, at: int = 0) -> tuple[str, str, tuple[int, int], bool, int]:
    """role, text, (start, end) of the rendered text, whether it is escaped, and where the next turn begins."""
    if not s.startswith("[INST", at):
        raise ParseError("a turn begins with [INST")
    at += 5
    escaped = s.startswith("+", at)
    at += escaped
    if not s.startswith(" ", at):
        raise ParseError("a blank follows the mode")
    at += 1
    start = at
    while at < len(s) and s[at] != "]":
        at += 2 if s[at] == "\\" else 1
    role, begin = unescape(s[start:at]), at + 1
    if at >= len(s):
        raise ParseError("the role doesn't end")
    if escaped:
        at = begin
        for m in re.compile(r"\\(?s:.)|\[/INST\]</s>").finditer(s, begin):
            if m[0][0] == "[":
                return role, unescape(s[begin : m.start()]), (begin, m.start()), True, m.end()
        raise ParseError("the text doesn't end")
    m = _IN_TEXT.search(s, begin)  # a plain text holds no control string and no escape
    if m is None or not s.startswith("[/INST]</s>", m.start()):
        raise ParseError("a plain text ends at the first control string")
    return role, s[begin : m.start()], (begin, m.start()), False, m.start() + len("[/INST]</s>")


def render_turn(role: str, text: str) -> tuple[str, str, str, tuple[int, int]]:
    """The rendered turn, the recovered role and text, and the text's place in it."""
    for escaped in (False, True):
        s = _render(role, text, escaped)
        try:
            got_role, got_text, place, _, end = parse_turn(s)
        except ParseError:
            continue
        if (got_role, got_text, end) == (role, text, len(s)):
            return s, got_role, got_text, place
    raise ParseError("no rendering reads back as its source")


def parse(s: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    if not s.startswith(START):
        raise ParseError("a conversation begins with <s>")
    at, out = len(START), []
    while at < len(s):
        role, text, _, _, at = parse_turn(s, at)
        out.append((role, text))
    return out


def _ordered(conversations: DataFrame) -> DataFrame:
    c = conversations.select("conv_id", F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return c.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def formatted(conversations: DataFrame) -> DataFrame:
    """conv_id, place (of the turn in its conversation, from 0), turn, piece (the rendered turn; the conversation's first one begins with <s>), loss_start, loss_length (code points in
    the piece under the loss mask; null: none). A conversation's pieces, in order, are its formatted text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("turn", pa.int64()), ("piece", pa.string()), ("loss_start", pa.int64()), ("loss_length", pa.int64())]))
        last: object = run
        place = 0
        for conv, turn, role, text in rows_of(batches):
            s, _, _, (a, b) = render_turn(role, text)
            head = START if conv != last else ""
            place = 0 if conv != last else place + 1
            last = conv
            loss = role == "assistant"
            yield from out.add((conv, place, turn, head + s, a + len(head) if loss else None, b - a if loss else None), len(s) + 64)
        yield from out.flush()

    return _ordered(conversations).mapInArrow(run, "conv_id long, place long, turn long, piece string, loss_start long, loss_length long")


def digest(conversations: DataFrame) -> DataFrame:
    """read_back() of the formatted conversations, as they are stored."""
    return read_back(written(formatted(conversations), "chat"))


def read_back(pieces: DataFrame) -> DataFrame:
    """Per conversation, parsed from the pieces of formatted(): conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now = Out(schema), None
        for conv, place, _, piece, loss_start, loss_length in rows_of(batches):
            first = place == 0
            if first != piece.startswith(START):
                raise ParseError("a conversation begins with <s>, once")
            if first:
                if now is not None:
                    yield from out.add(row(now))
                now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, text, (a, b), escaped, end = parse_turn(piece, len(START) if first else 0)
            if end != len(piece) or loss_length is not None and (a, b - a) != (loss_start, loss_length):
                raise ParseError("a piece is one whole turn")
            now[1] += 1
            now[2].update(f"{role}\n{text}\n".encode())
            if loss_length is not None:
                masked = piece[loss_start : loss_start + loss_length]
                masked = unescape(masked) if escaped else masked
                now[3] += len(masked)
                now[4].update(masked.encode())
            now[5] += len(piece)
        if now is not None:
            yield from out.add(row(now))
        yield from out.flush()

    def row(x: list) -> tuple:
        return x[0], x[1], x[2].hexdigest(), x[3], x[4].hexdigest(), x[5]

    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return ordered.select("conv_id", "place", "turn", "piece", "loss_start", "loss_length").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(text) - length(replace(text, '\', '')) + (length(text) - length(replace(text, '[/INST]', ''))) // 7
  + (length(text) - length(replace(text, '[INST', ''))) // 5 + (length(text) - length(replace(text, '</s>', ''))) // 4 + (length(text) - length(replace(text, '<s>', ''))) // 3 AS n,
  length(role) - length(replace(role, '\', '')) + length(role) - length(replace(role, ']', '')) + (length(role) - length(replace(role, '[INST', ''))) // 5
  + (length(role) - length(replace(role, '</s>', ''))) // 4 + (length(role) - length(replace(role, '<s>', ''))) // 3 AS m FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(5 + 1 + length(role) + m + 1 + length(text) + 11 + CASE WHEN n > 0 THEN 1 + n ELSE 0 END))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
