"""Conversation structure repair: the cheapest edits that give a conversation roles in order, by dynamic programming over ranks.

A conversation's turns, in order, may be kept (0), given another role (Rerole, 2), deleted (3); turns without text may be inserted anywhere (2). Blank and duplicate turns
must go; a truncated one that stays costs 1. The roles' initials have to match `(s?(ua)+)?`. Of the cheapest edits, those whose initials (the audit) come first in ASCII order
are taken.

A layer of the programme is a turn; its states are the grammar's (nothing yet, after s, after u, after a). What leads from layer to layer is a macro edit: a run of inserts, then
what is done to the turn. As each macro ends with its only letter that isn't I, macros form a prefix-free code, and so do sequences of as many macros: of two audits of a layer neither
begins the other. So the order of (audit before, macro) is that of the longer audits, and each state keeps a rank among its layer's audits in place of the audit, and a pointer to its
parent. States whose cost is too far over the layer's least go, so steps are few and remembered. Audits and turns are read off the pointers afterwards; wherever all states descend from
one, what came before is settled and leaves the memory.

A conversation's turns stream through one task, sorted by Spark (its digest is one running hash); whether a turn's role and text came earlier is a window function.

Defined cases: null role and null text are one space, in the damage's key null numbers too; null turns come first; equal turns are in order of role, then text; a null
conv_id is a conversation of its own; a role of another initial than s, u or a can't be kept; a conversation without rows has zeros, an empty audit and the hash of the empty string;
an empty table gives no row; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import Out, rows_of

EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: State and role's initial -> state.
STEP = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: What an inserted or reroled turn leads to, and its role.
NEXT = {EMPTY: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
INSERT, REROLE, DELETE, TRUNCATED = 2, 2, 3, 1
#: Macro edits in order. No cheapest audit holds three inserts in a row: without two of them the same state is reached.
CODES = sorted(i * "I" + x for i in range(3) for x in "DKR")
WHITE = " \t\n\x0b\x0c\r"
FAULTS = ("blank", "duplicate", "truncated")
#: What any state can go on like any other for, at most (after u, instead of nothing yet: an insert, and a deletion where the other keeps s): dearer states are left out.
SLACK = 5
#: Turns held before it is asked which of them are settled.
HELD = 512


@cache
def macros(initial: str, fault: str) -> tuple[tuple[int, int, int, int], ...]:
    """(state before, state after, cost, code) of a turn: of equal states the cheapest, then first."""
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for state in range(4):
        at = state
        for i in range(3):
            stays = TRUNCATED if fault == "truncated" else 0
            options = [("D", at, DELETE)]
            if fault not in ("blank", "duplicate"):
                options += [("R", NEXT[at], REROLE + stays), *(("K", STEP[at, initial], stays) for _ in range((at, initial) in STEP))]
            for letter, to, cost in options:
                found = (i * INSERT + cost, CODES.index(i * "I" + letter))
                best[state, to] = min(best.get((state, to), found), found)
            at = NEXT[at]
    return tuple((a, b, cost, code) for (a, b), (cost, code) in best.items())


Layer = tuple[tuple[int, int] | None, ...]  # by state: cost over the least, rank
Pointers = tuple[tuple[int, int] | None, ...]  # by state: state before, code
FIRST: Layer = ((0, 0), None, None, None)


@cache
def step(layer: Layer, initial: str, fault: str) -> tuple[Layer, Pointers, int]:
    """The next layer, its pointers, and by how much the least cost grew."""
    best: list[tuple[int, int, int, int] | None] = [None] * 4
    for a, b, cost, code in macros(initial, fault):
        if layer[a] is not None:
            found = (layer[a][0] + cost, layer[a][1], code, a)
            best[b] = found if best[b] is None else min(best[b], found)
    least = min(x[0] for x in best if x)
    best = [x if x and x[0] <= least + SLACK else None for x in best]
    order = sorted((x[1], x[2], s) for s, x in enumerate(best) if x)
    rank = {s: i for i, (_, _, s) in enumerate(order)}
    return tuple(x and (x[0] - least, rank[s]) for s, x in enumerate(best)), tuple(x and (x[3], x[2]) for x in best), least


def finish(layer: Layer) -> tuple[int, int, int]:
    """The cheapest closing: its cost over the layer's least, the state it closes, its inserts."""
    closing = {EMPTY: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
    cost, _, inserts, state = min((x[0] + INSERT * closing[s], x[1], closing[s], s) for s, x in enumerate(layer) if x)
    return cost, state, inserts


Edit = tuple[str, int | None, str | None, str | None]  # initial, turn, role and text as repaired (null: deleted)


@dataclass
class Repair:
    """The programme of one conversation. add() and close() give the edits that are settled, in order."""

    cost: int = 0
    layer: Layer = FIRST
    state: int = EMPTY  # before the first held turn
    held: list[tuple[Pointers, int | None, str, str]] = field(default_factory=list)
    ask: int = HELD

    def add(self, turn: int | None, role: str, text: str, fault: str) -> list[Edit]:
        self.layer, pointers, grown = step(self.layer, role[:1] if role[:1] in ("s", "u", "a") else "", fault)
        self.cost += grown
        goes = fault in ("blank", "duplicate")
        self.held.append((pointers, turn, "" if goes else role, "" if goes else text))
        if len(self.held) < self.ask:
            return []
        out = self._settled()
        self.ask = max(HELD, 2 * len(self.held))
        return out

    def close(self) -> list[Edit]:
        cost, state, inserts = finish(self.layer)
        self.cost += cost
        out = self._until(len(self.held), state)
        for _ in range(inserts):
            out.append(self._inserted())
        return out

    def _settled(self) -> list[Edit]:
        states, n = {s for s, x in enumerate(self.layer) if x}, len(self.held)
        while n and len(states) > 1:
            n -= 1
            states = {self.held[n][0][s][0] for s in states}
        return self._until(n, states.pop()) if n else []

    def _until(self, n: int, state: int) -> list[Edit]:
        """The edits of the first n held turns, after which the state is this; they leave the memory."""
        codes, out = [], []
        for pointers, *_ in reversed(self.held[:n]):
            state, code = pointers[state]
            codes.append(CODES[code])
        for code, (_, turn, role, text) in zip(reversed(codes), self.held[:n], strict=True):
            for letter in code:
                if letter == "I":
                    out.append(self._inserted())
                elif letter == "D":
                    out.append(("D", turn, None, None))
                elif letter == "K":
                    self.state = STEP[self.state, role[:1]]
                    out.append(("K", turn, role, text))
                else:
                    self.state = NEXT[self.state]
                    out.append(("R", turn, ROLE[self.state], text))
        del self.held[:n]
        return out

    def _inserted(self) -> Edit:
        self.state = NEXT[self.state]
        return ("I", None, ROLE[self.state], "")


def fault_of(text: str, seen: bool) -> str:
    """A turn's first fault; none: empty."""
    shown = text.rstrip(WHITE)
    return "blank" if not shown else "duplicate" if seen else "truncated" if shown[-1] not in ".!?" else ""


@dataclass
class Report:
    """What a conversation's turns have before the repair, and the digest of it."""

    faults: dict[str, int] = field(default_factory=lambda: dict.fromkeys(FAULTS, 0))
    illegal: int = 0
    last: str | None = None
    turns: int = 0
    low: int | None = None
    high: int | None = None
    audit: list[str] = field(default_factory=list)
    sha: object = field(default_factory=hashlib.sha256)
    begun: bool = False

    def turn(self, turn: int | None, role: str, fault: str) -> None:
        if fault:
            self.faults[fault] += 1
        if self.last is not None:
            self.illegal += self.last + role[:1] not in ("su", "ua", "au")
        self.last = role[:1]
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = (turn if self.low is None else self.low), turn, self.turns + 1

    def edits(self, done: list[Edit]) -> None:
        self.audit.append("".join(e[0] for e in done))
        for _, _, role, text in done:
            if role is not None:
                self.sha.update(("\n" * self.begun + f"{role}:{text}").encode())
                self.begun = True

    def row(self, conv: int | None, cost: int) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return conv, gaps, *(self.faults[f] for f in FAULTS), self.illegal, cost, "".join(self.audit), self.sha.hexdigest()


def ordered(conversations: DataFrame, absent: Column | None = None) -> DataFrame:
    """conv_id, turn, role, text, absent, seen: each conversation in one partition, its turns in order. absent: rows that only name their conversation."""
    gone = F.lit(False) if absent is None else F.coalesce(absent, F.lit(False))
    text = lambda c: F.when(gone, "").otherwise(F.coalesce(F.col(c), F.lit(" ")))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), gone.alias("absent"))
    earlier = Window.partitionBy("conv_id", "absent", "role", "text").orderBy("turn")
    flagged = rows.repartition("conv_id").withColumn("seen", F.row_number().over(earlier) > 1)
    return flagged.sortWithinPartitions("conv_id", "turn", "role", "text", "seen").select("conv_id", "turn", "role", "text", "absent", "seen")


def _conversations(rows: Iterator[tuple]) -> Iterator[tuple[str, object, object]]:
    """("edits", conversation, edits) as they settle, and ("end", conversation, row of the report)."""
    conv, repair, report = None, None, None

    def end() -> Iterator[tuple]:
        done = repair.close()
        report.edits(done)
        yield "edits", conv, done
        yield "end", conv, report.row(conv, repair.cost)

    for key, turn, role, text, absent, seen in rows:
        if repair is None or key != conv:
            if repair is not None:
                yield from end()
            conv, repair, report = key, Repair(), Report()
        if absent:
            continue
        fault = fault_of(text, seen)
        report.turn(turn, role, fault)
        done = repair.add(turn, role, text, fault)
        if done:
            report.edits(done)
            yield "edits", conv, done
    if repair is not None:
        yield from end()


def repaired(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 0, in order), edit (Keep, Rerole, Delete, Insert: its initial), turn (null: inserted, or null before), role, text (both null: deleted). The
    rows that have a role are the repaired conversation."""
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, place = Out(schema), 0
        for what, conv, found in _conversations(rows_of(batches)):
            if what == "end":
                place = 0
                continue
            for edit, turn, role, text in found:
                yield from out.add((conv, place, edit, turn, role, text), len(text or "") + 64)
                place += 1
        yield from out.flush()

    return ordered(conversations).mapInArrow(run, "conv_id long, place long, edit string, turn long, role string, text string")


def report(conversations: DataFrame, absent: Column | None = None) -> DataFrame:
    """Per conversation: conv_id, gaps (numbers missing between the least and the greatest turn), blank, duplicate, truncated, illegal (neighbours out of order), cost, audit,
    repaired_sha256."""
    names = ("gaps", *FAULTS, "illegal", "cost")
    schema = pa.schema([("conv_id", pa.int64()), *((n, pa.int64()) for n in names), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(schema)
        for what, _, found in _conversations(rows_of(batches)):
            if what == "end":
                yield from out.add(found, len(found[-2]) + 128)
        yield from out.flush()

    return ordered(conversations, absent).mapInArrow(run, ", ".join(["conv_id long", *(f"{n} long" for n in names), "audit string", "repaired_sha256 string"]))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, dropped: the rows after damage by the crc32 of conv_id and turn; rows that it drops stay, marked."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), known("role").alias("role"), known("text").alias("text"))
    rows = rows.withColumn("d", F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20)
    d = F.col("d")
    return rows.select(
        "conv_id", "turn", F.when(d == 4, "user").otherwise(F.col("role")).alias("role"), F.when(d == 1, "").when(d == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (d == 0).alias("dropped"), F.explode(F.when(d == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


#: The same by audit strings, without macros: one edit at a time, the least (cost, audit) of each state after each row. crc32 by its table, byte by byte.
ORACLE = r"""
WITH RECURSIVE poly AS (SELECT i, 0 AS k, i::BIGINT AS v FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM poly WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM poly WHERE k = 8),
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
hashed AS (SELECT raw.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS d FROM raw, crc),
bad AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hashed, LATERAL (SELECT unnest(CASE WHEN d = 3 THEN [0, 1] WHEN d = 0 THEN [] ELSE [0] END) AS copy)),
known AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS seen FROM bad),
placed AS (SELECT *, row_number() OVER w AS i, substr(role, 1, 1) AS x, lag(substr(role, 1, 1)) OVER w AS before, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS shown
  FROM known WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, seen)),
r AS (SELECT *, CASE WHEN shown = '' THEN 'b' WHEN seen THEN 'd' WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM placed),
facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
  count(*) FILTER (before IS NOT NULL AND before || x NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM r GROUP BY conv_id),
ins AS (SELECT * FROM (VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''), (0, 2, 2, 'I', 'user:'), (1, 2, 2, 'I', 'user:'), (2, 3, 2, 'I', 'assistant:'), (3, 2, 2, 'I', 'user:'),
  (0, 3, 4, 'II', 'user:' || chr(10) || 'assistant:'), (1, 3, 4, 'II', 'user:' || chr(10) || 'assistant:'), (2, 2, 4, 'II', 'assistant:' || chr(10) || 'user:'), (3, 3, 4, 'II', 'user:' || chr(10) || 'assistant:')) v(s, m, cost, code, said)),
keeps AS (SELECT * FROM (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)) v(m, x, e)),
turns AS (SELECT conv_id, i, ins.s, e, ins.cost + CASE c WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN c <> 'D' AND fault = 't' THEN 1 ELSE 0 END AS cost, ins.code || c AS code,
  CASE WHEN ins.said = '' THEN '' ELSE chr(10) || ins.said END || CASE c WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || role || ':' || text ELSE chr(10) || CASE e WHEN 2 THEN 'user' ELSE 'assistant' END || ':' || text END AS said
  FROM r, ins, LATERAL (SELECT 'D' AS c, ins.m AS e UNION ALL SELECT 'R', CASE ins.m WHEN 2 THEN 3 ELSE 2 END WHERE fault NOT IN ('b', 'd')
    UNION ALL SELECT 'K', e FROM keeps WHERE keeps.m = ins.m AND keeps.x = r.x AND fault NOT IN ('b', 'd'))),
best AS (SELECT conv_id, 0::BIGINT AS i, 0 AS s, 0::BIGINT AS cost, '' AS audit, '' AS said FROM facts
  UNION ALL SELECT conv_id, i, e, k.cost, k.audit, k.said FROM (SELECT t.conv_id, t.i, t.e, min({'cost': b.cost + t.cost, 'audit': b.audit || t.code, 'said': b.said || t.said}) AS k
    FROM best b JOIN turns t ON t.conv_id IS NOT DISTINCT FROM b.conv_id AND t.i = b.i + 1 AND t.s = b.s GROUP BY ALL)),
done AS (SELECT b.conv_id, min({'cost': b.cost + c.cost, 'audit': b.audit || c.code, 'said': b.said || CASE WHEN c.said = '' THEN '' ELSE chr(10) || c.said END}) AS k
  FROM best b JOIN facts f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.n = b.i JOIN ins c ON c.s = b.s AND (c.m = 3 OR c.m = 0) AND (c.code = '' OR c.m = 3) GROUP BY b.conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(k.cost, 0)::BIGINT AS cost, coalesce(k.audit, '') AS audit, sha256(coalesce(substr(k.said, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM o.conv_id
"""
