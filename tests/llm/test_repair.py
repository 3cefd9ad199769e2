"""Conversation repair against a search over single edits, at random, in odd cases, and of the registered query against SQL."""

import hashlib
import random
import re
import zlib
from functools import cache

import duckdb
import pytest

from vigil.llm import repair
from vigil.llm.queries import op12_conversation_repair

WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def faults_of(turns):
    seen, out = set(), []
    for _, role, text in turns:
        last = re.findall(f"[^{WHITE}]", text)
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "" if last[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def brute(turns):
    """Least (cost, audit) and what it gives, from the end, one edit at a time; inserts up to three in a row."""
    faults = faults_of(turns)

    def fits(roles):
        return re.fullmatch("(s?(ua)+)?", roles) is not None

    def begins(roles):
        return any(fits(roles + x) for x in ("", "a", "ua"))

    @cache
    def best(i, state, inserts):
        found = []
        if inserts < 3:
            for role in ("user", "assistant"):
                if begins(state + role[0]):
                    cost, audit, said = best(i, short(state + role[0]), inserts + 1)
                    found.append((cost + 2, "I" + audit, (f"{role}:", *said)))
        if i == len(turns):
            return min(found + [(0, "", ())] * fits(state), default=(10**9, "", ()))
        _, role, text = turns[i]
        cost, audit, said = best(i + 1, state, 0)
        found.append((cost + 3, "D" + audit, said))
        if faults[i] not in ("blank", "duplicate"):
            more = faults[i] == "truncated"
            for letter, price, new in (("K", 0, role), ("R", 2, "user"), ("R", 2, "assistant")):
                if new[:1] and begins(state + new[:1]):
                    cost, audit, said = best(i + 1, short(state + new[:1]), 0)
                    found.append((cost + price + more, letter + audit, (f"{new}:{text}", *said)))
        return min(found)

    def short(roles):
        return roles if len(roles) < 4 else roles[:1] * (roles[0] == "s") + "ua" + "u" * (roles[-1] == "u")

    cost, audit, said = best(0, "", 0)
    numbers = [t for t, _, _ in turns if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(turns, turns[1:])]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    return gaps, *(faults.count(f) for f in repair.FAULTS), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()


def ordered(rows):
    """Conversation -> turns in order, nulls as one space."""
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    return {c: sorted(t, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for c, t in out.items()}


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        out += [(conv, turn, "user" if d == 4 else role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    return out


SCHEMA = "conv_id long, turn long, role string, text string"


def rows_at_random(seed, conversations, most):
    rnd = random.Random(seed)
    roles = ["user", "assistant", "system", "u", "a", "tool", "User", "", None, " ", "é"]
    texts = ["Yes.", "No!", "why?\n", "cut", "", " \t", None, "x.\x0b", "y.\x85", "Yes."]
    rows = []
    for c in range(conversations):
        few = rnd.random() < 0.5
        for t in range(rnd.randrange(most)):
            role = rnd.choice(roles[:3] if few else roles)
            rows.append((c if rnd.random() < 0.99 else None, rnd.choice([t, t, t, t + 2, None, -t, 1]), role, rnd.choice(texts) if rnd.random() < 0.5 else f"text {rnd.randrange(6)}."))
    return rows


def test_random_conversations_equal_a_search_over_single_edits(spark):
    rows = rows_at_random(3, 300, 9)
    want = {c: brute(t) for c, t in ordered(rows).items()}
    got = {r[0]: tuple(r)[1:] for r in repair.report(spark.createDataFrame(rows, SCHEMA)).select(COLUMNS).collect()}
    assert got == want


def test_long_conversations_settle_on_the_way(spark, monkeypatch):
    monkeypatch.setattr(repair, "HELD", 4)
    rows = ordered(rows_at_random(5, 40, 60))
    for turns in rows.values():
        r, done, faults = repair.Repair(ask=4), [], faults_of(turns)
        for (turn, role, text), fault in zip(turns, faults):
            done += r.add(turn, role, text, fault)
        done += r.close()
        said = "\n".join(f"{role}:{text}" for _, _, role, text in done if role is not None)
        assert (r.cost, "".join(e[0] for e in done), hashlib.sha256(said.encode()).hexdigest()) == brute(turns)[-3:]


def test_memory_of_a_long_conversation_is_bounded():
    r, most = repair.Repair(), 0
    for i in range(100_000):
        r.add(i, ("user", "assistant", "tool")[i % 3], f"{i}.", "blank" if i % 7 == 0 else "")
        most = max(most, len(r.held))
    assert most <= repair.HELD and len(repair.step.cache_info()) and repair.step.cache_info().currsize < 5000


def test_no_audit_of_a_layer_begins_another():
    assert all(not b.startswith(a) for a in repair.CODES for b in repair.CODES if a != b) and repair.CODES == sorted(repair.CODES)


def test_repaired_turns_keep_to_the_grammar(spark):
    rows = rows_at_random(9, 80, 8)
    df = spark.createDataFrame(rows, SCHEMA)
    out = {}
    for r in repair.repaired(df).orderBy("conv_id", "place").collect():
        out.setdefault(r.conv_id, []).append(r)
    want = {c: brute(t) for c, t in ordered(rows).items()}
    for c, turns in out.items():
        assert [r.place for r in turns] == list(range(len(turns))) and "".join(r.edit for r in turns) == want[c][-2]
        kept = [r for r in turns if r.role is not None]
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in kept))
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in kept).encode()).hexdigest() == want[c][-1]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_registered_query_equals_sql_and_the_search(spark, sf):
    path = f"/root/testdata/{sf}"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/conversations.parquet'")
    want = sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({repair.ORACLE})").fetchall())
    got = sorted(tuple(r) for r in op12_conversation_repair(spark, path).select(COLUMNS).collect())
    assert got == want
    rows = con.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    left = ordered(damaged(rows))
    assert got == sorted((c, *(brute(left[c]) if c in left else nothing)) for c in {r[0] for r in rows})


def test_damage_of_odd_rows(spark, tmp_path):
    rows = rows_at_random(11, 200, 5) + [(1, 1, "user", "again.")] * 5
    df = spark.createDataFrame([(*r, "clash", True) for r in rows], SCHEMA + ", seen string, dropped boolean")
    df.coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted((tuple(r) for r in op12_conversation_repair(spark, str(tmp_path)).select(COLUMNS).collect()), key=str)
    left = ordered(damaged(rows))
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == sorted(((c, *(brute(left[c]) if c in left else nothing)) for c in {r[0] for r in rows}), key=str)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT conv_id, turn, role, text FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({repair.ORACLE})").fetchall(), key=str) == got


def test_empty_table_and_very_long_texts(spark):
    assert repair.report(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, 0, "user", "w " * 1_000_000), (1, 1, "assistant", "x" * 1_000_000 + ".")]
    got = repair.report(spark.createDataFrame(rows, SCHEMA)).select(COLUMNS).first()
    assert tuple(got)[1:] == brute([r[1:] for r in rows])
