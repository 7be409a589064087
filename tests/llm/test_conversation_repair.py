"""op11: DP against brute force, SQL, giant conversations over many batches, odd rows."""

from __future__ import annotations

import hashlib
import random
import zlib
from functools import lru_cache

import pytest

from outletiq.llm import conversation_repair as cr
from outletiq.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"
BLANKS = " \t\n\x0b\f\r"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        d = zlib.crc32(key.encode()) % 20
        if d == 1:
            text = ""
        if d == 2:
            text = "".join(c for c in text if c not in ".!?")
        if d == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(d, 1)
    return out


def plain_report(rows):
    """One conversation by exhaustive search over edit strings, with the rules written out anew."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).digest()))
    faults, seen = [], set()
    for _, _, role, text in rows:
        end = text.rstrip(BLANKS)
        faults.append("blank" if not end else "duplicate" if (role, text) in seen
                      else "truncated" if end[-1] not in ".!?" else "")
        seen.add((role, text))

    @lru_cache(None)
    def best(i, sofar, inserts):
        """(cost, letters, roles and texts) of the cheapest way on; ``sofar``: last initial and whether rows stand."""
        options = []
        if i == len(rows):
            if sofar in ("", "a"):
                options.append((0, "", ()))
        else:
            _, _, role, text = rows[i]
            c, a, t = best(i + 1, sofar, 0)
            options.append((4 + c, "D" + a, t))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 if faults[i] == "truncated" else 0
                for edit, new, price in (("K", role, 0), ("R", "user", 3), ("R", "assistant", 3)):
                    if new[:1] in {"": "su", "s": "u", "u": "a", "a": "u"}[sofar] and new:
                        c, a, t = best(i + 1, new[:1], 0)
                        options.append((price + more + c, edit + a, (f"{new}:{text}", *t)))
        if inserts < 3:
            for new in ("user", "assistant"):
                if new[0] in {"": "u", "s": "u", "u": "a", "a": "u"}[sofar]:
                    c, a, t = best(i, new[0], inserts + 1)
                    options.append((3 + c, "I" + a, (f"{new}:", *t)))
        return min(options, key=lambda o: o[:2]) if options else (10 ** 9, "", ())

    turns = {r[1] for r in rows if r[1] is not None}
    cost, audit, kept = best(0, "", 0)
    initials = [r[2][:1] for r in rows]
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"),
            faults.count("truncated"), sum((a, b) not in {("s", "u"), ("u", "a"), ("a", "u")}
                                           for a, b in zip(initials, initials[1:])),
            cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())


def collected(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.collect()}


def random_rows(rnd, conversations):
    rows = []
    for conv in conversations:
        for turn in range(rnd.randrange(0, 9)):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rnd.choice(["Yes.", "No!", "cut", "", " \t", None, "A? ", "x.\n", "long " * 3 + ".", "é", "…"])
            rows += [(conv, rnd.choice([turn, turn, turn, None, 0, -3, 2 * turn]), role, text)] * rnd.choice([1, 1, 1, 2])
    return rows


def test_report_against_exhaustive_search(spark):
    rnd = random.Random(11)
    rows = random_rows(rnd, [None, *range(-5, 120)])
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    filled = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    want = {c: plain_report([r for r in filled if r[0] == c]) for c in {r[0] for r in rows}}
    assert collected(cr.report(df)) == want
    damaged = plain_damage(rows)
    want = {c: plain_report([r for r in damaged if r[0] == c]) for c in {r[0] for r in rows}}
    assert collected(cr.damaged_report(df)) == want


def test_step_back_is_the_cheapest_least_edit():
    for shape in (0, 1, 2, 3, 4, 6, 7, 8, 10):
        code, costs = cr.step_back(shape, cr.COSTS_AT_END)
        for state in range(4):
            assert costs[state] <= cr.DELETE + cr.COSTS_AT_END[state]
            assert costs[state] <= cr.INSERT + costs[cr.AFTER_INSERT[state]]
        if shape >= cr.GONE:
            assert code == 0  # deleted in every state


@pytest.mark.parametrize("copies", [1, 700])
def test_a_giant_conversation_over_many_batches(spark, copies):
    rows = [(7, i, ["user", "assistant"][i % 2], f"{i}.") for i in range(6000) if i % 1500 != 3]
    rows += [(7, 9, "assistant", "9.")] * copies  # repeats of one row
    rows += [(8, i, "user", "the same.") for i in range(3000)]  # one text at many turns
    rows += [(i, 0, "user", "x.") for i in range(100, 200)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        got = collected(cr.report(spark.createDataFrame(rows, SCHEMA).repartition(7)))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    gaps, blank, duplicate, truncated, illegal, cost, audit, digest = got[7]
    assert (gaps, blank, duplicate, truncated) == (4, 0, copies, 0)
    # each missing assistant is one insertion, and repeats go
    assert cost == 3 * 4 + 4 * copies and audit.count("I") == 4 and audit.count("D") == copies and len(audit) == 6000 + copies
    assert illegal == copies + 4
    lines = [f"{['user', 'assistant'][i % 2]}:" + ("" if i % 1500 == 3 else f"{i}.") for i in range(6000)]
    assert digest == hashlib.sha256("\n".join(lines).encode()).hexdigest()
    assert got[8][2] == 2999 and got[8][5] == 4 * 2999 + 3 and got[8][6] == "K" + "D" * 2999 + "I"
    assert got[100] == (0, 0, 0, 0, 0, 3, "KI", hashlib.sha256(b"user:x.\nassistant:").hexdigest())


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "user", "Hi."), (1, 3, "bot", "Hello."),
            (2, 0, "assistant", ""), (3, None, "user", "A?"), (3, 5, "assistant", "B")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("code", cr.F.lit("x")).withColumn("place", cr.F.lit("y"))
    got = sorted(tuple(r) for r in cr.repair(df).collect())
    assert got == [(1, 0, 0, "system", "Be kind.", "K"), (1, 1, 1, "user", "Hi.", "K"), (1, 2, 3, "assistant", "Hello.", "R"),
                   (3, 0, None, "user", "A?", "K"), (3, 1, 5, "assistant", "B", "K")]


def test_empty_and_dropped(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert cr.damaged_report(empty).count() == 0 and cr.repair(empty).count() == 0
    dropped = [(c, t) for c in range(400) for t in [0] if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0][:3]
    df = spark.createDataFrame([(c, t, "user", "x.") for c, t in dropped], SCHEMA)
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert dropped and collected(cr.damaged_report(df)) == {c: nothing for c, _ in dropped}


def test_query_reads_the_whole_table(spark):
    path = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").collect()]
    damaged = plain_damage(rows)
    want = {c: plain_report([r for r in damaged if r[0] == c]) for c in {r[0] for r in rows}}
    assert collected(QUERIES["op11_conversation_repair"](spark, path)) == want
