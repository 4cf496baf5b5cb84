"""Conversation repair: the solver against a search over all edits, the query against a plain second implementation, edge cases."""

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from driftloom.llm import conversation_repair as repair
from driftloom.llm.common import read
from driftloom.llm.oracles import ORACLES
from driftloom.llm.queries import QUERIES
from tests.conftest import DATA, rows_of, sql_rows

NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def cheapest(rows):
    """rows: (role initial, must go, truncated). (cost, audit) of the cheapest, then ASCII-least edits, by a search over costs and audits."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, at, last = heapq.heappop(heap)
        if at == len(rows) and last in ("", "a"):
            return cost, audit
        if (audit, at, last) in seen:
            continue
        seen.add((audit, at, last))
        if len(audit) < 2 * len(rows) + 3:
            heapq.heappush(heap, (cost + 5, audit + "I", at, NEXT[last]))
        if at < len(rows):
            role, gone, cut = rows[at]
            heapq.heappush(heap, (cost + 2, audit + "D", at + 1, last))
            if not gone:
                if role == NEXT[last] or role == "s" and last == "":
                    heapq.heappush(heap, (cost + 5 * cut, audit + "K", at + 1, role))
                heapq.heappush(heap, (cost + 5 * cut + 1, audit + "R", at + 1, NEXT[last]))


def forward(rows):
    """The same by a table of the best way to each last role, from the front."""
    best = {"": (0, "")}

    def inserted(best):
        for _ in range(3):
            for last, (cost, audit) in list(best.items()):
                to = (cost + 5, audit + "I")
                best[NEXT[last]] = min(best.get(NEXT[last], to), to)
        return best

    for role, gone, cut in rows:
        after = {}
        for last, (cost, audit) in inserted(best).items():
            ways = [(last, 2, "D")]
            if not gone:
                ways += [(role, 5 * cut, "K")] if role == NEXT[last] or role == "s" and last == "" else []
                ways += [(NEXT[last], 5 * cut + 1, "R")]
            for to, more, edit in ways:
                way = (cost + more, audit + edit)
                after[to] = min(after.get(to, way), way)
        best = after
    best = inserted(best)
    return min(best[x] for x in ("", "a") if x in best)


def by_hand(turns):
    """turns: (conv_id, turn, role, text) before damage. What the query returns."""
    space = lambda x: " " if x is None else str(x)
    after = defaultdict(list)
    for conv, turn, role, text in turns:
        role, text = space(role), space(text)
        kind = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        after[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv in {t[0] for t in turns}:
        rows = sorted(after[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
        numbers = {t for t, _, _ in rows if t is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        seen, judged, count = set(), [], defaultdict(int)
        for _, role, text in rows:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            count[fault] += 1
            judged.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        wrong = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:], strict=False))
        cost, audit = forward(judged)
        kept, at, last = [], 0, ""
        for edit in audit:
            if edit == "D":
                at += 1
                continue
            if edit == "K":
                kept.append(f"{rows[at][1]}:{rows[at][2]}")
                last = rows[at][1][0]
            else:
                last = NEXT[last]
                kept.append({"u": "user", "a": "assistant"}[last] + ":" + (rows[at][2] if edit == "R" else ""))
            at += edit != "I"
        out[conv] = (gaps, count["blank"], count["duplicate"], count["truncated"], wrong, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def found(df):
    rows = df.collect()
    out = {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_cheapest_edits():
    solver, rng = repair.Solver(), random.Random(3)
    letters = {c: (r, kind is repair.GONE, kind is repair.OPEN) for kind in (repair.WHOLE, repair.OPEN, repair.GONE) for c, r in zip(kind, "suao", strict=True)}
    short = ["".join(s) for n in (0, 1, 2) for s in itertools.product(letters, repeat=n)]
    for signature in [*short, *("".join(rng.choice("suauaoSUAO13") for _ in range(rng.randint(3, 5))) for _ in range(200))]:
        rows = [letters[c] for c in signature]
        assert solver.solve(signature) == cheapest(rows) == forward(rows), signature
    assert repair.illegal("suUa1o") == 3 and repair.illegal("") == 0
    cost, audit = solver.solve("su" + "au" * 50_000)  # no recursion depth, no strings of all suffixes
    assert (cost, len(audit)) == (2, 100_002) and audit.count("D") == 1


def test_query_by_hand_and_sql(spark, duck):
    given = [tuple(r) for r in read(spark, DATA, "conversations").select("conv_id", "turn", "role", "text").collect()]
    df = QUERIES["op12_conversation_repair"](spark, DATA)
    assert found(df) == by_hand(given)
    assert rows_of(df) == sql_rows(duck, ORACLES["op12_conversation_repair"], sorted(df.columns))


def test_edges(spark):
    rng = random.Random(7)
    texts = ["Yes.", "No!", "why?", "cut off", " \t\n", "", None, "tail. \n\t", "x" * 100_000 + ".", "Ünïcode 🙂", "…"]
    roles = ["user", "assistant", "system", "tool", "", None, "Assistant", "sudo"]
    turns = [(c, rng.choice([None, 0, 1, 2, 5, 2**63 - 1, -(2**63)]), rng.choice(roles), rng.choice(texts)) for c in range(60) for _ in range(rng.randint(1, 9))]
    turns += [(None, i, "user" if i % 2 else "assistant", "Fine.") for i in range(6)] + [(100, 1, "user", "Same.")] * 40
    turns += [(101, i, "user", f"Turn {i // 2}.") for i in range(3000)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("audit", "place", "kind", "th", "signature", "conv_id_of")})
    got = found(repair.repaired_conversations(repair.damaged(df), df))
    want = by_hand([t for t in turns if t[0] != 101])
    far = {c: w for c, w in want.items() if w[0] > 2**63 - 1}  # gaps that no long holds stop at its end
    assert {c: g for c, g in got.items() if c not in far and c != 101} == {c: w for c, w in want.items() if c not in far}
    assert all(got[c] == (2**63 - 1, *w[1:]) for c, w in far.items())
    assert got[101][2] > 1000 and got[101][6].count("D") >= got[101][2]
    none = df.limit(0)
    assert repair.repaired_conversations(repair.damaged(none), none).collect() == []


@pytest.mark.parametrize("shared", [2, 200])
def test_shared_signatures_and_replay(spark, shared):
    turns = [(c, t, r, f"{r} {c}.") for c in range(shared) for t, r in enumerate(["system", "user", "user", "assistant"])]
    df = spark.createDataFrame(turns, "conv_id int, turn int, role string, text string")
    audits = repair.audits(df)
    assert {(r["audit"], r["cost"], r["duplicate"]) for r in audits.collect()} == {("KKDK", 2, 1)}
    rows = sorted(tuple(r) for r in repair.replay(df, audits).collect())
    assert rows[:3] == [(0, 1, "K", "system", "system 0."), (0, 2, "K", "user", "user 0."), (0, 3, "K", "assistant", "assistant 0.")] and len(rows) == 3 * shared
