"""Conversation structure repair by signatures: what is wrong with a conversation is a short string, each distinct string is solved once.

A row of a conversation has a role and at most one fault: blank (nothing but spaces), duplicate (role and text seen earlier in the conversation) or truncated (the last
character that is no space isn't one of `.!?`). One letter says both, and a conversation's letters in order are its signature. For each distinct signature the cheapest edits are
found that leave roles of the form (s?(ua)+)?: keep (0), rerole (1), delete (2, required for blank and duplicate rows), insert an empty turn (5); a truncated row that stays costs 5.
Among the cheapest the ASCII-least audit (the edits' initials) wins. The recursion goes over what lies behind a row and is memoised on (letter, costs and order behind),
of which there are few; it is unrolled from the end, so depth and memory don't grow with anything but a few bytes a row. Audits are joined back to the conversations and replayed.

Scale: rows equal in conversation, turn, role and text are one row with a count; duplicates are told by the first turn of each (conversation, role, text), a grouping, not a window;
places come from range partitions, so that a conversation that holds a third of all rows spans many; pieces of 1,024 places are joined to a signature. A signature and an
audit are one value of a byte a row, as the result has them; texts of a conversation are streamed once, in order, through one task and never gathered. Signatures that very many conversations share
meet their audits by broadcast.

Defined cases: nulls of role and text read as one space (so a null text is blank, a null role is foreign), a null conv_id is a conversation; rows go by turn, nulls first, rows of one turn by role,
then by the MD5 of the text; roles count by their first letter, and one that isn't s, u or a (or an empty one) must be reroled or deleted. Other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, WORD, bounded_batches, hot_keys, over_batches, safe_join, spread_join, stage
from .ranks import ranked

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
PIECE = 1024
#: Letters of a signature by the role's initial (s, u, a, other): whole rows, truncated ones, those that must go.
WHOLE, OPEN, GONE = "suao", "SUAO", "1234"

START, SYSTEM, USER, ASSISTANT = range(4)
#: Where the next user or assistant turn leads from each state.
ONWARD = (USER, USER, ASSISTANT, USER)


class Solver:
    """Cheapest edits of signatures; remembers each step that it has seen."""

    def __init__(self):
        self.steps: dict = {}

    def step(self, letter: str, behind: tuple) -> tuple:
        """behind: (cost, order among the four) of the best rest from each state. The same in front of this row, the cost taken out, and (inserts, edit, next state) for each state."""
        if (known := self.steps.get((letter, behind))) is not None:
            return known
        best = []
        for state in range(4):
            options, at = [], state
            for inserts in range(3):
                ways = [("D", DELETE, at)]
                if letter not in GONE:
                    role, more = WHOLE.find(letter.lower()), TRUNCATED * (letter in OPEN)
                    if (role, at) in ((0, START), (1, START), (1, SYSTEM), (1, ASSISTANT), (2, USER)):
                        ways.append(("K", KEEP + more, SYSTEM if role == 0 else ONWARD[at]))
                    if role != ONWARD[at] - 1:
                        ways.append(("R", REROLE + more, ONWARD[at]))
                options += [(INSERT * inserts + cost + behind[to][0], "I" * inserts + edit, behind[to][1], inserts, edit, to) for edit, cost, to in ways]
                at = ONWARD[at]
            best.append(min(options))
        least = min(b[0] for b in best)
        order = sorted({b[1:3] for b in best})
        out = tuple((b[0] - least, order.index(b[1:3])) for b in best), least, tuple(b[3:] for b in best)
        self.steps[letter, behind] = out
        return out

    def solve(self, signature: str) -> tuple[int, str]:
        """(cost, audit)."""
        behind, total, chosen = ((0, 0), (2 * INSERT, 2), (INSERT, 1), (0, 0)), 0, []
        for letter in reversed(signature):
            behind, more, ways = self.step(letter, behind)
            total += more
            chosen.append(ways)
        state, audit = START, []
        for ways in reversed(chosen):
            inserts, edit, state = ways[state]
            audit.append("I" * inserts + edit)
        return total + behind[START][0], "".join(audit) + "I" * (0, 2, 1, 0)[state]


def illegal(signature: str) -> int:
    """Neighbours whose initials are not su, ua or au."""
    roles = signature.translate(str.maketrans(OPEN + GONE, WHOLE + WHOLE))
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False))


def _rows(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text without nulls of the last two, and a name of the text."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return turns.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text")).withColumn("th", F.unhex(F.md5(F.col("text").cast("binary"))))


def signatures(turns: DataFrame) -> DataFrame:
    """For each conv_id of turns: gaps, blank, duplicate, truncated (longs) and its signature."""
    tail = F.substring(F.rtrim("text", F.lit(SPACES.decode())), -1, 1)
    rows = _rows(turns).withColumn("blank", ~F.col("text").rlike(WORD)).withColumn("open", ~tail.isin(".", "!", "?"))
    keys = stage(rows.groupBy("conv_id", "turn", "role", "th").agg(F.count("*").alias("n"), F.first("blank").alias("blank"), F.first("open").alias("open")), "turns")
    first = keys.groupBy("conv_id", "role", "th").agg(F.min(F.struct(F.isnotnull("turn").alias("some"), "turn")).alias("at"))
    keys = safe_join(keys, first, ["conv_id", "role", "th"]).withColumn("is_first", F.col("turn").eqNullSafe(F.col("at.turn")))
    role = F.greatest(F.instr(F.lit("sua"), F.substring("role", 1, 1)), F.lit(0))
    role = F.when((role == 0) | (F.col("role") == ""), 4).otherwise(role)
    good = ~F.col("blank") & F.col("is_first")
    letter = F.when(good & F.col("open"), F.substring(F.lit(OPEN), role, 1)).when(good, F.substring(F.lit(WHOLE), role, 1)).otherwise(F.substring(F.lit(GONE), role, 1))
    code = F.concat(letter, F.repeat(F.substring(F.lit(GONE), role, 1), (F.col("n") - 1).cast("int")))
    coded = stage(keys.select("conv_id", "turn", "role", "th", code.alias("code"), "n", "blank", good.alias("good"), (good & F.col("open")).alias("open")), "coded")
    wide = F.col("turn").cast("decimal(38,0)")
    count = lambda c: F.sum(c).cast("long")
    told = coded.groupBy("conv_id").agg(
        (F.max(wide) - F.min(wide) + 1 - F.count_distinct("turn")).alias("gaps"),
        count(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        count(F.when(F.col("blank"), 0).otherwise(F.col("n") - F.col("good").cast("long"))).alias("duplicate"),
        count(F.col("open").cast("long")).alias("truncated"),
    )
    told = told.withColumn("gaps", F.least(F.coalesce("gaps", F.lit(0)), F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long"))
    placed = ranked(coded.select("conv_id", "turn", "role", "th", "code"), ["conv_id"], ["turn", "role", "th"], "place")
    joined = lambda key: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, "code"))), lambda x: x["code"]), "")
    pieces = placed.groupBy("conv_id", F.expr(f"(place - 1) div {PIECE}").alias("piece")).agg(joined("place").alias("code"))
    whole = pieces.groupBy("conv_id").agg(joined("piece").alias("signature"))
    return safe_join(told, whole, ["conv_id"])


def audits(turns: DataFrame) -> DataFrame:
    """For each conv_id of turns: gaps, blank, duplicate, truncated, illegal, cost (longs), audit and signature."""
    known = stage(signatures(turns), "signatures")
    counts = stage(known.groupBy("signature").agg(F.count("*").alias("n")), "distinct")

    def solved(batch: pa.RecordBatch) -> pa.RecordBatch:
        solver, given = Solver(), batch.column(0).to_pylist()
        found = [solver.solve(s) for s in given]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([illegal(s) for s in given], pa.int64()), pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())], names=["signature", "illegal", "cost", "audit"])

    answers = stage(over_batches(counts.select("signature"), solved, "signature string, illegal long, cost long, audit string"), "solved")
    return spread_join(known, answers, "signature", hot_keys(counts, "signature"))


def replay(turns: DataFrame, found: DataFrame) -> DataFrame:
    """turns as found (conv_id, audit: from audits) edits them: conv_id, place (from 1), edit (K, R or I), role, text.

    Conversations come whole in a partition, their rows in order."""
    rows = _rows(turns)
    lead = found.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast(turns.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(None).cast("binary").alias("th"))
    both = lead.unionByName(rows.withColumn("kind", F.lit(1)))
    dealt = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "th").select("conv_id", "kind", "role", "text")
    schema = T.StructType([turns.schema["conv_id"], *T._parse_datatype_string("place long, edit string, role string, text string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, state, place = "", 0, START, 0
        out: list[tuple] = []

        def put(conv, edit: str, role: str, text: str) -> None:
            nonlocal state, place
            first = role[:1]
            state = SYSTEM if edit == "K" and first == "s" else ONWARD[state]
            place += 1
            out.append((conv, place, edit, {USER: "user", ASSISTANT: "assistant"}[state] if edit != "K" else role, text))

        def inserted(conv) -> None:
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                put(conv, "I", "", "")
                at += 1

        now = None
        for batch in batches:
            out = []
            for conv, kind, role, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if kind == 0:
                    inserted(now)  # what the conversation before has at its end
                    audit, at, state, place, now = text, 0, START, 0, conv
                    continue
                inserted(conv)
                if audit[at] != "D":
                    put(conv, audit[at], role, text)
                at += 1
            yield _batch(out, batch.schema.field(0).type)
        out = []
        inserted(now)
        if out:
            yield _batch(out, None)

    bounded_batches(turns.sparkSession)
    return dealt.mapInArrow(run, schema)


def _batch(rows: list[tuple], kind: pa.DataType | None) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 5
    kinds = (kind or pa.array(columns[0]).type, pa.int64(), pa.string(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "place", "edit", "role", "text"])


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of replay()'s rows, `role:text` joined by newlines; streams each conversation through one hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, kind = None, None, None
        for batch in batches:
            kind, done = batch.schema.field(0).type, []
            for conv, place, role, text in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4)), strict=True):
                if place == 1:
                    if state is not None:
                        done.append((now, state.hexdigest()))
                    now, state = conv, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], kind), pa.array([h for _, h in done], pa.string())], names=["conv_id", "repaired_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([state.hexdigest()])], names=["conv_id", "repaired_sha256"])

    return repaired.mapInArrow(run, T.StructType([repaired.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())]))


def damaged(turns: DataFrame) -> DataFrame:
    """Planted faults by crc32 of `conv_id:turn`, modulo 20: 0 drops a row, 1 empties its text, 2 takes its `.!?` out, 3 repeats it, 4 makes it the user's."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    rows = rows.withColumn("text", F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))).select("conv_id", "turn", "role", "text")


def repaired_conversations(turns: DataFrame, given: DataFrame) -> DataFrame:
    """One row for each conv_id of `given` (turns before damage): its counts, cost, audit and the hash of its repaired rows; zeros where turns has none of it."""
    found = stage(audits(turns).drop("signature"), "audits")
    hashes = digests(replay(turns, found))
    rows = safe_join(safe_join(given.select("conv_id").distinct(), found, ["conv_id"], "left"), hashes, ["conv_id"], "left")
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    empty = hashlib.sha256(b"").hexdigest()
    return rows.select("conv_id", *(v.alias(c) for c, v in zero.items()), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
