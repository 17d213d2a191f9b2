"""Conversation repair against a search that keeps whole edit strings."""

from __future__ import annotations

import hashlib
import random
import re
from itertools import product

import pytest
from pyspark.sql import functions as F

from ridetide.llm.conversations import (
    ACCEPT,
    NOTHING,
    Turn,
    composed,
    damaged,
    digests,
    edits,
    forward,
    matrix,
    repair,
    repaired,
)

NAMES = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
BLANK = " \t\n\x0b\f\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def ordered(rows: list[tuple]) -> list[tuple]:
    """(turn, role, text) of one conversation."""
    plain = [(turn, " " if role is None else role, " " if text is None else text) for turn, role, text in rows]
    return sorted(plain, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def faults(rows: list[tuple]) -> list[str]:
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(BLANK)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows: list[tuple]) -> tuple[int, str, str]:
    """Cost, audit and repaired text; for each sequence of initials so far the best edits."""
    best = {"": (0, "", "")}

    def legal(initials: str) -> bool:
        return re.fullmatch("s?(ua)*u?", initials) is not None

    def short(initials: str) -> str:
        # What may follow depends on the last turn alone.
        return "ua" if initials.endswith("a") else initials[-1:]

    def put(into, key, way):
        into[key] = min(into.get(key, way), way)

    def inserted(ways):
        for _ in range(2):
            for key, (cost, audit, text) in list(ways.items()):
                for role in ("user", "assistant"):
                    if legal(key + role[0]):
                        put(ways, short(key + role[0]), (cost + 3, audit + "I", f"{text}\n{role}:"))
        return ways

    for (_, role, text), fault in zip(rows, faults(rows)):
        after: dict = {}
        extra = 3 if fault == "truncated" else 0
        for key, (cost, audit, out) in inserted(dict(best)).items():
            put(after, key, (cost + 4, audit + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            if role[:1] in "sua" and role and legal(key + role[0]):
                put(after, short(key + role[0]), (cost + extra, audit + "K", f"{out}\n{role}:{text}"))
            for name in ("user", "assistant"):
                if legal(key + name[0]):
                    put(after, short(key + name[0]), (cost + 3 + extra, audit + "R", f"{out}\n{name}:{text}"))
        best = after
    return min(way for key, way in inserted(dict(best)).items() if key in ("", "ua"))


def brute_force(rows: list[tuple], conversations: set) -> list[tuple]:
    out = []
    for conv_id in conversations:
        own = ordered([row[1:] for row in rows if row[0] == conv_id])
        found, turns = faults(own), [turn for turn, _, _ in own if turn is not None]
        cost, audit, text = cheapest(own) if own else (0, "", "")
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:])]
        out.append(
            (
                conv_id,
                max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
                *(found.count(kind) for kind in ("blank", "duplicate", "truncated")),
                sum(pair not in ("su", "ua", "au") for pair in pairs),
                cost,
                audit,
                hashlib.sha256(text[1:].encode()).hexdigest(),
            )
        )
    return sorted(out, key=repr)


def row_of(pick: random.Random, conv_id) -> tuple:
    role = pick.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
    text = pick.choice(["Yes.", "No!", "What", "Längerer Satz ohne Ende", " \t", "", None, f"Number {pick.randint(0, 99)}?"])
    return conv_id, pick.choice([None, *range(12)]), role, text


def made(seed: int) -> list[tuple]:
    pick = random.Random(seed)
    rows = [row_of(pick, conv_id) for conv_id in (None, *range(40)) for _ in range(pick.randint(1, 14))]
    return rows + rows[20:40] + [(99, None, "user", "Hm"), (99, None, "user", "Hm")]


def results(spark, rows, **how) -> list[tuple]:
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit(n) for n in ("part", "seq", "initial", "rows", "start")})
    return sorted((tuple(row[n] for n in NAMES) for row in digests(frame, frame, **how).collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_a_search_with_whole_strings(spark, seed):
    rows = made(seed)
    assert results(spark, rows) == brute_force(rows, {row[0] for row in rows})


def test_conversations_in_many_chunks_and_partitions(spark):
    """One conversation holds most rows; chunks of three rows over partitions that are not merged."""
    pick = random.Random(7)
    rows = [(5, turn, *row_of(pick, 5)[2:]) for turn in range(300)] + [(5, 7, "user", "Twice.")] * 30 + made(3)
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        frame = spark.createDataFrame(rows, SCHEMA)
        pieces = repair(frame, chunk_rows=3)
        assert pieces.where("conv_id = 5").count() > 50
        assert pieces.where("conv_id = 5").select((F.col("seq") / 2**40).cast("int")).distinct().count() > 1
        got = sorted((tuple(row[n] for n in NAMES) for row in digests(frame, frame, chunk_rows=3).collect()), key=repr)
    finally:
        spark.conf.unset(key)
    assert got == brute_force(rows, {row[0] for row in rows})


def test_repaired_turns_are_legal_and_give_the_hash(spark):
    rows = made(4)
    frame = spark.createDataFrame(rows, SCHEMA)
    by_conversation: dict = {}
    for row in repaired(repair(frame)).orderBy("conv_id", "seq", "position").collect():
        by_conversation.setdefault(row["conv_id"], []).append(row)
    hashes = {row["conv_id"]: row["repaired_sha256"] for row in digests(frame, frame).collect()}
    for conv_id, turns in by_conversation.items():
        assert re.fullmatch("(s?(ua)+)?", "".join(turn["role"][0] for turn in turns))
        lines = "\n".join(f"{turn['role']}:{turn['text']}" for turn in turns)
        assert hashes[conv_id] == hashlib.sha256(lines.encode()).hexdigest()
        assert all(turn["text"] == "" for turn in turns if turn["edit"] == "I")


KINDS = [Turn(*kind, 1) for kind in product(("s", "u", "a", "t"), (False, True), (False, True))]


def test_divide_and_conquer_finds_the_least_edits(spark):
    """Against all crossings in one go, for every start and end."""
    pick = random.Random(11)
    for _ in range(300):
        turns = [pick.choice(KINDS)._replace(copies=pick.choice([1, 1, 3])) for _ in range(pick.randint(1, 9))]
        for start, end in product(range(4), (ACCEPT, 0, 1, 2, 3)):
            if end != ACCEPT and forward(turns, 0, len(turns), start)[0][end] >= 1 << 60:
                continue
            ways = {start: (0, "")}
            for turn in turns:
                after: dict = {}
                from ridetide.llm.conversations import steps_of

                for state, (cost, audit) in ways.items():
                    for to, more, word in steps_of(turn)[state]:
                        way = (cost + more + 4 * (turn.copies - 1), audit + word + "D" * (turn.copies - 1))
                        after[to] = min(after.get(to, way), way)
                ways = after
            trailing = {0: 0, 1: 6, 2: 3, 3: 0}
            if end == ACCEPT:
                _, least = min((cost + trailing[state], audit) for state, (cost, audit) in ways.items())
            else:
                least = ways[end][1]
            assert "".join(edits(turns, start, end)) == least


def test_matrices_of_parts_compose(spark):
    pick = random.Random(13)
    for _ in range(100):
        turns = [pick.choice(KINDS) for _ in range(12)]
        at = pick.randint(1, 11)
        assert composed([matrix(turns[:at]), matrix(turns[at:])]) == matrix(turns)


def test_hundreds_of_thousands_of_equal_rows(spark):
    rows = spark.range(200_000).select(F.lit(1).alias("conv_id"), F.lit(4).alias("turn"), F.lit("user").alias("role"), F.lit("Hi.").alias("text"))
    (row,) = digests(rows, rows).collect()
    assert (row["duplicate"], row["illegal"], row["gaps"]) == (199_999, 199_999, 0)
    assert row["audit"] == "K" + "D" * 199_999 + "I" and row["cost"] == 4 * 199_999 + 3


def test_very_long_texts(spark):
    long = "word " * 400_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long + "."), (1, 2, "user", long), (1, 3, "assistant", "." + " " * 10**6)]
    assert results(spark, rows) == brute_force(rows, {1})


def test_turns_at_the_ends_of_their_type(spark):
    rows = [(1, -(2**63), "user", "A."), (1, 2**63 - 1, "assistant", "B.")]
    assert [row[1] for row in results(spark, rows)] == [2**63 - 1]


def test_conversations_without_rows_left(spark):
    rows = spark.createDataFrame([], SCHEMA)
    ids = spark.createDataFrame([(None,), (3,), (3,)], "conv_id long")
    empty = hashlib.sha256(b"").hexdigest()
    got = sorted((tuple(row[n] for n in NAMES) for row in digests(rows, ids).collect()), key=repr)
    assert got == sorted([(i, 0, 0, 0, 0, 0, 0, "", empty) for i in (3, None)], key=repr)
    assert digests(rows, rows).collect() == [] and repair(rows).collect() == []


def test_damage_by_crc32(spark):
    import zlib

    rows = [(conv, turn, role, "A. B? C!") for conv in (None, *range(30)) for turn in (None, *range(6)) for role in ("assistant", None)]
    want = []
    for conv, turn, role, text in rows:
        case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role = " " if role is None else role
        row = (conv, turn, "user" if case == 4 else role, {1: "", 2: "A B C"}.get(case, text))
        want += [row] * {0: 0, 3: 2}.get(case, 1)
    got = [tuple(row) for row in damaged(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert NOTHING == 0
