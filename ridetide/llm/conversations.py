"""Conversation structure repair: the cheapest edits that make the roles of a conversation alternate.

A repaired conversation is empty or a system turn, if it has one, and then pairs of a user and an assistant
turn. Where an edit sequence may go on is one of four states: nothing yet, after the system turn, after a
user turn, after an assistant turn. Hirschberg's divide and conquer finds the sequence: forward and
backward vectors of four costs meet in the middle, the crossing of least cost is taken, of several the
one whose edits are least in ASCII, and both halves are solved alike, in linear space.

Conversations of any length are cut into chunks. Per chunk the forward vectors of all four start states say
what the chunk does to a conversation, so that crossings between chunks are chosen the same way, first
between the chunks of a partition and then between partitions, and all chunks are reconstructed in
parallel.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ridetide.llm.common import small_batches, table, written

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ACCEPT = -1
"""As the end of a chunk: that of its conversation."""

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
"""Costs; a truncated turn that is not deleted costs extra."""

CHUNK_ROWS = 512
CHUNK_CHARS = 1 << 20
BLANK = " \t\n\x0b\f\r"

_FAR = 1 << 60
_NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
"""The state after a turn of the only role that may be put there."""
_NAMES = {USER: "user", ASSISTANT: "assistant"}
_ENDS = {NOTHING: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
"""What is inserted after the last row."""
_KEPT = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}


class Turn(NamedTuple):
    """A row and its exact repeats, which follow it."""

    initial: str
    must_go: bool
    truncated: bool
    copies: int


def _steps(initial: str, must_go: bool, truncated: bool) -> list[list[tuple[int, int, str]]]:
    """By state before a row: (state after, cost, edits) of the best way there. The edits end with the row's."""
    extra = TRUNCATED if truncated else 0
    steps = []
    for before in range(4):
        best: dict[int, tuple[int, str]] = {}
        here = before
        # Three insertions in a row would lead back to a state passed before.
        for inserted in range(3):
            edits, cost = "I" * inserted, INSERT * inserted
            ways = [(here, cost + DELETE, edits + "D")]
            if not must_go:
                ways.append((_NEXT[here], cost + REROLE + extra, edits + "R"))
                if here in _KEPT.get(initial, {}):
                    ways.append((_KEPT[initial][here], cost + extra, edits + "K"))
            for after, total, word in ways:
                best[after] = min(best.get(after, (_FAR, "")), (total, word))
            here = _NEXT[here]
        steps.append([(after, cost, word) for after, (cost, word) in best.items()])
    return steps


_STEPS = {
    (initial, must_go, truncated): _steps(initial, must_go, truncated)
    for initial in ("s", "u", "a", "")
    for must_go in (False, True)
    for truncated in (False, True)
}


def steps_of(turn: Turn) -> list[list[tuple[int, int, str]]]:
    return _STEPS[turn.initial if turn.initial in _KEPT else "", turn.must_go, turn.truncated]


Vector = tuple[list[int], list[int]]
"""Costs of the four states, and how their edits so far rank among each other in ASCII order.

Edits that lead to different states differ before either ends, since both end with the same row's edit. So
the rank decides between conversations as a whole, whatever follows.
"""


def _ranked(reached: dict[int, tuple[int, tuple]]) -> Vector:
    costs, ranks = [_FAR] * 4, [0] * 4
    for rank, state in enumerate(sorted(reached, key=lambda state: reached[state][1])):
        costs[state], ranks[state] = reached[state][0], rank
    return costs, ranks


def start_at(state: int) -> Vector:
    return _ranked({state: (0, ())})


def forward(turns: list[Turn], low: int, high: int, start: int) -> Vector:
    """Costs to be in each state after the rows from ``low`` to before ``high``."""
    vector = start_at(start)
    for turn in turns[low:high]:
        (costs, ranks), steps = vector, steps_of(turn)
        repeats = DELETE * (turn.copies - 1)
        reached: dict[int, tuple[int, tuple]] = {}
        for before in range(4):
            if costs[before] >= _FAR:
                continue
            for after, cost, word in steps[before]:
                way = (costs[before] + cost + repeats, (ranks[before], word))
                if after not in reached or way < reached[after]:
                    reached[after] = way
        vector = _ranked(reached)
    return vector


def end_costs(end: int) -> list[int]:
    """Cost still to come in each state: none in the state wanted, or that of the last insertions."""
    if end == ACCEPT:
        return [INSERT * len(_ENDS[state]) for state in range(4)]
    return [0 if state == end else _FAR for state in range(4)]


def backward(turns: list[Turn], low: int, high: int, ends: list[int]) -> list[int]:
    """Costs from each state before the row ``low`` to the end."""
    costs = ends
    for turn in reversed(turns[low:high]):
        steps, repeats = steps_of(turn), DELETE * (turn.copies - 1)
        costs = [min(cost + repeats + costs[after] for after, cost, _ in steps[before]) for before in range(4)]
    return costs


def crossing(vector: Vector, rest: list[int]) -> int:
    """The state in which the cheapest edits, of these the least in ASCII, pass from one part to the next."""
    costs, ranks = vector
    return min(range(4), key=lambda state: (costs[state] + rest[state], ranks[state]))


def edits(turns: list[Turn], start: int, end: int) -> list[str]:
    """The edits of each row, insertions before it included, by Hirschberg's divide and conquer."""
    out = [""] * len(turns)

    def solve(low: int, high: int, start: int, ends: list[int]) -> None:
        if high - low == 1:
            turn = turns[low]
            _, _, word = min((cost + ends[after], word, word) for after, cost, word in steps_of(turn)[start])
            out[low] = word + "D" * (turn.copies - 1)
            return
        middle = (low + high) // 2
        state = crossing(forward(turns, low, middle, start), backward(turns, middle, high, ends))
        solve(low, middle, start, end_costs(state))
        solve(middle, high, state, ends)

    if turns:
        solve(0, len(turns), start, end_costs(end))
    return out


Matrix = list[Vector]
"""The forward vector from each start state."""


def matrix(turns: list[Turn]) -> Matrix:
    return [forward(turns, 0, len(turns), start) for start in range(4)]


def through(vector: Vector, part: Matrix) -> Vector:
    """The forward vector after one more part."""
    reached: dict[int, tuple[int, tuple]] = {}
    for before in range(4):
        if vector[0][before] >= _FAR:
            continue
        costs, ranks = part[before]
        for after in range(4):
            if costs[after] < _FAR:
                way = (vector[0][before] + costs[after], (vector[1][before], ranks[after]))
                if after not in reached or way < reached[after]:
                    reached[after] = way
    return _ranked(reached)


def composed(parts: list[Matrix]) -> Matrix:
    vectors = [start_at(start) for start in range(4)]
    for part in parts:
        vectors = [through(vector, part) for vector in vectors]
    return vectors


def ends_of(parts: list[Matrix], start: int, end: int) -> list[tuple[int, int]]:
    """(start, end) of each part on the best way, by the same divide and conquer over the parts."""
    out: list[tuple[int, int]] = []

    def solve(low: int, high: int, start: int, end: int) -> None:
        if high - low == 1:
            out.append((start, end))
            return
        middle = (low + high) // 2
        vector = start_at(start)
        for part in parts[low:middle]:
            vector = through(vector, part)
        rest = end_costs(end)
        for part in reversed(parts[middle:high]):
            rest = [min(cost + more for cost, more in zip(part[before][0], rest, strict=True)) for before in range(4)]
        state = crossing(vector, rest)
        solve(low, middle, start, state)
        solve(middle, high, state, end)

    if parts:
        solve(0, len(parts), start, end)
    return out


# Rows


def _bare(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANK))


def judged(rows: DataFrame) -> DataFrame:
    """Each different row of a conversation once, with ``copies`` and its faults.

    Identical rows are combined before the shuffle, so one of which there are very many is cheap. A row is a
    duplicate if its role and text are in the conversation at an earlier turn.
    """
    plain = rows.select(
        F.col("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
    )
    once = written(
        plain.groupBy("conv_id", "turn", "role", "text")
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("said", F.sha2(F.concat_ws("\n", "role", "text"), 256)),
        "turns",
    )
    said = written(
        once.groupBy("conv_id", "said")
        .agg(F.count(F.lit(1)).alias("times"), F.min("turn").alias("first"), F.count("turn").alias("known"))
        .where("times > 1")
        .select(
            F.col("conv_id").alias("said_in"),
            F.col("said").alias("said_again"),
            F.when(F.col("known") == F.col("times"), F.col("first")).alias("first"),
        ),
        "said",
    )
    again = once["said"].eqNullSafe(said["said_again"]) & once["conv_id"].eqNullSafe(said["said_in"])
    # Nulls come first: where one row has no turn, all others are duplicates.
    duplicate = F.col("said_again").isNotNull() & ~F.col("first").eqNullSafe(F.col("turn"))
    ending = F.right(_bare(F.col("text")), F.lit(1))
    return once.join(said, again, "left").select(
        "conv_id",
        "turn",
        "role",
        "text",
        "copies",
        F.left("role", F.lit(1)).alias("initial"),
        (_bare(F.col("text")) == "").alias("blank"),
        duplicate.alias("duplicate"),
        (~ending.isin(".", "!", "?")).alias("truncated"),
    )


_ROW = "turn long, role string, text string, copies long, initial string, blank boolean, duplicate boolean, truncated boolean"
_CHUNK = f"conv_id {{kind}}, part long, seq long, open boolean, rows array<struct<{_ROW}>>"
_PIECE = (
    "seq long, cost long, audit string, rows array<struct<edit string, role string, text string>>, blank long, duplicate long,"
    " truncated long, illegal long, first_initial string, last_initial string, first_turn long, last_turn long, turns long"
)


def turn_of(row: dict) -> Turn:
    return Turn(row["initial"], row["blank"] or row["duplicate"], row["truncated"], row["copies"])


def _chunked(schema: pa.Schema, chunk_rows: int):
    """Chunks of the conversations of a partition that is sorted by conversation and turn.

    A chunk is open if its conversation may go on outside of it: in another chunk, or in the partition before
    or after this one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held, chars, conversation, parts, part = 0, [], 0, None, 0, None

        def chunk(is_open: bool) -> pa.RecordBatch:
            row = {"conv_id": conversation, "part": part, "seq": (part << 40) + made, "open": is_open, "rows": held}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for row in batch.to_pylist():
                part = row.pop("part")
                conv_id = row.pop("conv_id")
                new = held and conv_id != conversation
                if new or len(held) >= chunk_rows or chars >= CHUNK_CHARS:
                    # The first conversation of the partition may have begun before it.
                    yield chunk(not new or parts > 0 or made == 0)
                    parts, made, held, chars = 0 if new else parts + 1, made + 1, [], 0
                conversation = conv_id
                held.append(row)
                chars += len(row["text"])
        if held:
            yield chunk(True)

    return run


def _piece(seq: int, rows: list[dict], start: int, end: int) -> dict:
    """The edits of a chunk, the rows they give, and what the digest of the conversation needs to know."""
    turns = [turn_of(row) for row in rows]
    words = edits(turns, start, end)
    state, kept, cost = start, [], 0
    for row, word in zip(rows, words, strict=True):
        for edit in word:
            if edit in "IR":
                state = _NEXT[state]
                kept.append({"edit": edit, "role": _NAMES[state], "text": row["text"] if edit == "R" else ""})
            elif edit == "K":
                state = _KEPT[row["initial"]][state]
                kept.append({"edit": edit, "role": row["role"], "text": row["text"]})
            cost += {"I": INSERT, "R": REROLE, "D": DELETE, "K": 0}[edit]
            cost += TRUNCATED if edit in "RK" and row["truncated"] else 0
    if end == ACCEPT:
        words.append(_ENDS[state])
        for _ in words[-1]:
            state = _NEXT[state]
            kept.append({"edit": "I", "role": _NAMES[state], "text": ""})
            cost += INSERT
    initials = [row["initial"] for row in rows]
    repeats = sum(row["copies"] - 1 for row in rows)
    numbers = sorted({row["turn"] for row in rows if row["turn"] is not None})
    return {
        "seq": seq,
        "cost": cost,
        "audit": "".join(words),
        "rows": kept,
        "blank": sum(row["copies"] for row in rows if row["blank"]),
        "duplicate": sum(row["copies"] - (not row["duplicate"]) for row in rows if not row["blank"]),
        "truncated": sum(row["truncated"] for row in rows if not row["blank"] and not row["duplicate"]),
        # A row and its repeat have one initial, and no initial may follow itself.
        "illegal": repeats + sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        "first_initial": initials[0],
        "last_initial": initials[-1],
        "first_turn": numbers[0] if numbers else None,
        "last_turn": numbers[-1] if numbers else None,
        "turns": len(numbers),
    }


def _reconstructed(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                piece = _piece(row["seq"], row["rows"], row["start"], row["end"])
                yield pa.RecordBatch.from_pylist([{"conv_id": row["conv_id"], **piece}], schema=schema)

    return run


def _arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromDDL(ddl))


_MATRIX = "costs array<long>, ranks array<long>"


def _flat(part: Matrix) -> dict:
    return {"costs": [c for costs, _ in part for c in costs], "ranks": [r for _, ranks in part for r in ranks]}


def _matrix_of(row: dict) -> Matrix:
    return [(row["costs"][4 * s : 4 * s + 4], row["ranks"][4 * s : 4 * s + 4]) for s in range(4)]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The matrix of each chunk."""
    for batch in batches:
        rows = [_flat(matrix([turn_of(row) for row in rows])) for rows in batch["rows"].to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                *(batch[name] for name in ("conv_id", "part", "seq")),
                pa.array([row["costs"] for row in rows], pa.list_(pa.int64())),
                pa.array([row["ranks"] for row in rows], pa.list_(pa.int64())),
            ],
            names=["conv_id", "part", "seq", "costs", "ranks"],
        )


def _spans(group: pa.Table) -> pa.Table:
    """One matrix for the chunks of a conversation in one partition; ``seq`` is that of the first."""
    rows = sorted(group.to_pylist(), key=lambda row: row["seq"])
    flat = _flat(composed([_matrix_of(row) for row in rows]))
    kind = pa.list_(pa.int64())
    return pa.table(
        [
            group["conv_id"].slice(0, 1),
            pa.array([rows[0]["seq"]]),
            pa.array([flat["costs"]], kind),
            pa.array([flat["ranks"]], kind),
        ],
        names=["conv_id", "seq", "costs", "ranks"],
    )


def _placed(group: pa.Table) -> pa.Table:
    """Where each part of a conversation, or of a span of it, starts and ends."""
    rows = sorted(group.to_pylist(), key=lambda row: row["seq"])
    first = rows[0]
    at = ends_of([_matrix_of(row) for row in rows], first.get("start", NOTHING), first.get("end", ACCEPT))
    return pa.table(
        [pa.array([row["seq"] for row in rows]), *(pa.array([s[i] for s in at], pa.int32()) for i in (0, 1))],
        names=["seq", "start", "end"],
    )


def _open_places(chunks: DataFrame, kind: str) -> DataFrame:
    """(seq, start, end) of the open chunks, a few of each partition.

    Crossings are chosen between the partitions of a conversation and then between the chunks in each, so no
    task gets more than one row per partition, or per chunk of one partition.
    """
    nodes = written(chunks.where("open").mapInArrow(_measured, f"conv_id {kind}, part long, seq long, {_MATRIX}"), "nodes")
    spans = written(nodes.groupBy("conv_id", "part").applyInArrow(_spans, f"conv_id {kind}, seq long, {_MATRIX}"), "spans")
    ends = "seq long, start int, end int"
    across = written(spans.groupBy("conv_id").applyInArrow(_placed, ends), "across")
    # A span is known by the seq of its first chunk.
    firsts = nodes.groupBy("conv_id", "part").agg(F.min("seq").alias("seq")).drop("conv_id")
    # Several conversations of a partition can be open: the span of a chunk is the last that starts before it.
    of_part = firsts.groupBy("part").agg(F.sort_array(F.collect_list("seq")).alias("firsts"))
    span = F.element_at(F.filter("firsts", lambda first: first <= F.col("seq")), -1)
    within = (
        nodes.join(of_part, "part")
        .withColumn("span", span)
        .join(across.withColumnRenamed("seq", "span"), "span")
        .groupBy("span")
        .applyInArrow(_placed, ends)
    )
    return written(within, "places")


def repair(rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The repaired pieces of the conversations (conv_id, turn, role, text), in the order of ``seq``.

    Columns: conv_id, seq, cost, audit (the initials of the edits Keep, Rerole, Delete and Insert), rows (edit,
    role and text of every turn that the repaired conversation has), the counts of faults, and the initials and
    turns at both ends of the piece. A conversation is one piece, or several if it is long or lies where two
    partitions meet. Its rows are taken by turn, nulls first, then by role and text in code-point order.

    A null role or text is one space; a null conv_id is a conversation like others. Blank rows and those whose
    role and text were there before are always deleted. Repeated rows are repeats of one another. Other columns
    are not read. No rows give no pieces.
    """
    spark = rows.sparkSession
    kind = rows.schema["conv_id"].dataType.simpleString()
    with small_batches(spark):
        sorted_rows = (
            judged(rows)
            .repartitionByRange("conv_id", "turn", "role", "text")
            .sortWithinPartitions("conv_id", "turn", "role", "text")
            .withColumn("part", F.spark_partition_id().cast("long"))
        )
        chunk = _CHUNK.format(kind=kind)
        chunks = written(sorted_rows.mapInArrow(_chunked(_arrow_schema(chunk), chunk_rows), chunk), "chunks")
        piece = f"conv_id {kind}, {_PIECE}"
        whole = chunks.where("not open").select(
            "conv_id", "seq", "rows", F.lit(NOTHING).alias("start"), F.lit(ACCEPT).alias("end")
        )
        placed = chunks.where("open").select("conv_id", "seq", "rows").join(_open_places(chunks, kind), "seq")
        both = whole.unionAll(placed.select(*whole.columns))
        return written(both.mapInArrow(_reconstructed(_arrow_schema(piece)), piece), "pieces")


def repaired(pieces: DataFrame) -> DataFrame:
    """(conv_id, seq, position, edit, role, text): the turns of the repaired conversations."""
    return pieces.select("conv_id", "seq", F.posexplode("rows").alias("position", "row")).select(
        "conv_id", "seq", "position", "row.*"
    )


_DIGEST = (
    "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)


def _digested(schema: pa.Schema):
    """One row per conversation from its pieces, which come in order. Texts pass through, a piece at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conversation, held = None, None

        def digest() -> pa.RecordBatch:
            low, high = held.pop("first_turn"), held.pop("last_turn")
            gaps = 0 if low is None else high - low + 1 - held["turns"]
            row = {
                **held,
                "conv_id": conversation,
                "gaps": min(gaps, 2**63 - 1),
                "audit": "".join(held["audit"]),
                "repaired_sha256": held["hash"].hexdigest(),
            }
            return pa.RecordBatch.from_pylist([{name: row[name] for name in schema.names}], schema=schema)

        for batch in batches:
            for piece in batch.to_pylist():
                if held is None or piece["conv_id"] != conversation:
                    if held is not None:
                        yield digest()
                    conversation = piece["conv_id"]
                    held = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost", "turns"), 0)
                    held |= {"audit": [], "hash": hashlib.sha256(), "first_turn": None, "last_turn": None}
                    held |= {"begun": False, "last_initial": None}
                for name in ("blank", "duplicate", "truncated", "illegal", "cost", "turns"):
                    held[name] += piece[name]
                if held["last_initial"] is not None:
                    held["illegal"] += held["last_initial"] + piece["first_initial"] not in ("su", "ua", "au")
                held["last_initial"] = piece["last_initial"]
                if piece["first_turn"] is not None:
                    held["turns"] -= held["last_turn"] == piece["first_turn"]
                    held["last_turn"] = piece["last_turn"]
                    if held["first_turn"] is None:
                        held["first_turn"] = piece["first_turn"]
                held["audit"].append(piece["audit"])
                for row in piece["rows"]:
                    line = f"{row['role']}:{row['text']}"
                    held["hash"].update(("\n" * held["begun"] + line).encode())
                    held["begun"] = True
        if held is not None:
            yield digest()

    return run


def digests(rows: DataFrame, conversations: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """A row per conv_id of ``conversations``: gaps in the turns, faults, cost and audit of the cheapest
    repair of ``rows``, and the sha256 of the repaired ``role:text`` lines.

    The hash of a conversation is one run over its text, so its pieces pass through one task, a piece at a time.
    """
    spark = rows.sparkSession
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, {_DIGEST}"
    with small_batches(spark):
        in_order = repair(rows, chunk_rows).repartition("conv_id").sortWithinPartitions("conv_id", "seq")
        found = written(in_order.mapInArrow(_digested(_arrow_schema(schema)), schema), "digests")
    ids = conversations.select(F.col("conv_id").alias("id")).distinct()
    out = ids.join(found, F.col("id").eqNullSafe(found["conv_id"]), "left")
    empty = {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    return out.select(
        F.col("id").alias("conv_id"),
        *[F.coalesce(F.col(name), F.lit(empty.get(name, 0))).alias(name) for name in found.columns if name != "conv_id"],
    )


# The damage of the registered query

DROPPED, EMPTIED, UNENDED, DOUBLED, USERS = range(5)
DAMAGE = 20


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults by crc32 of conversation and turn: rows dropped, emptied, without full
    stops, doubled or with the role of the user."""

    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    plain = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"))
    case = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % DAMAGE
    return (
        plain.withColumn("case", case)
        .where(F.col("case") != DROPPED)
        .select(
            "conv_id",
            "turn",
            F.when(F.col("case") == USERS, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("case") == EMPTIED, "")
            .when(F.col("case") == UNENDED, F.translate("text", ".!?", ""))
            .otherwise(F.col("text"))
            .alias("text"),
            F.explode(F.when(F.col("case") == DOUBLED, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
        )
        .drop("copy")
    )


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return digests(damaged(conversations), conversations)
