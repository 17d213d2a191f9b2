"""Line dedup against a plain rereading of its law."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ridetide.llm import linededup
from ridetide.llm.linededup import SortedRuns, digests, keyed_lines, line_key, run_of, without_repeated_lines

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BLANK = " \t\n\x0b\f\r"
UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def key(line: str) -> str:
    return line.strip(BLANK).translate(UPPER)


def brute_force(rows: list[tuple]) -> list[tuple]:
    holders = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if doc_id is not None and len(key(line)) >= 20:
                holders[key(line)].add(doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [
            line
            for line in lines
            if doc_id is None or len(holders[key(line)]) < 3 or doc_id == max(holders[key(line)])
        ]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def made(seed: int, documents: int) -> list[tuple]:
    pick = random.Random(seed)
    common = [f"The same line as in other texts, number {n} Ä" for n in range(12)] + ["Too short to count"]
    rows = [(None, common[0]), (3, None), (4, ""), (5, "\n\n"), (6, common[0] + "\n" + common[0])]
    for doc_id in range(10, 10 + documents):
        lines = [
            pick.choice([" ", "\t", ""]) + pick.choice([str.upper, str.lower, str])(pick.choice(common)) + pick.choice(["", " \r"])
            if pick.random() < 0.6
            else f"A line of its own in the text {doc_id} at {n}"
            for n in range(pick.randint(0, 9))
        ]
        rows.append((doc_id, "\n".join(lines)))
    return rows + rows[7:9] + [(12, common[1] + "\n" + common[2]), (12, common[1] + "\n" + common[2])]


@pytest.mark.parametrize(("batches", "fan"), [(1, 2), (4, 2), (7, 3)])
def test_equals_the_law(spark, batches, fan):
    rows = made(batches, 60)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, digests(docs, batches, fan).collect()), key=repr)
    assert got == sorted([(d, n, lost, sha(kept)) for d, n, lost, kept in brute_force(rows)], key=repr)


def test_returns_the_columns_given(spark):
    rows = made(3, 30)
    names = ["word", "bits", "lines", "given", "marked", "positions", "kept", "place", "text_key", "a.b"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select(
        "*", *[F.lit(name).alias(name) for name in names]
    )
    out = without_repeated_lines(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    kept = sorted(((row["doc_id"], row["text"] or "") for row in out.collect()), key=repr)
    assert kept == sorted(((d, text) for d, _, _, text in brute_force(rows)), key=repr)
    assert all(row[name] == name for row in out.collect() for name in names)


def test_a_text_that_loses_nothing_stays_null(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert {tuple(r) for r in without_repeated_lines(docs).collect()} == {(1, None), (2, "")}


def test_no_documents(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert digests(docs).collect() == [] and without_repeated_lines(docs).collect() == []


def test_runs_are_levelled_and_anti_joined(spark):
    """Three batches of four documents: a settled line is in no later run, and full levels are folded."""
    line = "a line that every document holds"
    runs = SortedRuns(fan=2)
    for batch in range(3):
        low = 100 - 10 * batch
        rows = [(doc_id, f"{line}\nits own line, number {doc_id:04d}") for doc_id in range(low, low + 4)]
        runs.add(keyed_lines(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [len(level) for level in runs.levels] == [1, 1]
    folded, last = runs.levels[1][0].collect(), runs.levels[0][0].collect()
    assert sorted(row["docs"] for row in folded) == [1] * 8 + [4]
    assert [row["docs"] for row in last] == [1] * 4
    assert [row["last"] for row in runs.repeated().collect()] == [103]


def test_runs_are_sorted(spark):
    docs = spark.createDataFrame(made(9, 200), "doc_id long, text string")
    runs = SortedRuns()
    runs.add(keyed_lines(docs))
    (run,) = runs.runs()
    parts = run.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("n"), "hash").collect()
    by_part = defaultdict(list)
    for row in sorted(parts, key=lambda row: row["n"]):
        by_part[row["part"]].append(row["hash"])
    assert all(hashes == sorted(hashes) for hashes in by_part.values())


def test_key_lowers_plain_letters_only(spark):
    lines = ["\t ÄÖ Straße ABC\x0b\f\r ", "Plain ASCII Text ", " A ", "İI", ""]
    rows = spark.createDataFrame([(n, line) for n, line in enumerate(lines)], "n int, line string")
    got = [row[0] for row in rows.orderBy("n").select(line_key(F.col("line"))).collect()]
    assert got == [key(line) for line in lines]


def test_a_hot_line_is_counted_before_the_shuffle(spark):
    """However many documents hold a line, the exchange by hash gets a row per task."""
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("one line in all of the documents").alias("text"))
    (row,) = run_of(keyed_lines(docs)).collect()
    assert (row["docs"], row["last"]) == (30_000, 29_999)
    (gone,) = digests(docs).agg(F.sum("n_dropped")).collect()
    assert gone[0] == 29_999


def test_plan_runs_no_python(spark, sf_dir):
    plan = linededup.op13_line_dedup(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))
