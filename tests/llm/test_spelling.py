"""Spelling variants against a comparison of all words with all words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ridetide.llm.spelling import near_pairs, roots, variants, vocabulary

COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def one_edit(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def counted(rows: list[tuple]) -> dict[str, int]:
    counts: Counter = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            mark = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if mark % 31 == 0:
                run = run[: mark % len(run)] + run[mark % len(run) + 1 :]
            counts[run] += 1
    return {word: n for word, n in counts.items() if len(word) >= 7 and n >= 2}


def brute_force(rows: list[tuple]) -> list[tuple]:
    words = counted(rows)
    near = {a: [b for b in words if one_edit(a, b)] for a in words}
    form = {}
    for word, others in near.items():
        best = min(others, key=lambda other: (-words[other], other.encode()), default=None)
        form[word] = best if best and words[best] >= 10 * words[word] else None
    out = []
    for word, n in words.items():
        root = word
        while form[root]:
            root = form[root]
        out.append((word, form[word], root, n, len(near[word]), words.get(form[word])))
    return sorted(out)


def misspelt(pick: random.Random, word: str) -> str:
    at, letter = pick.randrange(len(word) + 1), pick.choice("abéü")
    return pick.choice([word[:at] + letter + word[at:], word[:at] + word[at + 1 :], word[:at] + letter + word[at + 1 :]])


def made(seed: int) -> list[tuple]:
    pick = random.Random(seed)
    stems = ["".join(pick.choice("abéü") for _ in range(pick.randint(6, 11))) for _ in range(12)] + ["ab" * 40, "aaaaaaa"]
    rows = [(None, "aaaaaaa aaaaaaa"), (1, None), (2, ""), (3, "short ones here")]
    for doc_id in range(10, 60):
        words = []
        for _ in range(40):
            word = pick.choice(stems[: pick.randint(1, len(stems))])
            for _ in range(pick.choice([0, 0, 0, 0, 1, 1, 2])):
                word = misspelt(pick, word)
            words.append(pick.choice([str, str.upper])(word) if word.isascii() else word)
        rows.append((doc_id, pick.choice([" ", ",\n", "1"]).join(words)))
    return rows + rows[10:13]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_a_comparison_of_all_words(spark, seed):
    rows = made(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {name: F.lit(1) for name in ("word", "n", "gram", "form", "raw")}
    )
    got = sorted(tuple(row[c] for c in COLUMNS) for row in variants(docs).collect())
    assert got == brute_force(rows)
    assert any(row[1] for row in got) and any(row[4] > 1 for row in got)


def test_every_place_and_kind_of_edit_is_found(spark):
    """All edits of words of odd and even length, the shortest included, in both orders."""
    words = {"abcdefg", "abcdefgh", "bbbbbbb", "áéíóúñç"}
    for word in list(words):
        for at in range(len(word) + 1):
            words |= {word[:at] + c + word[at:] for c in "abz"} | {word[:at] + c + word[at + 1 :] for c in "abz"}
            words.add(word[:at] + word[at + 1 :])
    words = sorted(word for word in words if len(word) >= 7)
    table = spark.createDataFrame([(w, 2) for w in words], "word string, n long").withColumn("length", F.char_length("word"))
    got = sorted(tuple(sorted((row["a"], row["b"]))) for row in near_pairs(table).collect())
    assert got == sorted((a, b) for i, a in enumerate(words) for b in words[i + 1 :] if one_edit(a, b))


def test_forms_are_followed_to_the_last(spark):
    links = [(f"w{n}", f"w{n + 1}") for n in range(9)] + [(f"x{n}", "w4") for n in range(50)]
    got = {row["word"]: row["root"] for row in roots(spark.createDataFrame(links, "word string, form string")).collect()}
    assert got == {word: "w9" for word, _ in links}


def test_a_form_must_occur_ten_times_as_often(spark):
    # Few documents, and none of these (document, word) pairs is marked.
    rows = [(100 + n, "handling " * 5) for n in range(4)] + [(200, "handeling handeling"), (201, "hanling hanling hanling")]
    assert counted(rows) == {"handling": 20, "handeling": 2, "hanling": 3}
    got = {row["word"]: row["form"] for row in variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {"handling": None, "handeling": "handling", "hanling": None}


def test_a_very_long_text_and_a_very_long_word(spark):
    rows = [(5, "wordings " * 200_000 + "z" * 100_000), (6, "z" * 100_000 + " " + "z" * 100_001)]
    got = {row["word"]: row for row in variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {word: row["n"] for word, row in got.items()} == counted(rows)
    assert max(row["n"] for row in got.values()) == 200_000


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert variants(docs).collect() == [] and vocabulary(docs).collect() == []


def test_bytes_that_are_no_utf8_end_a_word(spark):
    docs = spark.sql("SELECT 1L AS doc_id, cast(X'6162636465666768FF6162636465666768' AS string) AS text")
    assert [tuple(row) for row in variants(docs).collect()] == [("abcdefgh", None, "abcdefgh", 2, 0, None)]
