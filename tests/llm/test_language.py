from __future__ import annotations

import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ridetide.llm import language
from ridetide.llm.common import table


def test_whole_table_held_out(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = language.op5_language_id(spark, "/root/testdata/sf0.01").collect()
    assert {r["doc_id"] for r in rows} == set(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held)


def plain_grams(text):
    out = []
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        padded = f" {word} "
        out += [padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1) if padded[i : i + n].strip()]
    return out


def test_profiles_and_distances_by_hand(spark):
    rng = random.Random(2)
    rows = [("".join(rng.choice("abcdé 1,") for _ in range(60)), rng.choice(["x", "y", None])) for _ in range(50)]
    profiles = language.learn(spark.createDataFrame(rows, "text string, lang string"), 30)
    for name in ("x", "y"):
        counts = Counter(g for text, lang in rows if lang == name for g in plain_grams(text))
        own = [language.spelled(g) for g in profiles[name]]
        assert [counts[g] for g in own] == sorted(counts.values(), reverse=True)[:30]
    ranker = language.Ranker(profiles, 30)
    text = "abba dab 7 cédé"
    counts = Counter(plain_grams(text))
    assert Counter(language.spelled(int(g)) for g in language.grams(text)) == counts
    found = ranker.distances(language.grams(text))
    code = {language.spelled(int(g)): int(g) for g in language.grams(text)}
    order = sorted(counts, key=lambda g: (-counts[g], code[g]))[:30]
    for row, name in enumerate(ranker.languages):
        total = 0.0
        for g in order:
            same = [i for i, other in enumerate(order) if counts[other] == counts[g]]
            rank = sum(same) / len(same)
            total += abs(profiles[name].index(code[g]) - rank) if code[g] in profiles[name] else 30
        assert found[row] == pytest.approx(total / (len(order) * 30))


def test_odd_rows(spark):
    texts = [(1, None, "a"), (2, "", "a"), (3, "12 .. 3", "a"), (4, "abc abd", "a"), (10, "xyz xyy", "b"), (None, "abc abd", None),
             (10, "xyz xyy", "b"), (7, "abc " * 50_000, None), (8, "漢字", None)]
    docs = spark.createDataFrame([(*t, 1, 2.0) for t in texts], "doc_id long, text string, lang string, score int, gram double")
    got = [(r["doc_id"], r["lang_pred"]) for r in language.identified(docs).collect()]
    assert sorted(got, key=str) == sorted(
        [(1, "und"), (2, "und"), (3, "und"), (4, "a"), (10, "b"), (None, "a"), (10, "b"), (7, "a"), (8, "a")], key=str
    )
    assert language.identified(docs.where(F.lit(False))).count() == 0
    none = language.identified(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in none} == {("und", 0.0)}
    kept = language.in_known_language(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == sorted([0, 4, 10, 10, 7])
