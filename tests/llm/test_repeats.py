from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from ridetide.llm import repeats
from ridetide.llm.common import table
from ridetide.llm.repeats import Shard, digests, find, without_repeats


def brute(texts: dict[int, str | None], window: int) -> dict[int, tuple[int, int, str]]:
    first: dict[tuple, int] = {}
    out = {}
    for doc_id in sorted(texts):
        words = (texts[doc_id] or "").encode().split()
        gone = set()
        for start in range(len(words) - window + 1):
            key = tuple(words[start : start + window])
            if first.setdefault(key, doc_id) < doc_id:
                gone.update(range(start, start + window))
        kept = [w for i, w in enumerate(words) if i not in gone]
        out[doc_id] = (len(words), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def result(df):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect()}


def test_whole_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    wanted = brute({r["doc_id"]: r["text"] for r in docs.collect()}, 50)
    assert result(digests(docs)) == wanted
    assert sum(n for _, n, _ in wanted.values()) > 1000


def test_planted_passages(spark):
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(40))
    passages = [[word() for _ in range(n)] for n in (49, 50, 51, 80, 300)]
    texts: dict[int, str | None] = {}
    for doc_id in range(120):
        words = [word() for _ in range(rng.randrange(90))]
        for passage in rng.sample(passages, rng.randrange(4)):
            at, low = rng.randrange(len(words) + 1), rng.randrange(3)
            words[at:at] = passage[low : len(passage) - rng.randrange(3)]
        texts[doc_id] = rng.choice([" ", "\n", " \t "]).join(words)
    texts |= {200: None, 201: "", 202: "x " * 400, 203: "x " * 60, 204: texts[7], 205: texts[7], 206: "y " * 49, 207: "y " * 49}
    docs = spark.createDataFrame([(k, v, "c", 1) for k, v in texts.items()], "doc_id long, text string, raw string, phrases int")
    assert result(digests(docs)) == brute(texts, 50)


def test_repeated_rows_null_ids_and_empty(spark):
    text = " ".join(f"w{i}" for i in range(70))
    rows = [(1, text), (1, text), (None, text), (2, "a " + text + " b"), (2, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in digests(docs).collect())
    assert got == [(0, 70, 0), (1, 70, 0), (1, 70, 0), (2, 1, 0), (2, 72, 70)]
    assert digests(docs.where(F.lit(False))).count() == 0


def test_texts_and_spans(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    texts = {1: passage, 2: f"  one\ntwo {passage}\n\nthree  four\n", 3: passage, 4: "left\n alone "}
    columns = "doc_id long, text string, lang string, n_chars long, kept_text string, spans int, text_key int"
    docs = spark.createDataFrame([(k, v, "en", 3, "own", 1, 2) for k, v in texts.items()], columns)
    assert without_repeats(docs).columns == docs.columns
    kept = {r["doc_id"]: r for r in without_repeats(docs).collect()}
    assert {k: r["text"] for k, r in kept.items()} == {1: passage, 2: "  one\ntwo three  four", 4: "left\n alone "}
    assert (kept[1]["n_chars"], kept[2]["n_chars"]) == (3, len("  one\ntwo three  four"))
    spans = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in find(docs)[1].collect()}
    assert spans == {2: [(2, 62)], 3: [(0, 60)]}


def test_automaton_finds_every_occurrence():
    rng = random.Random(5)
    words = [rng.choice([b"a", b"b", b"\xff\xfe", b"d"]) for _ in range(3000)]
    phrases = {b" ".join(words[at : at + 6]) for at in rng.sample(range(2990), 40)}
    found = Shard(phrases, 6).occurrences(words).tolist()
    assert found == [at for at in range(len(words) - 5) if b" ".join(words[at : at + 6]) in phrases]
    assert len(found) > 40
    assert Shard([], 6).occurrences(words).tolist() == []


def test_blocks_of_few_words(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK_WORDS", 300)
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(120)]
    texts = {}
    for doc_id in range(60):
        low = rng.randrange(60)
        own = [f"w{rng.randrange(200)}" for _ in range(rng.randrange(40))]
        texts[doc_id] = " ".join(own + passage[low : low + rng.randrange(45, 61)] + own[:5])
    texts |= {70: texts[3], 71: texts[3], 72: None, 73: "short"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert result(digests(docs)) == brute(texts, 50)
