from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridetide.llm import classlm
from ridetide.llm.common import table


def base(texts):
    held = {d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in texts}
    counts: Counter = Counter()
    for d, text in texts:
        if not held[d]:
            counts.update((text or "").encode().lower().split())
            counts[None] += 1
    total, types = sum(counts.values()), len(counts)
    out = []
    for d, text in texts:
        tokens = [*(text or "").encode().lower().split(), None]
        score = sum(math.log10((counts[t] + 1) / (total + types + 1)) for t in tokens)
        out.append((d, held[d], len(tokens), sum(counts[t] > 0 for t in tokens), total, score))
    return out


def compare(rows, wanted):
    order = lambda r: (r[0] is None, r[0] or 0, r[2])
    for got, want in zip(sorted(rows, key=order), sorted(wanted, key=order), strict=True):
        assert tuple(got)[:5] == want[:5]
        assert got["base_score"] == pytest.approx(want[5], rel=1e-9)


def test_whole_table_beats_unigrams(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = classlm.scored(docs).collect()
    compare(rows, base([(r["doc_id"], r["text"]) for r in docs.collect()]))
    held = [r for r in rows if r["held_out"]]
    tokens = sum(r["n_tokens"] for r in held)
    model, unigram = (10 ** (-sum(r[c] for r in held) / tokens) for c in ("score", "base_score"))
    assert model < 0.7 * unigram


def test_odd_rows(spark):
    texts = [(i, random.Random(i).choice(["a b c", "b c a a", "x y", None, "", "É é"])) for i in range(60)]
    texts += [(None, "a b"), (3, "A\tB"), (3, "A\tB"), (70, "unseen " * 30_000)]
    docs = spark.createDataFrame([(*t, 1, "w") for t in texts], "doc_id long, text string, n long, words string")
    compare(classlm.scored(docs).collect(), base(texts))
    assert classlm.scored(docs.where(F.lit(False))).count() == 0
    held = docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)
    rows = classlm.scored(held).collect()
    assert rows and all(r["train_tokens"] == 0 and r["n_known"] == 0 and np.isfinite(r["score"]) for r in rows)


def likelihood(follows, assigned, classes):
    member = np.eye(classes, dtype=np.int64)[assigned]
    joint = member.T @ follows @ member
    flat = lambda n: float((n * np.log(np.maximum(n, 1))).sum())
    return flat(joint) - flat(joint.sum(axis=0)) - flat(joint.sum(axis=1))


def test_exchange_reaches_a_local_optimum():
    rng = np.random.default_rng(6)
    kinds = rng.integers(1, 4, 25)
    kinds[0] = 0
    kind_chain = rng.dirichlet([0.2] * 4, 4)
    sequence, last = [0], 0
    for _ in range(20_000):
        last = rng.choice(4, p=kind_chain[last])
        sequence.append(int(rng.choice(np.flatnonzero(kinds == last))))
    sequence.append(0)
    follows = np.zeros((25, 25), dtype=np.int64)
    np.add.at(follows, (sequence[:-1], sequence[1:]), 1)
    assigned = classlm.exchange(follows, 4, 50)
    reached = likelihood(follows, assigned, 4)
    for unit in range(1, 25):
        for other in range(1, 4):
            moved = assigned.copy()
            moved[unit] = other
            assert likelihood(follows, moved, 4) <= reached + 1e-6
    assert reached >= likelihood(follows, kinds, 4) * (1 + 1e-3 * np.sign(-reached)) - 1e-6 * abs(reached)


def test_probabilities_sum_to_one():
    model = classlm.Model(10, 4, 2, 0.5, np.array([1, 1]), np.zeros((2, 2)), np.array([2, 8]), np.array([1, 3]))
    known = 10 ** model.emission(np.array([5, 2, 1]), np.array([1, 1, 1]))
    assert known.sum() + 10 ** model.emission(np.array([0]), np.array([1]))[0] == pytest.approx(1)


def plain_scores(texts, classes, frequent_share, own):
    """The model in plain Python: whole likelihoods for every move of a word, probabilities from tokens."""
    held = [zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in texts]
    split = [[*text.encode().lower().split(), None] for _, text in texts]
    chain = [None] + [t for words, h in zip(split, held, strict=True) if not h for t in words]
    counts = Counter(chain[1:])
    total = sum(counts.values())
    names = sorted(w for w, n in counts.items() if w is not None and n >= max(1.0, total * frequent_share))
    units = {None: 0, **{w: i for i, w in enumerate(names, 1)}}
    unit = lambda w: units[w] if w in units else 1 + len(names) + classlm.suffix(w)
    follows = np.zeros((1 + len(names) + classlm.SUFFIXES,) * 2, dtype=np.int64)
    pairs = Counter(zip(chain[:-1], chain[1:], strict=True))
    for (a, b), n in pairs.items():
        follows[unit(a), unit(b)] += n
    assigned = classlm.exchange(follows, classes)
    start = {w: int(assigned[unit(w)]) for w in {t for words in split for t in words}}

    def goodness(class_of):
        joint, size = Counter(), Counter()
        for (a, b), n in pairs.items():
            joint[class_of[a], class_of[b]] += n
        for (a, _), n in joint.items():
            size[a] += n
        return sum(n * math.log(n) for n in joint.values()) - 2 * sum(n * math.log(n) for n in size.values())

    final = dict(start)
    for word, n in counts.items():
        if word is None or word in units or n < own:
            continue
        reached = {c: goodness(start | {word: c}) for c in range(1, classes)}
        best = max(reached, key=lambda c: reached[c])
        if reached[best] > reached[start[word]] + 1e-9:
            final[word] = best
    of_class = Counter(final[t] for t in chain[1:])
    types = Counter(final[t] for t in counts)
    joint = Counter((final[a], final[b]) for a, b in zip(chain[:-1], chain[1:], strict=True))
    before = Counter(final[t] for t in chain[:-1])
    spread = Counter(counts[w] for w in counts if w is not None)
    discount = spread[1] / (spread[1] + 2 * spread[2]) if spread[1] and spread[2] else 0.5
    scores = []
    for words in split:
        score = 0.0
        for last, word in zip([None, *words[:-1]], words, strict=True):
            a, b = final[last], final[word]
            share = (of_class[b] + 1) / (total + classes)
            score += math.log10((joint[a, b] + classlm.BACKOFF * share) / (before[a] + classlm.BACKOFF))
            if counts[word]:
                score += math.log10((counts[word] - discount) / of_class[b])
            elif of_class[b]:
                score += math.log10(discount * types[b] / of_class[b])
        scores.append(score)
    return scores, sum(final[w] != start[w] for w in final)


def test_scores_equal_a_plain_model(spark, monkeypatch):
    monkeypatch.setattr(classlm, "FREQUENT", 1 / 25)
    monkeypatch.setattr(classlm, "OWN", 4)
    rng = random.Random(4)
    kinds = [[f"{k}{i}{rng.choice('xyz')}end" for i in range(18)] for k in "abcd"]
    texts = []
    for doc_id in range(90):
        kind, words = rng.randrange(4), []
        for _ in range(rng.randrange(60)):
            words.append(rng.choice(kinds[kind][: rng.choice([2, 18])]))
            kind = (kind + rng.choice([1, 1, 1, 2, 0])) % 4
        texts.append((doc_id, " ".join(words)))
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["score"] for r in classlm.scored(docs, classes=6).collect()}
    wanted, moved = plain_scores(texts, 6, 1 / 25, 4)
    assert moved > 5
    assert [got[d] for d, _ in texts] == pytest.approx(wanted, rel=1e-9)


def test_neighbours_are_whole_however_often_a_task_passes_them_on():
    rng = np.random.default_rng(1)
    keys = np.arange(5, dtype=np.uint64) + 7
    classes_of = np.array([0, 1, 2, 1, 2, 1])
    parts = [np.append(rng.integers(1, 6, 40), 0) for _ in range(6)]
    whole, sums = classlm.Neighbours(3), np.zeros((5, 7), dtype=np.int64)
    for part in parts:
        whole.add(part, classes_of, keys, np.array([1, 1, 0, 1, 1]))
        once = classlm.Neighbours(3)
        once.add(part, classes_of, keys, np.array([1, 1, 0, 1, 1]))
        for row in once.batch().to_pylist():
            slots, counts = np.frombuffer(row["slots"], np.uint16), np.frombuffer(row["counts"], np.uint32)
            sums[row["key"] - 7, slots] += counts
    for row in whole.batch().to_pylist():
        slots, counts = np.frombuffer(row["slots"], np.uint16), np.frombuffer(row["counts"], np.uint32)
        assert (sums[row["key"] - 7, slots] == counts).all() and sums[row["key"] - 7].sum() == counts.sum()
    assert not sums[2].any()


def test_gains_of_many_words_are_those_of_each():
    rng = np.random.default_rng(2)
    classes, units = 5, 60
    follows = rng.integers(0, 4, (units, units)) * (rng.random((units, units)) < 0.2)
    assigned = np.r_[0, rng.integers(1, classes, units - 1)]
    member = np.eye(classes, dtype=np.int64)[assigned]
    joint, right, left = member.T @ follows @ member, follows @ member, follows.T @ member
    # As many before as behind each, as in a text that ends where it began.
    own = np.diagonal(follows)
    each = np.arange(1, units)
    right[each, assigned[1:]] -= own[1:]
    left[each, assigned[1:]] -= own[1:]
    got = classlm.all_gains(joint.astype(float), assigned[1:], right[1:], left[1:], own[1:])
    for word in each:
        rest, old = joint.copy(), assigned[word]
        rest[old] -= right[word]
        rest[:, old] -= left[word]
        rest[old, old] -= own[word]
        wanted = classlm.gains(rest, right[word], left[word], own[word], left[word].sum() + own[word])
        difference = right[word].sum() - left[word].sum()
        if not difference:
            assert got[word - 1] == pytest.approx(wanted, abs=1e-6)
        else:
            others = [c for c in range(classes) if c != old]
            assert got[word - 1][others] == pytest.approx(wanted[others], abs=1e-6)


def test_every_training_word_is_exchanged_itself(spark):
    """Also rare words of one suffix get several classes, and every block has the same ones, and whole counts."""
    docs = table(spark, "/root/testdata/sf0.001", "documents").repartition(3)
    given = docs.select("doc_id", F.lit(True).alias("train"), F.col("text").cast("binary").alias("raw"))
    blocks = spark.createDataFrame(given.mapInArrow(classlm.encode, classlm.BLOCK_SCHEMA).toArrow())
    tokens = blocks.agg(F.sum("learned")).first()[0]
    with classlm.small_batches(spark, 1):
        rows, suffix_class, joint, totals = classlm.cluster(blocks, tokens, 8, 1)
        names = {row["block"]: row["words"] for row in blocks.collect()}
        class_of: dict = {}
        for row in rows.collect():
            found, counts = classlm.block_classes(row.asDict(recursive=True), suffix_class)
            for word, c, n in zip(names[row["block"]], found[1:], counts[1:], strict=True):
                assert class_of.setdefault(bytes(word), (c, n)) == (c, n)
    plain = Counter(w for row in docs.collect() for w in (row["text"] or "").encode().lower().split())
    assert len(names) == 3 and {w: n for w, (_, n) in class_of.items()} == plain
    assert totals[:8].sum() == len(plain) and joint.sum() == tokens
    rare = [w for w, n in plain.items() if n < 3]
    moved = sum(class_of[w][0] != suffix_class[classlm.suffix(w)] for w in rare)
    assert moved > len(rare) / 4


def test_more_sweeps_never_lower_the_likelihood(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    score = lambda sweeps: classlm.scored(docs, classes=8, sweeps=sweeps).where("not held_out").agg(F.sum("score")).first()[0]
    once, often = score(1), score(4)
    assert often > once


def test_a_bucket_is_whole_however_often_it_is_merged(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(3)
    classes_of, keys = np.array([0, 1, 2, 1, 2, 1]), np.arange(5, dtype=np.uint64) + 7
    found = []
    for merge in (1, 10**6):
        monkeypatch.setattr(classlm, "MERGE", merge)
        rng = np.random.default_rng(3)
        bucket = classlm.Bucket(3)
        for block in range(6):
            sums = classlm.Neighbours(3)
            sums.add(np.append(rng.integers(1, 6, 40), 0), classes_of, keys, np.ones(5, dtype=bool))
            rows = sums.batch().append_column("number", pa.array(np.arange(1, 6, dtype=np.int32)))
            rows = rows.append_column("old", pa.array(classes_of[1:].astype(np.uint8)))
            bucket.add(block, classlm.packed(rows.slice(block % 3)))
        bucket.merge()
        found.append((bucket.keys.tolist(), bucket.old.tolist(), bucket.flat.tolist(), bucket.counts.tolist()))
    assert found[0] == found[1] and len(found[0][0]) == 5
