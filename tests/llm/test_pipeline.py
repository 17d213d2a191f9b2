from __future__ import annotations

from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F
from test_minhash import brute as near_brute
from test_mixing import WORD, targets
from test_repeats import brute as repeat_brute
from tokenizers import Tokenizer

import corpus_pipeline
from ridetide.llm.common import table, written


def test_every_stage_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    junk = spark.createDataFrame([(90_001, "123 ... 77", "en", "src1", 10), (90_002, None, "en", None, 0), (90_003, "漢字 漢字", "en", "src1", 5)], docs.schema)
    docs = docs.unionByName(junk)
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    rows = lambda df: {r["doc_id"]: r for r in df.collect()}

    given = rows(docs)
    known = written(stages["language_id"](spark, docs, sf), "t")
    assert known.columns == columns
    assert set(rows(known)) == set(given) - {90_001, 90_002, 90_003}

    texts = {d: r["text"] for d, r in rows(known).items()}
    unique = written(stages["minhash_near_dedup"](spark, known, sf), "t")
    assert unique.columns == columns
    kept = {d for d, (_, _, keep) in near_brute(texts, 5).items() if keep}
    assert set(rows(unique)) == kept and len(kept) < len(texts)

    texts = {d: texts[d] for d in kept}
    cut = written(stages["substring_dedup"](spark, unique, sf), "t")
    assert cut.columns == columns
    wanted = repeat_brute(texts, 50)
    left = rows(cut)
    assert set(left) == {d for d, (n, gone, _) in wanted.items() if n == 0 or gone < n}
    for d, r in left.items():
        n, gone, _ = wanted[d]
        assert len(r["text"].encode().split()) == n - gone
        assert r["text"] == texts[d] if not gone else r["n_chars"] == len(r["text"])

    mixture = written(stages["mixing"](spark, cut, sf), "t")
    assert mixture.columns == columns
    times = Counter(r["doc_id"] for r in mixture.collect())
    size = {d: len(WORD.findall(r["text"])) for d, r in left.items()}
    sums, taken = Counter(), Counter()
    for d, r in left.items():
        sums[r["source"]] += size[d]
        taken[r["source"]] += times[d] * size[d]
    for source, target in targets(dict(sums)).items():  # sources of a few documents each
        assert abs(taken[source] - target) <= max(size[d] for d, r in left.items() if r["source"] == source)
    assert max(times.values()) == 2

    packed = stages["packing"](spark, mixture, sf).collect()
    pieces = Counter((r["doc_id"], r["start"]) for r in packed)
    assert all(n == times[d] for (d, _), n in pieces.items())
    once = {}
    for r in packed:
        once.setdefault((r["doc_id"], r["start"]), r)
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = sum(len(plain.encode(left[d]["text"]).ids) * k + k for d, k in times.items())
    assert sum(r["length"] for r in packed) == tokens


def test_run_equals_its_stages_and_stands_empty(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    packed = corpus_pipeline.run(spark, sf)
    assert packed.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 1024
    empty = table(spark, sf, "documents").where(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        empty_out = stage(spark, empty, sf)
        assert empty_out.count() == 0
