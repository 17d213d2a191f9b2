"""Edges of the pipeline stages: names of columns, repeated rows, ids that are null, bytes that are no UTF-8."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ridetide.llm.language import identified
from ridetide.llm.minhash import without_near_duplicates
from ridetide.llm.mixing import mixed
from ridetide.llm.packing import pack
from ridetide.llm.repeats import without_repeats

NAMES = (
    "__row __text_key __copy __times __key __place __kept __cut_key __cut_id __own_id __doc_id __nth given key id row order"
    " copy word kept times size label"
).split()
PROSE = "the quick brown fox jumps over the lazy dog and runs far away into the dark green wood near the old river"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(n, f"{PROSE} number {n} " * 12, "en", f"src{n % 3}", 0) for n in range(12)]
    rows += [(50, PROSE + " once", "en", "src0", 0), (51, PROSE + " once", "en", "src1", 0), (52, None, "en", None, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES[:-1], ids=[name for name, _ in corpus_pipeline.STAGES[:-1]])
def test_columns_may_have_any_names(spark, docs, name, stage):
    plain = sorted((tuple(r) for r in stage(spark, docs, "").select("doc_id", "text").collect()), key=repr)
    clashing = docs.select("*", *[F.lit(n).alias(n) for n in NAMES])
    out = stage(spark, clashing, "")
    assert out.columns == clashing.columns
    rows = out.collect()
    assert sorted(((r["doc_id"], r["text"]) for r in rows), key=repr) == plain
    assert all(r[n] == n for r in rows for n in NAMES)


def test_one_row_of_each_group_stays(spark):
    """Six equal texts: three rows of id 1, two without an id, one of id 2; and texts that only rows without id have."""
    rows = [(1, PROSE)] * 3 + [(None, PROSE)] * 2 + [(2, PROSE), (3, "another text"), (3, "another text"), (3, "a third one")]
    rows += [(None, "nobody")] * 3 + [(None, None), (None, ""), (7, "alone")]
    kept = without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = Counter((r["doc_id"], r["text"] or "") for r in kept)
    assert texts == {(1, PROSE): 1, (3, "another text"): 1, (3, "a third one"): 1, (None, "nobody"): 1, (None, ""): 1, (7, "alone"): 1}


def test_which_of_two_alike_rows_is_doubled_is_fixed(spark):
    """Rows alike in id, text and source, told apart by another column."""
    rows = [(n // 2, f"{PROSE} {n // 2}", "src0", n) for n in range(20)]
    names = "doc_id long, text string, source string, other int"
    one, two = (
        Counter(r["other"] for r in mixed(spark.createDataFrame(part, names)).collect()) for part in (rows, rows[::-1])
    )
    assert one == two and set(one.values()) <= {1, 2}


def test_bytes_that_are_no_utf8(spark):
    bad = "cast(concat(cast('%s ' AS binary), X'FFFE', cast(' more words of it' AS binary)) AS string)" % PROSE
    docs = spark.sql(
        f"SELECT id AS doc_id, if(id < 3, {bad}, '{PROSE} ' || id) AS text, 'en' AS lang, 'src0' AS source, 0L AS n_chars FROM range(6)"
    )
    assert identified(docs).count() == 6
    assert pack(docs).agg(F.sum("length")).first()[0] > 6
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").count() > 0
    assert without_repeats(docs, window=12).count() >= 1
