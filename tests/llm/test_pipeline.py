"""The corpus pipeline on a small corpus, each stage against a plain version of it."""

import re

import corpus_pipeline
import pyarrow as pa
import pytest
from helpers import LONG
from pyspark.sql import functions as F

from codexmill.llm import decontamination, queries

BENCH = "q one q two q three q four q five q six q seven q eight q nine q ten q eleven"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("sf"))
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(1, base, "en"), (2, base.upper(), "en"), (3, "clean words that nobody else has here", "en"), (4, BENCH, "en"), (5, "123 456", "en"), (6, None, "en"), (7, "", "en"), (8, "write to a.b@c.de or 10.1.2.3", None), (9, LONG, "en")]
    spark.createDataFrame([(i, t, x, "src0", len(t or "")) for i, t, x in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(0, BENCH)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        seen[name] = {r.doc_id: r for r in docs.collect()}
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert set(seen["language"]) == {1, 2, 3, 4, 8, 9} and seen["language"][8].lang == "en"
    assert set(seen["near_duplicates"]) == {1, 3, 4, 8, 9}
    assert set(seen["decontamination"]) == {1, 3, 8, 9}
    assert seen["pii"][8].text == "write to [email] or [ip]" and seen["pii"][8].n_chars == 24 and seen["pii"][3].text == seen["language"][3].text
    assert set(seen["packing"]) == {1, 3, 8, 9}


def test_run(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in rows} == {1, 3, 8, 9} and all(len(r.ids) == r.length for r in rows)


def test_the_decoder_decides_what_goes(spark):
    """Two languages learned from the same texts: every text is ambiguous, and stays only where its row bears out the nearest codeword."""
    rows = [(i, "some words and others", lang, "src0", 1) for i, lang in enumerate(["aa", "zz", "aa", "zz", None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.identify_language(spark, docs, "").collect()} == {0, 2}
    nothing = docs.withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.identify_language(spark, nothing, "").count() == 5


def test_the_benchmark_rule():
    assert len(decontamination.windows_of(decontamination.words(BENCH.encode()))) == 10


def test_every_operator_has_its_query():
    assert sorted({int(re.match(r"op(\d+)_", x)[1]) for x in queries.QUERIES}) == list(range(1, 14))


def write(spark, out, rows, bench):
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    extra = {x: F.lit("x") for x in ("score", "n_hit", "h1", "root", "class", "base", "part", "ids", "key", "__h1x")}
    table.withColumns(extra).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def test_empty_tables_pass(spark, tmp_path):
    out = write(spark, str(tmp_path), [], [])
    docs = spark.read.parquet(f"{out}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, out)
        assert found.count() == 0 and (name == "packing" or found.columns == docs.columns)
    assert corpus_pipeline.run(spark, out).count() == 0


def test_repeated_rows_nulls_and_clashing_columns(spark, tmp_path):
    a, b = "alpha beta gamma delta epsilon zeta eta theta iota kappa", "words of a clean text that stands alone"
    rows = [(1, a), (1, a), (1, b), (None, a), (None, BENCH), (None, "one more text without an id"), (2, BENCH), (2, "a text beside a bad one"), (3, None), (4, "")]
    out = write(spark, str(tmp_path), [(i, t, None, None, None) for i, t in rows], [(None, None), (0, BENCH), (0, BENCH), (1, "")])
    docs, seen = spark.read.parquet(f"{out}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, out)
        assert docs.columns == spark.read.parquet(f"{out}/documents.parquet").columns
        seen[name] = sorted(((r.doc_id, r.text) for r in docs.collect()), key=repr)
    with_words = [x for x in rows if x[1]]
    assert seen["language"] == sorted(with_words, key=repr)  # nothing to learn a language from
    assert seen["near_duplicates"] == sorted([(1, a), (1, b), (2, BENCH), (2, "a text beside a bad one"), (None, "one more text without an id")], key=repr)
    assert seen["decontamination"] == seen["pii"] == sorted([(1, a), (1, b), (2, "a text beside a bad one"), (None, "one more text without an id")], key=repr)
    assert corpus_pipeline.run(spark, out).where("start = 0").count() == 4


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_batches_of_bounded_size(spark, folder, name, stage):
    """A stage's table runs after it has returned, and what it hands its workers then is some MB, not all rows of a task; nor is a smaller setting raised."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]})

    rows = spark.range(0, 2000, 1, 1).select(F.repeat(F.lit("word "), 2000).alias("text"))  # 20 MB in one task
    try:
        for wanted, most in ((before, 5 << 20), (str(1 << 20), 2 << 20)):
            spark.conf.set(setting, wanted)
            stage(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
            assert max(r.n for r in rows.mapInArrow(sizes, "n long").collect()) < most
    finally:
        spark.conf.set(setting, before)
