"""The corpus pipeline: columns, decisions taken, awkward rows."""

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from loadcast.llm import common  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def test_stages(spark, tmpdir_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmpdir_path}/{name}"
        stage(spark, docs, SMALL).write.parquet(path)
        out = spark.read.parquet(path)
        if name != "packing":
            assert out.columns == columns and 0 < out.count() <= before
            assert out.where(F.col("n_chars") != F.char_length("text")).count() == 0 \
                or name in ("toxicity", "near_dedup")
            before = out.count()
        docs = out
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_run_equals_the_stages(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert out.where("length < 1").count() == 0 and out.select("doc_id").distinct().count() > 100


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_awkward_rows(spark, tmpdir_path, name, stage):
    schema = ("doc_id long, text string, lang string, source string, n_chars long, key string, "
              "fp string, score string, _text string")
    rows = [(None, None, None, None, None, None, None, None, None), (1, "", "en", "s", 0, *"abcd"),
            (2, "long " * 50_000, "en", "s", 250_000, *"abcd"),
            (3, "one fine line of text here", None, None, None, *"abcd"),
            (3, "one fine line of text here", None, None, None, *"abcd"),
            (4, "mail me at x@y.org\nplease", "en", "s", 25, *"abcd")]
    docs = spark.createDataFrame(rows, schema)
    out = stage(spark, docs, SMALL)
    if name != "packing":
        assert out.columns == docs.columns
    assert 0 < out.count()
    assert stage(spark, docs.limit(0), SMALL).count() == 0


def test_line_dedup_leaves_no_stubs(spark):
    """Nothing but white space is left of the second copy; the third has a line of its own."""
    text = "one fine line of text here\n\nand another one after it\n \t"
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(
        [text, text + "\r", text + "\nwords of its own", "", "\n"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, "
                                 "n_chars long")
    out = corpus_pipeline.line_dedup(spark, docs, SMALL).collect()
    assert {r["doc_id"]: r["text"].strip() for r in out} == {
        0: text.strip(), 2: "words of its own", 3: "", 4: ""}


def test_files_follow_rows_not_shuffle_partitions(spark):
    """A small table is stored in a file a core, and the stages behind a shuffle have as many
    partitions as they read, whatever the session's number of shuffle partitions."""
    conf = {"spark.sql.shuffle.partitions": "40",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    cores = spark.sparkContext.defaultParallelism
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = [(i, f"line {w} of some text here\n{w} {i}", "en", "s", 0)
                for i, w in enumerate("abcdefgh" * 5)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, "
                                     "source string, n_chars long")
        kept = common.stored(docs.groupBy("doc_id").count(), len(rows))
        assert kept.rdd.getNumPartitions() <= cores and kept.count() == len(rows)
        for stage in (corpus_pipeline.line_dedup, corpus_pipeline.near_dedup):
            out = stage(spark, docs, SMALL)
            assert out.rdd.getNumPartitions() <= max(docs.rdd.getNumPartitions(), cores)
            assert out.count() > 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
