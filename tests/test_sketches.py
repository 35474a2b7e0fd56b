"""Stored sketches against exact quantiles."""

import pytest
from pyspark.sql import functions as F

from loadcast.operators import ml_prep as M
from loadcast.operators import sketches as SK

PROBS = [0.05, 0.25, 0.5, 0.75, 0.95]


def _rows(spark, n=60_000):
    return spark.range(n).select(
        (F.col("id") % 7 + 2010).cast("int").alias("year"), F.rand(3).alias("u"),
        F.exp(F.randn(5) * 3).alias("skewed"),
        F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.rand(9) * 100).alias("hot"),
        F.when(F.col("id") % 10 == 0, F.rand(1)).alias("sparse"),
        F.lit(None).cast("double").alias("none")).checkpoint()


def test_merged_quantiles_stay_within_the_stated_rank_error(spark, tmpdir_path):
    df, columns = _rows(spark), ["u", "skewed", "hot", "sparse", "none"]
    path = tmpdir_path + "/sketches"
    for low, high in ((2010, 2012), (2013, 2016), (2012, 2013)):       # years arrive, some again
        SK.store_sketches(SK.sketch_columns(df.where(F.col("year").between(low, high)), columns),
                          path)
    stored = SK.load_sketches(spark, path)
    assert stored.count() == 7 * 4                                     # nothing of "none"
    got = {r["column"]: r for r in SK.merged_quantiles(stored, PROBS).collect()}
    assert {c: r["n"] for c, r in got.items()} == \
        {c: df.where(F.col(c).isNotNull()).count() for c in columns[:4]}
    values = {(c, p): got[c][f"q_{p}"] for c in got for p in PROBS}
    error = SK.rank_error()
    assert 0.001 < error < 0.002
    for (c, p), (below, upto) in SK.ranks(df, values).items():
        assert below - error <= p <= upto + error, (c, p)
    # some of the years, without their rows
    some = SK.merged_quantiles(stored.where("year < 2012"), [0.5]).where("column = 'u'").first()
    assert some["n"] == df.where("year < 2012").count()


def test_medians_and_scaler_agree_with_the_exact_ones(spark):
    df = _rows(spark)
    sketches = SK.sketch_columns(df, ["u", "hot"])
    exact = M.fit_robust_scaler(df, ["u", "hot"])
    got = SK.robust_scaler(sketches)
    assert got["u"] == pytest.approx(exact["u"], abs=0.01)
    assert SK.medians(sketches)["hot"] == pytest.approx(exact["hot"][0], abs=1.0)
    constant = df.withColumn("u", F.lit(4.0))
    assert SK.robust_scaler(SK.sketch_columns(constant, ["u"]))["u"] == (4.0, 1.0)


def test_no_rows_no_sketches(spark):
    empty = _rows(spark, 10).limit(0)
    assert SK.merged_quantiles(SK.sketch_columns(empty, ["u"]), [0.5]).count() == 0
