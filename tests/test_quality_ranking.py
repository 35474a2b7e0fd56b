"""IQR filter, exact quantiles, ranks, rounding, correlation and aggregate null cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadcast.functions.numeric import round_half_even
from loadcast.operators import annual, quality, ranking


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(7)
    vals = {g: rng.normal(size=n).round(3).tolist() for g, n in (("a", 37), ("b", 1), ("c", 200))}
    rows = [(g, float(v)) for g, vs in vals.items() for v in vs] + [("a", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r for r in ranking.group_quantiles(df, ["g"], "v", [0.25, 0.5, 0.75]).collect()}
    for g, vs in vals.items():
        for p in (0.25, 0.5, 0.75):
            assert got[g][f"q_{p}"] == pytest.approx(np.quantile(vs, p), abs=1e-12)
        assert got[g]["n"] == len(vs)


def test_quantiles_of_null_groups_all_null_groups_and_no_groups(spark):
    rows = [(None, 1.0), (None, 3.0), ("empty", None), ("a", 2.0), ("a", 2.0), ("a", 9.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: (r["rows"], r["n"], r["q_0.5"]) for r in
           ranking.group_quantiles(df, ["g"], "v", [0.5]).collect()}
    assert got == {None: (2, 2, 2.0), "empty": (1, 0, None), "a": (3, 3, 2.0)}
    whole = ranking.group_quantiles(df, [], "v", [0.5]).collect()
    assert [(r["rows"], r["n"], r["q_0.5"]) for r in whole] == [(6, 5, 2.0)]


def test_histogram_lists_empty_bins(spark):
    from loadcast.operators.reports import histogram
    df = spark.createDataFrame([(0.0,), (10.0,), (None,)], "v double")
    got = sorted((r["bin"], r["n"]) for r in histogram(df, "v", 8).collect())
    assert got == [(0, 1), *[(i, 0) for i in range(1, 7)], (7, 1)]
    assert histogram(df.where("v < 0"), "v", 8).count() == 0


def test_building_quantiles_runs_few_jobs(spark):
    """Counting by value first leaves a handful of jobs, whatever the number of columns."""
    from loadcast.operators.quality import iqr_filter
    df = spark.range(5000).select((F.col("id") % 7).cast("string").alias("g"),
                                  (F.col("id") % 100).cast("double").alias("v"))
    before = spark.sparkContext._jsc.sc().statusTracker().getJobIdsForGroup(None)
    iqr_filter(df, "g", "v")
    after = spark.sparkContext._jsc.sc().statusTracker().getJobIdsForGroup(None)
    assert len(after) - len(before) <= 10


def test_global_row_number_is_dense(spark):
    df = spark.range(0, 5000).withColumn("k", (F.col("id") * 7919) % 5000)
    rn = ranking.global_row_number(df.select("k"), ["k"]).collect()
    pairs = sorted((r["k"], r["_rn"]) for r in rn)
    assert [p[1] for p in pairs] == list(range(1, 5001))


def test_iqr_filter_cases(spark):
    rows = [("small", float(v)) for v in list(range(19)) + [1000]]          # 20 rows: untouched
    rows += [("big", float(v)) for v in list(range(20)) + [1000]]           # 21 rows: filtered
    rows += [("const", 5.0)] * 30                                           # constant: kept
    rows += [(None, 1.0)] * 3                                               # null key: dropped
    df = spark.createDataFrame(rows, "g string, v double")
    out = quality.iqr_filter(df, "g", "v").groupBy("g").agg(F.count("*").alias("n"),
                                                            F.max("v").alias("mx"))
    got = {r["g"]: (r["n"], r["mx"]) for r in out.collect()}
    assert got["small"] == (20, 1000.0)
    assert got["big"] == (20, 19.0)
    assert got["const"] == (30, 5.0)
    assert None not in got
    # caching the input changes nothing but how often it is read
    cached = quality.iqr_filter(df, "g", "v", persist=True)
    assert sorted(map(tuple, cached.collect()), key=repr) == \
        sorted(map(tuple, quality.iqr_filter(df, "g", "v").collect()), key=repr)


def test_iqr_value_on_bound_is_kept(spark):
    # Q1 = 5.5, Q3 = 15.5 over 1..20 and the outlier; bound = 15.5 + 2*10 = 35.5 -> 35.5 kept
    vals = [float(v) for v in range(1, 21)] + [35.5]
    df = spark.createDataFrame([("g", v) for v in vals], "g string, v double")
    b = quality.iqr_bounds(df, "g", "v").first()
    kept = quality.iqr_filter(df, "g", "v").count()
    assert b["upper_bound"] == pytest.approx(np.quantile(vals, .75) + 2 * (np.quantile(vals, .75) - np.quantile(vals, .25)))
    assert kept == (21 if 35.5 <= b["upper_bound"] else 20)


def test_round_half_even_like_numpy(spark):
    vals = [0.125, 2.675, 4.015, 16.315, -4.015, 1.005]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = [r[0] for r in df.select(round_half_even(F.col("v"), 2)).collect()]
    assert got == [float(np.round(v, 2)) for v in vals]


def test_correlation_null_cases(spark):
    const = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    one = spark.createDataFrame([(1.0, 2.0)], "x double, y double")
    pair_null = spark.createDataFrame([(1.0, 2.0), (2.0, None), (3.0, 6.0), (4.0, 8.1)],
                                      "x double, y double")
    assert const.agg(annual.safe_corr("x", "y")).first()[0] is None
    assert one.agg(annual.safe_corr("x", "y")).first()[0] is None
    assert pair_null.agg(annual.safe_corr("x", "y")).first()[0] is not None


def test_all_null_sum_is_zero_mean_null(spark):
    df = spark.createDataFrame([(2000, None, "a", None, None, None, None)],
                               "year int, num_connections double, company string, "
                               "annual_consume double, delivery_perc double, "
                               "perc_of_active_connections double, smartmeter_perc double")
    r = annual.energy_year_summary(df).first()
    assert r["total_connections"] == 0.0 and r["total_annual_consume"] == 0.0
    assert r["avg_annual_consume"] is None


def test_hot_group_of_identical_values_is_split(spark):
    """One group holding a third of the rows, all with the same value: the rank sort still
    spreads it over several partitions, and the quantiles stay exact."""
    n = 30000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 50).cast("string"))
        .alias("g"),
        F.when(F.col("id") % 3 == 0, F.lit(1.0)).otherwise((F.col("id") % 997).cast("double"))
        .alias("v"))
    # (AQE would merge these small partitions back into one; at scale it would not)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spread = (df.withColumn("_tb", F.monotonically_increasing_id())
                  .orderBy("g", "v", "_tb").groupBy(F.spark_partition_id().alias("p")).count()
                  .collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert max(r["count"] for r in spread) < n / 3          # the hot run is split
    q = {r["g"]: r for r in ranking.group_quantiles(df, ["g"], "v", [0.25, 0.75]).collect()}
    assert q["hot"]["rows"] == n // 3 and q["hot"]["q_0.25"] == 1.0 and q["hot"]["q_0.75"] == 1.0
