"""Report aggregates: target min/max/mean (A8), mean by group (A9), equal-width histogram
(A10) and per-feature means (A11)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K


def target_stats(df: DataFrame, target: str = K.TARGET_COLUMN) -> DataFrame:
    return df.agg(F.min(target).alias("min"), F.max(target).alias("max"),
                  F.avg(target).alias("mean"), F.count(target).alias("n"))


def mean_by_group(df: DataFrame, group: str, target: str = K.TARGET_COLUMN) -> DataFrame:
    """Null group keys are dropped (pandas ``groupby``)."""
    return (df.where(F.col(group).isNotNull()).groupBy(group)
            .agg(F.avg(target).alias(f"mean_{target}"), F.count(F.lit(1)).alias("n")))


def histogram(df: DataFrame, value: str, bins: int = 8) -> DataFrame:
    """Equal-width bins between min and max (the last bin is closed): one row for each of the
    ``bins`` bins, empty ones included; no row without values. The two range scalars come from one
    global aggregate (partial per task, two numbers to the driver); the counts are a second hash
    aggregate with ``bins`` groups, joined to the fixed list of bins."""
    v = df.where(F.col(value).isNotNull())
    spark = df.sparkSession
    lo, hi = v.agg(F.min(value), F.max(value)).first()
    if lo is None:
        return spark.createDataFrame([], "bin int, bin_lo double, bin_hi double, n bigint")
    width = (hi - lo) / bins if hi > lo else 1.0
    b = F.least(F.floor((F.col(value) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counted = v.groupBy(b.alias("_bin")).agg(F.count(F.lit(1)).alias("_n"))
    every = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counted, F.col("bin") == F.col("_bin"), "left").select(
        "bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("bin_lo"),
        (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("bin_hi"),
        F.coalesce("_n", F.lit(0)).alias("n"))


def feature_means(df: DataFrame, columns) -> DataFrame:
    return df.agg(*[F.avg(c).alias(f"mean_{c}") for c in columns])
