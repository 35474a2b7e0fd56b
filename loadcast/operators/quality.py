"""Cleaning filters: critical nulls (F1), activity floor (F2), household range (F3),
per-group IQR outlier removal (F4) and the stage row-count funnel (F8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import features as FT
from .joins import join_by_year
from .ranking import group_quantiles


def drop_incomplete(df: DataFrame, columns=None) -> DataFrame:
    """drop rows with a null in any critical column (NaN is turned into NULL at ingest)."""
    cols = [c for c in (columns or K.CRITICAL_COLUMNS) if c in df.columns]
    return df.dropna(subset=cols)


def with_preliminary_household(df: DataFrame) -> DataFrame:
    hh = FT.estimated_households()
    return df.withColumns({
        "preliminary_estimated_households": hh,
        "preliminary_household_consumption": F.col("annual_consume") / hh,
    })


def active_filter(df: DataFrame, min_pct: float = K.MIN_ACTIVE_PCT) -> DataFrame:
    """keep areas with at least ``min_pct`` % active connections (pushed below joins)."""
    return df.filter(F.col("perc_of_active_connections") >= F.lit(float(min_pct)))


def household_range_filter(df: DataFrame, value: str = "preliminary_household_consumption",
                           lo: float = K.HOUSEHOLD_KWH_MIN,
                           hi: float = K.HOUSEHOLD_KWH_MAX) -> DataFrame:
    """inclusive range on the household consumption."""
    return df.filter(F.col(value).between(F.lit(float(lo)), F.lit(float(hi))))


def iqr_bounds(df: DataFrame, group: str, value: str,
               factor: float = K.IQR_FACTOR) -> DataFrame:
    """Per group: row count (all rows, as pandas ``len(group)``), Q1, Q3 and the bounds
    ``Q1 - f*IQR``, ``Q3 + f*IQR``. One row per group."""
    b = group_quantiles(df, [group], value, [0.25, 0.75]) \
        .withColumnsRenamed({"q_0.25": "q1", "q_0.75": "q3", "rows": "group_rows"}).drop("n")
    iqr = F.col("q3") - F.col("q1")
    return b.withColumns({"lower_bound": F.col("q1") - F.lit(float(factor)) * iqr,
                          "upper_bound": F.col("q3") + F.lit(float(factor)) * iqr})


def iqr_filter(df: DataFrame, group: str, value: str, factor: float = K.IQR_FACTOR,
               min_group: int = K.IQR_MIN_GROUP, persist: bool = False) -> DataFrame:
    """inside each group with more than ``min_group`` rows keep
    ``lower <= value <= upper`` (inclusive); smaller groups are kept whole; rows whose group
    key is NULL are dropped (pandas ``groupby`` semantics).

    The bounds table has one row per group; Spark broadcasts it where it is small enough. The
    input is read twice: the value counts read only the (group, value) columns, the filter reads
    the rest. Re-reading
    a deterministic scan is cheaper at scale than caching every column of the fact table;
    ``persist=True`` caches it instead (for an expensive, non-deterministic input)."""
    if persist:
        from pyspark import StorageLevel
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
    bounds = iqr_bounds(df, group, value, factor).select(
        F.col(group).alias("_g"), "group_rows", "lower_bound", "upper_bound")
    j = df.where(F.col(group).isNotNull()).join(bounds, F.col(group) == F.col("_g"))
    keep = (F.col("group_rows") <= F.lit(min_group)) | \
        F.col(value).between(F.col("lower_bound"), F.col("upper_bound"))
    return j.filter(keep).drop("_g", "group_rows", "lower_bound", "upper_bound")


def funnel_counts(columns=None) -> list[Column]:
    """Conditional counts over area rows that are left-joined to the weather (``_merged`` is null
    where there is none): after load, merge, critical-null removal, activity floor and household
    range. For an aggregate, or to observe a table on its way to another one."""
    complete = F.col("_merged").isNotNull()
    for c in columns or K.CRITICAL_COLUMNS:
        complete = complete & F.col(c).isNotNull()
    hh = F.col("annual_consume") / FT.estimated_households()
    active = complete & (F.col("perc_of_active_connections") >= F.lit(K.MIN_ACTIVE_PCT))
    in_range = active & hh.between(F.lit(K.HOUSEHOLD_KWH_MIN), F.lit(K.HOUSEHOLD_KWH_MAX))
    return [F.count(F.lit(1)).alias("after_load"),
            F.count_if(F.col("_merged").isNotNull()).alias("after_merge"),
            F.count_if(complete).alias("after_dropna"),
            F.count_if(active).alias("after_active_filter"),
            F.count_if(in_range).alias("after_range_filter")]


def funnel(loaded: DataFrame, weather: DataFrame, columns=None) -> DataFrame:
    """F8: the counts of ``funnel_counts`` in one pass. Returns one row."""
    return join_by_year(loaded, weather.withColumn("_merged", F.lit(True)), "left").agg(
        *funnel_counts(columns))
