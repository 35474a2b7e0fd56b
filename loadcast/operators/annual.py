"""Yearly energy summary (A3, A5), integration with national weather (J1) and the
weather/consumption correlation report (A4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import round_half_even
from .joins import join_by_year

SUMMARY_MEASURES = ["total_connections", "avg_annual_consume", "total_annual_consume",
                    "avg_delivery_perc", "avg_active_connections_perc", "avg_smartmeter_perc"]
CORR_WEATHER = ["avg_temp", "total_precipitation", "total_sunshine_hours", "avg_wind_speed"]
CORR_ENERGY = ["avg_annual_consume", "total_annual_consume"]


def energy_year_summary(area: DataFrame, energy_type: str | None = None) -> DataFrame:
    """A3: per year: connection/consumption sums (all-null -> 0), five means, distinct
    companies and row count. Partial aggregation happens map-side, so the shuffle carries
    one buffer per (task, year); count-distinct adds a (year, company) pre-aggregation."""
    if energy_type is not None:
        area = area.filter(F.col("energy_type") == energy_type)
    return area.groupBy("year").agg(
        F.coalesce(F.sum("num_connections"), F.lit(0.0)).alias("total_connections"),
        F.avg("annual_consume").alias("avg_annual_consume"),
        F.coalesce(F.sum("annual_consume"), F.lit(0.0)).alias("total_annual_consume"),
        F.avg("delivery_perc").alias("avg_delivery_perc"),
        F.avg("perc_of_active_connections").alias("avg_active_connections_perc"),
        F.avg("smartmeter_perc").alias("avg_smartmeter_perc"),
        F.countDistinct("company").alias("num_companies"),
        F.count(F.lit(1)).alias("num_records"),
    )


def integrated_annual(area: DataFrame, national: DataFrame, energy_type: str = "electricity",
                      start_year: int | None = None, end_year: int | None = None) -> DataFrame:
    """Yearly summary inner-joined with the national weather on ``year``.

    Both sides are aggregates with one row per year, so the join is between two tiny tables;
    the year range predicate is applied before the aggregation and reaches the scan."""
    if start_year is not None:
        area = area.filter(F.col("year") >= start_year)
        national = national.filter(F.col("year") >= start_year)
    if end_year is not None:
        area = area.filter(F.col("year") <= end_year)
        national = national.filter(F.col("year") <= end_year)
    summary = energy_year_summary(area, energy_type)
    return join_by_year(summary, national).withColumn(
        "energy_type", F.lit(energy_type))


def safe_corr(x: str, y: str):
    """Pearson correlation that is NULL (not an error, not NaN) for zero variance or a
    single row: covar_pop / (stddev_pop * stddev_pop) with ``try_divide``."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def correlation_columns(weather=None, energy=None):
    weather = weather or CORR_WEATHER
    energy = energy or CORR_ENERGY
    return [(f"{w}_vs_{e}", w, e) for w in weather for e in energy]


def weather_energy_correlation(integrated: DataFrame, digits: int = 3) -> DataFrame:
    """A4: one row with the 8 correlations (rounded half-even), a ``correlations`` map keyed
    ``a_vs_b``, the sorted list of years and the sample size. Years are joined rows of the
    integrated table (one per year), so the collected list is bounded by the year range."""
    cols = correlation_columns()
    agg = integrated.agg(
        *[round_half_even(safe_corr(w, e), digits).alias(name) for name, w, e in cols],
        F.array_sort(F.collect_list(F.col("year"))).alias("data_years"),
        F.count(F.lit(1)).alias("sample_size"),
        F.first("energy_type", ignorenulls=True).alias("energy_type"),
    )
    m = F.create_map(*[x for name, _, _ in cols for x in (F.lit(name), F.col(name))])
    return agg.withColumn("correlations", m)
