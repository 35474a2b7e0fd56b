"""Weather operators: unit conversion (P2), date parts (P3), station range scan (S11),
station-year (A1) and nation-year (A2) aggregates, station lookup (J3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from ..functions.numeric import exact_avg, exact_sum, round_half_even
from .joins import literal_dim

# Sums and means are taken over exact decimals and divided once, so the half-even rounding to
# two digits does not depend on the summation order (ties such as x.xx5 are common when
# averaging values that are themselves rounded).
MEASURES = ["avg_temp", "avg_min_temp", "avg_max_temp", "total_precipitation",
            "avg_precipitation", "total_sunshine_hours", "avg_wind_speed",
            "total_global_radiation"]


def to_units(daily: DataFrame) -> DataFrame:
    """Tenths -> units for TG, TN, TX, RH, FG, DR when present; Q unchanged."""
    present = [c for c in K.TENTHS_VARIABLES if c in daily.columns]
    return daily.withColumns({c: F.col(c) / F.lit(10.0) for c in present})


def with_date_parts(daily: DataFrame, raw_col: str = "YYYYMMDD") -> DataFrame:
    """Parse ``yyyyMMdd`` (unparseable -> NULL rather than a failed job) and add
    year, month, day."""
    d = F.try_to_timestamp(F.col(raw_col).cast("string"), F.lit("yyyyMMdd")).cast("date")
    return (daily.withColumn("date", d)
            .withColumns({"year": F.year("date"), "month": F.month("date"),
                          "day": F.dayofmonth("date")}))


def range_scan(daily: DataFrame, stations, start_year: int, end_year: int,
               variables=None) -> DataFrame:
    """Stations x [start-0101, end-1231] x variable list. Written as plain predicates on
    the raw columns so they reach the parquet scan (PushedFilters) or prune partitions when
    the store is partitioned by STN/year."""
    variables = list(variables or K.WEATHER_VARIABLES)
    lo, hi = f"{start_year}0101", f"{end_year}1231"
    return (daily.filter(F.col("STN").isin([str(s) for s in stations])
                         & (F.col("YYYYMMDD") >= lo) & (F.col("YYYYMMDD") <= hi))
            .select("STN", "YYYYMMDD", *[v for v in variables if v in daily.columns]))


def station_dim(spark) -> DataFrame:
    rows = [(k, v[0], v[1]) for k, v in K.STATIONS.items()]
    schema = T.StructType([T.StructField("station", T.StringType()),
                           T.StructField("station_name", T.StringType()),
                           T.StructField("station_location", T.StringType())])
    return literal_dim(spark, rows, schema)


def with_station_info(df: DataFrame, station_col: str = "station") -> DataFrame:
    """Station -> name, location; unknown stations get 'Unknown' (broadcast of a fixed
    six-row dimension)."""
    dim = station_dim(df.sparkSession).withColumnRenamed("station", "_stn")
    out = df.join(dim, F.col(station_col) == F.col("_stn"), "left").drop("_stn")
    return out.withColumns({
        "station_name": F.coalesce("station_name", F.lit(K.UNKNOWN_STATION)),
        "station_location": F.coalesce("station_location", F.lit(K.UNKNOWN_STATION)),
    })


def station_annual(daily_units: DataFrame) -> DataFrame:
    """A1: one row per (station, year) for all stations in a single pass (partial + final
    hash aggregate; output is stations x years rows) plus the station lookup (J3)."""
    return with_station_info(station_annual_core(daily_units), "station").select(
        "year", *MEASURES, "station", "station_name", "station_location")


def station_annual_core(daily_units: DataFrame) -> DataFrame:
    """The (station, year) aggregate alone (also usable on a stream). Sums of all-null groups
    are 0 (pandas semantics), means of all-null groups stay NULL; every measure is rounded
    half-even to 2."""
    def zsum(c):
        return round_half_even(F.coalesce(exact_sum(c), F.lit(0.0)), 2)

    def mean(c):
        return round_half_even(exact_avg(c), 2)

    agg = daily_units.groupBy(F.col("STN").alias("station"), "year").agg(
        mean("TG").alias("avg_temp"),
        mean("TN").alias("avg_min_temp"),
        mean("TX").alias("avg_max_temp"),
        zsum("RH").alias("total_precipitation"),
        mean("RH").alias("avg_precipitation"),
        zsum("DR").alias("total_sunshine_hours"),
        mean("FG").alias("avg_wind_speed"),
        zsum("Q").alias("total_global_radiation"),
    )
    return agg


def national_annual(station_year: DataFrame, stations=None) -> DataFrame:
    """A2: unweighted mean over the national stations of the already-rounded station-year
    values (exact decimal mean), rounded half-even to 2, plus source/station-list/coverage literals."""
    stations = list(stations or K.NATIONAL_STATIONS)
    sy = station_year.filter(F.col("station").isin(stations))
    out = sy.groupBy("year").agg(
        *[round_half_even(exact_avg(m, 2), 2).alias(m) for m in MEASURES])
    return out.withColumns({
        "data_source": F.lit(K.NATIONAL_DATA_SOURCE),
        "stations_used": F.lit(",".join(stations)),
        "coverage": F.lit(K.NATIONAL_COVERAGE),
    })


def national_from_raw(raw_daily: DataFrame, stations=None) -> DataFrame:
    """raw daily rows -> units -> date parts -> station-year -> nation-year. The station filter
    is applied to the raw rows first so it reaches the scan."""
    stations = list(stations or K.NATIONAL_STATIONS)
    daily = with_date_parts(to_units(raw_daily.filter(F.col("STN").isin(stations))))
    return national_annual(station_annual(daily), stations)
