"""Station weather sources.

Daily station files are comma-separated text with a block of ``#`` comment lines in front and
indented, space-padded data rows; blank fields mean "not measured". The data rows carry no
header: the column names are ``STN, YYYYMMDD`` followed by the requested variables.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from ..operators import weather as W


def station_text_schema(variables=None) -> T.StructType:
    variables = list(variables or K.WEATHER_VARIABLES)
    return T.StructType([T.StructField("STN", T.StringType()),
                         T.StructField("YYYYMMDD", T.StringType())]
                        + [T.StructField(v, T.DoubleType()) for v in variables])


def read_station_text(spark: SparkSession, path: str, variables=None) -> DataFrame:
    """Comment lines skipped, leading/trailing blanks trimmed, blank fields -> NULL,
    malformed numbers and NaN -> NULL (PERMISSIVE), then units (P2) and date parts (P3). Files are
    split and parsed in parallel by the CSV source."""
    raw = (spark.read.schema(station_text_schema(variables))
           .option("comment", "#").option("ignoreLeadingWhiteSpace", True)
           .option("ignoreTrailingWhiteSpace", True).option("mode", "PERMISSIVE")
           .csv(path))
    measured = raw.withColumns({f.name: F.when(~F.isnan(f.name), F.col(f.name))
                                for f in raw.schema.fields if f.dataType == T.DoubleType()})
    return W.with_date_parts(W.to_units(measured.where(F.col("STN").isNotNull())))


# ----------------------------------------------------------------------------- S12
def _cached(spark: SparkSession, path: str) -> DataFrame | None:
    """The cached days, or None before the first write. Files of different writes may hold
    different variables; station numbers stay text."""
    try:
        found = spark.read.option("mergeSchema", True).parquet(f"{path}/daily").schema
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name == "STN"
                                         else f.dataType) for f in found])
    return spark.read.schema(schema).parquet(f"{path}/daily")


def _days_of(daily: DataFrame) -> DataFrame:
    """(STN, first, last): runs of consecutive days that a station has rows for."""
    order = Window.partitionBy("STN").orderBy("day")
    return (daily.select("STN", F.try_to_date("YYYYMMDD", "yyyyMMdd").alias("day"))
            .where("STN is not null and day is not null").distinct()
            .withColumn("run", F.date_sub("day", F.row_number().over(order)))
            .groupBy("STN", "run").agg(F.min("day").alias("first"), F.max("day").alias("last"))
            .drop("run"))


def write_cache(daily: DataFrame, path: str, variables=None, start=None, end=None) -> None:
    """Add cleaned daily weather to a cache, partitioned by station and year. Only the
    station-years of ``daily`` are rewritten: other stations and years, the days that ``daily``
    lacks and the variables that it was not asked for stay as they are. What the cache holds is
    recorded by station and variable: the asked interval ``start`` to ``end`` (ISO dates, both or
    none), in which a day without a row is known not to be measured, or else the days that have
    rows. The record is written last; days of a write that failed before it count as missing."""
    spark = daily.sparkSession
    variables = list(variables or [v for v in K.WEATHER_VARIABLES if v in daily.columns])
    daily = daily.drop(*[v for v in K.WEATHER_VARIABLES if v not in variables]).checkpoint()
    old, day = _cached(spark, path), ["STN", "year", "YYYYMMDD"]
    rows = daily
    if old is not None:
        touched = daily.select("STN", "year").distinct()
        old = old.join(touched, ["STN", "year"], "left_semi")
        other = [v for v in K.WEATHER_VARIABLES if v in old.columns and v not in variables]
        if other:
            rows = rows.join(old.groupBy(*day).agg(*[F.first(v, True).alias(v) for v in other]),
                             day, "left")
        rows = rows.unionByName(old.join(daily.select(*day).distinct(), day, "left_anti"),
                                allowMissingColumns=True).checkpoint()
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("STN", "year").parquet(f"{path}/daily"))
    if start is not None:
        held = daily.where("STN is not null").select(
            "STN", F.lit(start).cast("date").alias("first"),
            F.lit(end).cast("date").alias("last")).distinct()
    else:
        held = _days_of(daily)
    held.withColumn("variable", F.explode(F.array(*[F.lit(v) for v in variables]))) \
        .write.mode("append").parquet(f"{path}/coverage")


def missing_days(spark: SparkSession, path: str, stations, start: str, end: str,
                 variables=None) -> DataFrame:
    """(STN, variable, first, last): the longest intervals of days within ``start`` to ``end``
    that the cache does not hold. An interval begins after the furthest day covered so far and
    ends before the next covered one; a closing mark stands after ``end``."""
    stations = [str(s) for s in stations]
    variables = list(variables or K.WEATHER_VARIABLES)
    low, high = F.lit(start).cast("date"), F.lit(end).cast("date")
    asked = spark.createDataFrame([(s, v) for s in stations for v in variables],
                                  "STN string, variable string")
    marks = asked.select("STN", "variable", F.date_add(high, 1).alias("first"),
                         F.lit(None).cast("date").alias("last"))
    if _cached(spark, path) is not None:
        held = spark.read.parquet(f"{path}/coverage").where(
            F.col("STN").isin(stations) & F.col("variable").isin(variables)
            & (F.col("last") >= low) & (F.col("first") <= high))
        marks = marks.unionByName(held.select("STN", "variable", "first", "last"))
    earlier = (Window.partitionBy("STN", "variable").orderBy("first", F.asc_nulls_last("last"))
               .rowsBetween(Window.unboundedPreceding, -1))
    reached = F.coalesce(F.max("last").over(earlier), F.date_sub(low, 1))
    return (marks.withColumn("gap", F.date_add(F.greatest(reached, F.date_sub(low, 1)), 1))
            .where("gap < first")
            .select("STN", "variable", F.col("gap").alias("first"),
                    F.date_sub("first", 1).alias("last")))


def read_cache(spark: SparkSession, path: str, stations=None, start_year=None,
               end_year=None) -> DataFrame:
    df = _cached(spark, path)
    if df is None:
        raise FileNotFoundError(f"no weather is cached in {path}")
    if stations is not None:
        df = df.filter(F.col("STN").isin([str(s) for s in stations]))
    if start_year is not None:
        df = df.filter(F.col("year") >= start_year)
    if end_year is not None:
        df = df.filter(F.col("year") <= end_year)
    return df
