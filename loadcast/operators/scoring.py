"""Request scoring operators: validation + quarantine (F6), scenario expansion (P26),
defaults (P27-P28), rule-baseline score (P33), derived outputs (P24), comparison with a
typical household (P25), advice tags (P32), sanity flag (F7), scenario fan-out (B2),
nested responses (S16) and latest-N (T4).

Every lookup is a fixed-value dimension (a handful of rows, broadcast by construction); no
operator here shuffles the request table except the latest-N top-k.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from ..functions import requests as R
from .joins import literal_dim


# ----------------------------------------------------------------------------- F6
def validate(requests: DataFrame) -> DataFrame:
    """Apply field defaults and add ``errors`` (array) and ``is_valid``."""
    df = R.with_field_defaults(requests).withColumn("errors", R.validation_errors())
    return df.withColumn("is_valid", F.size("errors") == 0)


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with their reasons)."""
    return (validated.filter("is_valid").drop("errors", "is_valid"),
            validated.filter(~F.col("is_valid")).drop("is_valid"))


# ----------------------------------------------------------------------------- P26
def scenario_dim(spark) -> DataFrame:
    rows = []
    for name, (t, p, s, w) in K.WEATHER_SCENARIOS.items():
        rows.append((name, t, p, s, w, t - K.SCENARIO_TEMP_SPREAD, t + K.SCENARIO_TEMP_SPREAD,
                     p / 365, K.SCENARIO_RADIATION))
    schema = T.StructType([T.StructField("_scenario", T.StringType())] + [
        T.StructField(c, T.DoubleType()) for c in (
            "avg_temp", "total_precipitation", "total_sunshine_hours", "avg_wind_speed",
            "avg_min_temp", "avg_max_temp", "avg_precipitation", "total_global_radiation")])
    return literal_dim(spark, rows, schema)


def with_scenario_weather(df: DataFrame, scenario: str = "scenario") -> DataFrame:
    """Left lookup of the scenario's weather; unknown scenarios use 'normal'."""
    key = F.when(F.lower(F.col(scenario)).isin(list(K.WEATHER_SCENARIOS)),
                 F.lower(F.col(scenario))).otherwise(F.lit(K.SCENARIO_DEFAULT))
    return df.withColumn("_scn_key", key).join(
        scenario_dim(df.sparkSession), F.col("_scn_key") == F.col("_scenario"), "left") \
        .drop("_scn_key", "_scenario")


# ----------------------------------------------------------------------------- P27/P28
def to_model_input(valid: DataFrame) -> DataFrame:
    """Validated requests -> the model-input columns the feature functions expect."""
    df = valid.withColumns(R.predictor_input_columns())
    df = df.withColumn("num_connections", F.col("num_connections_input").cast("double"))
    return with_scenario_weather(df)


# ----------------------------------------------------------------------------- P33
def _factor_dim(spark, mapping: dict, key: str, val: str) -> DataFrame:
    schema = T.StructType([T.StructField(key, T.StringType()), T.StructField(val, T.DoubleType())])
    return literal_dim(spark, [(k, float(v)) for k, v in mapping.items()], schema)


def rule_baseline(df: DataFrame, house="house_type", postal="zipcode_from",
                  scenario="scenario", smart="smart_meter", out="prediction_kwh") -> DataFrame:
    """base[house type] x location[first two postal digits] x weather[scenario] x smart
    factor; missing lookups use 2400 / 1.0 / 1.0."""
    spark = df.sparkSession
    j = (df.withColumns({"_h": F.col(house), "_a": F.substring(F.col(postal), 1, 2),
                         "_w": F.col(scenario)})
         .join(_factor_dim(spark, K.RULE_BASE_KWH, "_hk", "_base"), F.col("_h") == F.col("_hk"), "left")
         .join(_factor_dim(spark, K.RULE_LOCATION_FACTOR, "_ak", "_loc"), F.col("_a") == F.col("_ak"), "left")
         .join(_factor_dim(spark, K.RULE_WEATHER_FACTOR, "_wk", "_wf"), F.col("_w") == F.col("_wk"), "left"))
    pred = (F.coalesce("_base", F.lit(K.RULE_BASE_DEFAULT)) * F.coalesce("_loc", F.lit(1.0))
            * F.coalesce("_wf", F.lit(1.0))
            * F.when(F.col(smart), F.lit(K.RULE_SMART_FACTOR)).otherwise(F.lit(1.0)))
    return j.withColumn(out, pred).drop("_h", "_a", "_w", "_hk", "_base", "_ak", "_loc", "_wk", "_wf")


# ----------------------------------------------------------------------------- P24/P25
def derived_outputs(pred: str = "prediction_kwh") -> dict[str, Column]:
    p = F.col(pred)
    monthly_cost = p / F.lit(12.0) * F.lit(K.TARIFF_EUR_PER_KWH)
    return {
        "monthly_kwh": p / F.lit(12.0),
        "daily_kwh": p / F.lit(365.0),
        "estimated_monthly_cost": monthly_cost,
        "estimated_yearly_cost": monthly_cost * F.lit(12.0),
    }


def comparison_text(pct: Column) -> Column:
    expr = None
    for bound, text in K.COMPARISON_TEXT:
        expr = F.when(pct < F.lit(bound), text) if expr is None else expr.when(pct < F.lit(bound), text)
    return expr.otherwise(K.COMPARISON_TEXT_ELSE)


def comparison(pred: str = "prediction_kwh") -> dict[str, Column]:
    typical = float(K.TYPICAL_HOUSEHOLD_KWH)
    diff = F.col(pred) - F.lit(typical)
    pct = diff / F.lit(typical) * F.lit(100.0)
    return {"typical_dutch_household_kwh": F.lit(K.TYPICAL_HOUSEHOLD_KWH),
            "difference_kwh": diff, "percentage_difference": pct,
            "comparison_text": comparison_text(pct)}


# ----------------------------------------------------------------------------- P32 / F7
def insights(pct: str = "percentage_difference", scenario: str = "scenario",
             smart: str = "smart_meter") -> Column:
    p = F.col(pct)
    return F.array_compact(F.array(
        F.when(p > 20, F.lit(K.INSIGHT_HIGH)).when(p < -20, F.lit(K.INSIGHT_LOW))
         .otherwise(F.lit(K.INSIGHT_NEAR)),
        F.when(F.col(scenario) == "cold", F.lit(K.INSIGHT_COLD))
         .when(F.col(scenario) == "warm", F.lit(K.INSIGHT_WARM)),
        F.when(F.col(smart), F.lit(K.INSIGHT_SMART)).otherwise(F.lit(K.INSIGHT_NO_SMART))))


def sane(pred: str = "prediction_kwh") -> Column:
    return F.col(pred).between(K.SANITY_MIN_KWH, K.SANITY_MAX_KWH)


# ----------------------------------------------------------------------------- B2
def expand_scenarios(df: DataFrame, scenario: str = "scenario") -> DataFrame:
    """Each row once per weather scenario (an explode over the fixed scenario list, then the
    scenario lookup) - no cross join."""
    names = list(K.WEATHER_SCENARIOS)
    out = df.drop(*[c for c in ("avg_temp", "total_precipitation", "total_sunshine_hours",
                                "avg_wind_speed", "avg_min_temp", "avg_max_temp",
                                "avg_precipitation", "total_global_radiation") if c in df.columns])
    out = out.withColumn(scenario, F.explode(F.array(*[F.lit(n) for n in names])))
    return with_scenario_weather(out, scenario)


# ----------------------------------------------------------------------------- S16 / T4
def response(df: DataFrame, model_used: str, pred: str = "prediction_kwh",
             ts: str = "ts") -> DataFrame:
    """Nested response rows: outputs, ``input_summary`` and ``comparison_to_average``."""
    d = derived_outputs(pred)
    c = comparison(pred)
    summary = F.struct(*[F.col(x).alias(x) for x in (
        "zipcode_from", "city", "company", "type_of_connection", "circuits_per_household_input",
        "num_connections", "perc_of_active_connections", "delivery_perc", "smartmeter_perc",
        "annual_consume", "scenario", "avg_temp", "total_precipitation", "total_sunshine_hours",
        "avg_wind_speed", "avg_min_temp", "avg_max_temp", "avg_precipitation",
        "total_global_radiation")])
    return df.select(
        "request_id", F.col(pred).alias("prediction_kwh"), *[v.alias(k) for k, v in d.items()],
        F.lit(model_used).alias("model_used"), summary.alias("input_summary"),
        F.struct(*[v.alias(k) for k, v in c.items()]).alias("comparison_to_average"),
        F.col(ts).alias("timestamp"))


def latest(df: DataFrame, n: int = 5, ts: str = "timestamp", tie: str = "request_id") -> DataFrame:
    """Most recent ``n`` rows (top-k: per-task top-n then one small merge)."""
    return df.orderBy(F.col(ts).desc(), F.col(tie).desc()).limit(n)
