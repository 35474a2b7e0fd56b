"""Scoring-request columns: schema, field defaults, validation rules and the conversion to
model input (S15, F6, P26-P30, B3) as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import constants as K

REQUEST_SCHEMA = T.StructType([
    T.StructField("request_id", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("postal_code", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("house_type", T.StringType()),
    T.StructField("num_connections", T.IntegerType()),
    T.StructField("active_connections_pct", T.DoubleType()),
    T.StructField("smart_meter", T.BooleanType()),
    T.StructField("energy_company", T.StringType()),
    T.StructField("weather_scenario", T.StringType()),
])

ERR_HOUSE = "house_type must be one of " + ", ".join(K.HOUSE_TYPES)
ERR_ACTIVE = f"active_connections_pct must be between {K.ACTIVE_PCT_MIN:g} and {K.ACTIVE_PCT_MAX:g}"
ERR_COMPANY = "energy_company must be one of " + ", ".join(K.COMPANIES)
ERR_SCENARIO = "weather_scenario must be one of " + ", ".join(K.WEATHER_SCENARIOS)
ERR_POSTAL = "postal_code must be at least 2 digits"


def with_field_defaults(df: DataFrame) -> DataFrame:
    """Absent (null) fields take the request defaults; postal code, city and connection
    count stay optional."""
    return df.withColumns({
        "house_type": F.coalesce("house_type", F.lit(K.DEFAULT_HOUSE_TYPE)),
        "active_connections_pct": F.coalesce("active_connections_pct",
                                             F.lit(K.DEFAULT_ACTIVE_PCT)),
        "smart_meter": F.coalesce("smart_meter", F.lit(True)),
        "energy_company": F.coalesce("energy_company", F.lit(K.DEFAULT_COMPANY)),
        "weather_scenario": F.coalesce("weather_scenario", F.lit(K.SCENARIO_DEFAULT)),
    })


def cleaned_postal(c="postal_code") -> Column:
    """strip surrounding whitespace, then remove inner spaces."""
    col = F.col(c) if isinstance(c, str) else c
    return F.replace(F.regexp_replace(col, r"^\s+|\s+$", ""), F.lit(" "), F.lit(""))


def normalized_postal(c="postal_code") -> Column:
    """First four characters, right-padded with '0' to four."""
    return F.rpad(F.substring(cleaned_postal(c), 1, 4), 4, "0")


def validation_errors() -> Column:
    """array of rule violations (empty = valid). House type is case-sensitive; company and
    scenario are compared case-folded; the active share is inclusive 50..95; a given postal
    code must be all digits and at least two long."""
    pc = cleaned_postal("postal_code")
    bad_postal = F.col("postal_code").isNotNull() & ~(
        pc.rlike(r"^[0-9]+$") & (F.length(pc) >= 2))
    checks = [
        (~F.col("house_type").isin(K.HOUSE_TYPES), ERR_HOUSE),
        (~F.col("active_connections_pct").between(K.ACTIVE_PCT_MIN, K.ACTIVE_PCT_MAX), ERR_ACTIVE),
        (~F.lower("energy_company").isin(K.COMPANIES), ERR_COMPANY),
        (~F.lower("weather_scenario").isin(list(K.WEATHER_SCENARIOS)), ERR_SCENARIO),
        (bad_postal, ERR_POSTAL),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(True)), F.lit(msg))
                                     for cond, msg in checks]))


def circuits_for_house_type(c="house_type") -> Column:
    m = F.create_map(*[F.lit(x) for kv in K.HOUSE_TYPE_CIRCUITS.items() for x in kv])
    return F.coalesce(F.element_at(m, F.col(c)), F.lit(K.HOUSE_TYPE_CIRCUITS_DEFAULT))


def predictor_input_columns() -> dict[str, Column]:
    """Validated request -> model input row (weather comes from the scenario join)."""
    postal_given = F.col("postal_code").isNotNull() & (F.col("postal_code") != "")
    circuits = circuits_for_house_type()
    nc = F.col("num_connections")
    return {
        "zipcode_from": F.when(postal_given, normalized_postal()).otherwise(F.lit(K.DEFAULT_POSTAL)),
        "city": F.when(F.col("city").isNotNull() & (F.col("city") != ""), F.col("city"))
                 .otherwise(F.lit(K.DEFAULT_CITY)),
        "company": F.lower("energy_company"),
        "type_of_connection": F.col("house_type"),
        "circuits_per_household_input": circuits,
        "num_connections_input": F.when(nc.isNotNull() & (nc != 0), nc)
                                  .otherwise(F.lit(K.DEFAULT_NUM_CONNECTIONS)),
        "perc_of_active_connections": F.col("active_connections_pct"),
        "delivery_perc": F.lit(K.DEFAULT_DELIVERY_PCT),
        "smartmeter_perc": F.when(F.col("smart_meter"), F.lit(K.SMART_METER_PCT[0]))
                            .otherwise(F.lit(K.SMART_METER_PCT[1])),
        "annual_consume": (F.lit(K.ANNUAL_CONSUME_PER_CIRCUIT) * circuits).cast("double"),
        "scenario": F.lower("weather_scenario"),
    }


def density_connections(word: Column) -> Column:
    """Density word -> connection count (urban 500, rural 50, anything else 30)."""
    m = F.create_map(*[F.lit(x) for kv in K.DENSITY_CONNECTIONS.items() for x in kv])
    return F.coalesce(F.element_at(m, F.lower(word)), F.lit(K.DENSITY_DEFAULT))


def activity_or_default(pct: Column) -> Column:
    """An activity share outside 50..95 falls back to 88."""
    return F.when(pct.between(K.ACTIVE_PCT_MIN, K.ACTIVE_PCT_MAX), pct) \
            .otherwise(F.lit(K.DEFAULT_ACTIVE_PCT))


def args_input_columns(house="house_type", area="postal_area", weather="weather",
                       smart="smart_meter") -> dict[str, Column]:
    """Compact arguments (house type, 2-digit area, weather word, smart meter) -> full
    model input. Unknown house types become 3x25, unknown weather 'normal'."""
    ht = F.upper(F.col(house))
    known = [t.upper() for t in K.HOUSE_TYPES]
    w = F.lower(F.col(weather))
    return {
        "zipcode_from": F.concat(F.col(area), F.lit("00")),
        "city": F.lit(K.DEFAULT_CITY),
        "company": F.lit(K.DEFAULT_COMPANY),
        "num_connections_input": F.lit(K.DEFAULT_NUM_CONNECTIONS),
        "perc_of_active_connections": F.lit(K.DEFAULT_ACTIVE_PCT),
        "delivery_perc": F.lit(K.DEFAULT_DELIVERY_PCT),
        "smartmeter_perc": F.when(F.col(smart), F.lit(K.SMART_METER_PCT[0]))
                            .otherwise(F.lit(K.SMART_METER_PCT[1])),
        "annual_consume": F.lit(float(K.ANNUAL_CONSUME_PER_CIRCUIT)),
        "type_of_connection": F.when(ht.isin(known), F.lower(ht)).otherwise(F.lit(K.DEFAULT_HOUSE_TYPE)),
        "scenario": F.when(w.isin(list(K.WEATHER_SCENARIOS)), w).otherwise(F.lit(K.SCENARIO_DEFAULT)),
    }
