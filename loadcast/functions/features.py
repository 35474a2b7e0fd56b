"""Feature derivation as native Column expressions (no Python UDFs).

One function set serves training, batch scoring and the streaming scorer, so training and
serving derive identical features. Null handling follows numpy/pandas semantics where the
results differ from Spark's (``greatest(NULL, x)`` is ``x`` in Spark but NaN in numpy): every
floor/ceiling is guarded with ``when(c.isNotNull(), ...)``; comparisons against null fall to the
``otherwise`` branch, as NaN comparisons are False.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import constants as K


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _bucket(value: Column, bounds, last: str) -> Column:
    """Right-closed buckets: first bound b with value <= b wins; null/NaN -> ``last``."""
    expr = None
    for bound, label in bounds:
        expr = (F.when(value <= F.lit(float(bound)), label) if expr is None
                else expr.when(value <= F.lit(float(bound)), label))
    return expr.otherwise(last)


def _flag(cond: Column) -> Column:
    return F.when(cond, 1).otherwise(0)


def _floor_guarded(value: Column, floor: float) -> Column:
    return F.when(value.isNotNull(), F.greatest(value, F.lit(float(floor))))


# ----------------------------------------------------------------------------- P1
def consumption_per_connection(annual="annual_consume", connections="num_connections") -> Column:
    return _c(annual) / _floor_guarded(_c(connections), K.CONSUMPTION_CONNECTION_FLOOR)


# ----------------------------------------------------------------------------- P5 / P6
def circuits_per_household(conn_type="type_of_connection") -> Column:
    """Substring rules on the upper-cased type; a missing type falls to the default."""
    t = F.upper(_c(conn_type).cast("string"))
    expr = None
    for marks, circuits in K.CIRCUIT_RULES:
        cond = reduce(lambda a, b: a | b, [t.contains(m) for m in marks])
        expr = F.when(cond, circuits) if expr is None else expr.when(cond, circuits)
    return expr.otherwise(K.CIRCUITS_DEFAULT)


def estimated_households(connections="num_connections", conn_type="type_of_connection") -> Column:
    return _floor_guarded(_c(connections) / circuits_per_household(conn_type), K.HOUSEHOLD_FLOOR)


def household_consumption(annual="annual_consume", households="estimated_households") -> Column:
    return _c(annual) / _c(households)


# ----------------------------------------------------------------------------- P7 / P8 / P16
def postal_code_area(zipcode="zipcode_from") -> Column:
    return F.substring(_c(zipcode).cast("string"), 1, 2)


def postal_first_digit(zipcode="zipcode_from") -> Column:
    return F.substring(_c(zipcode).cast("string"), 1, 1)


def postal_province(zipcode="zipcode_from") -> Column:
    lookup = F.create_map(*[F.lit(x) for kv in K.PROVINCES.items() for x in kv])
    return F.coalesce(F.element_at(lookup, postal_first_digit(zipcode)), F.lit(K.PROVINCE_DEFAULT))


def clean_upper(c) -> Column:
    return F.upper(F.trim(_c(c)))


def clean_lower(c) -> Column:
    return F.lower(F.trim(_c(c)))


# ----------------------------------------------------------------------------- P9 / P10 / P11
def connection_phases(clean_type="connection_type_clean") -> Column:
    digits = F.nullif(F.regexp_extract(_c(clean_type), r"(?i)(\d+)x", 1), F.lit(""))
    return F.coalesce(digits.try_cast("int"), F.lit(K.DEFAULT_PHASES))


def connection_amperage(clean_type="connection_type_clean") -> Column:
    digits = F.nullif(F.regexp_extract(_c(clean_type), r"(?i)x(\d+)", 1), F.lit(""))
    return F.coalesce(digits.try_cast("int"), F.lit(K.DEFAULT_AMPERAGE))


def voltage_flag(clean_type, marks) -> Column:
    pattern = "|".join(marks)
    return F.coalesce(_flag(_c(clean_type).rlike(pattern)), F.lit(0))


def household_size_category(capacity="total_electrical_capacity") -> Column:
    return _bucket(_c(capacity), K.SIZE_BUCKETS, K.SIZE_BUCKET_ELSE)


# ----------------------------------------------------------------------------- P13 - P15
def degree_days(temp, base: float, heating: bool) -> Column:
    t = _c(temp)
    diff = (F.lit(base) - t) if heating else (t - F.lit(base))
    return _floor_guarded(diff, 0.0) * F.lit(K.DAYS_PER_YEAR)


# ----------------------------------------------------------------------------- P19 / P20
def connection_density_category(connections="num_connections") -> Column:
    return _bucket(_c(connections), K.DENSITY_BUCKETS, K.DENSITY_BUCKET_ELSE)


def activity_level_category(active_pct="perc_of_active_connections") -> Column:
    return _bucket(_c(active_pct), K.ACTIVITY_BUCKETS, K.ACTIVITY_BUCKET_ELSE)


# ----------------------------------------------------------------------------- all features
def weather_features(temp="avg_temp", precip="total_precipitation",
                     sunshine="total_sunshine_hours") -> dict[str, Column]:
    """P13-P15 (national weather features): squared temperature, degree days, flags."""
    t = _c(temp)
    hdd = degree_days(t, K.HDD_BASE, heating=True)
    cdd = degree_days(t, K.CDD_BASE, heating=False)
    return {
        "temp_squared": t * t,
        "heating_degree_days": hdd,
        "cooling_degree_days": cdd,
        "heating_cooling_balance": hdd - cdd,
        "extreme_cold_indicator": _flag(t < F.lit(K.COLD_YEAR_T)),
        "extreme_hot_indicator": _flag(t > F.lit(K.HOT_YEAR_T)),
        "high_precipitation": _flag(_c(precip) > F.lit(K.WET_YEAR_MM)),
        "low_sunshine": _flag(_c(sunshine) < F.lit(K.DARK_YEAR_H)),
        "sunshine_ratio": _c(sunshine) / F.lit(K.SUNSHINE_NORM),
    }


def with_features(df: DataFrame, weather: bool = True) -> DataFrame:
    """Derive every training/serving feature (P5-P21) in a few ``withColumns`` projections
    that Catalyst collapses into one whole-stage-codegen projection.

    Expects ``annual_consume, num_connections, type_of_connection, zipcode_from, city, company,
    smartmeter_perc, perc_of_active_connections, avg_temp, total_precipitation,
    total_sunshine_hours``; the last three only with ``weather``.
    """
    nc = F.col("num_connections")
    act = F.col("perc_of_active_connections")
    sm = F.col("smartmeter_perc")
    step1 = {
        "circuits_per_household": circuits_per_household(),
        "postal_code_area": postal_code_area(),
        "city_clean": clean_upper("city"),
        "company_clean": clean_lower("company"),
        "connection_type_clean": clean_upper(F.col("type_of_connection").cast("string")),
        "smart_meter_adoption": sm / F.lit(100.0),
        "high_tech_area": _flag(sm > F.lit(K.HIGH_TECH_PCT)),
        "low_tech_area": _flag(sm < F.lit(K.LOW_TECH_PCT)),
        **(weather_features() if weather else {}),
        "postal_first_digit": postal_first_digit(),
        "postal_province": postal_province(),
        "total_connections": nc,
        "log_connections": F.log1p(nc),
        "active_connections_percentage": act,
        "inactive_connections_percentage": F.lit(100.0) - act,
        "active_connection_count": nc * act / F.lit(100.0),
        "connection_density_category": connection_density_category(),
        "activity_level_category": activity_level_category(),
    }
    step2 = {
        "estimated_households": _floor_guarded(nc / F.col("circuits_per_household"),
                                               K.HOUSEHOLD_FLOOR),
        "connection_phases": connection_phases(),
        "connection_amperage": connection_amperage(),
        "has_high_voltage": voltage_flag("connection_type_clean", K.HIGH_VOLTAGE_MARKS),
        "has_medium_voltage": voltage_flag("connection_type_clean", K.MEDIUM_VOLTAGE_MARKS),
        "inactive_connection_count": nc - F.col("active_connection_count"),
        "total_active_connections": F.col("active_connection_count"),
        "connection_efficiency": F.col("annual_consume") / _floor_guarded(
            F.col("active_connection_count"), 1.0),
    }
    step3 = {
        "household_consumption": F.col("annual_consume") / F.col("estimated_households"),
        "connections_per_household": nc / F.col("estimated_households"),
        "total_electrical_capacity": F.col("connection_phases") * F.col("connection_amperage"),
    }
    out = df.withColumns(step1).withColumns(step2).withColumns(step3)
    return out.withColumn("household_size_category", household_size_category())


# ----------------------------------------------------------------------------- P34 / P36
def exact_circuit_columns(conn_type="type_of_connection", connections="num_connections",
                          annual="annual_consume", active_pct="perc_of_active_connections"
                          ) -> dict[str, Column]:
    """The exact-match variant: circuits from an exact map of the raw type (unmatched ->
    NULL), households without a floor, efficiency without a floor; a zero divisor gives NULL."""
    m = F.create_map(*[F.lit(x) for kv in K.HOUSE_TYPE_CIRCUITS.items() for x in kv])
    circuits = F.element_at(m, _c(conn_type))
    households = F.try_divide(_c(connections), circuits)
    active = _c(connections) * _c(active_pct) / F.lit(100.0)
    return {
        "circuits_per_household_exact": circuits,
        "estimated_households_exact": households,
        "household_consumption_exact": F.try_divide(_c(annual), households),
        "connection_efficiency_unfloored": F.try_divide(_c(annual), active),
    }


def display_name(c) -> Column:
    """Title case for display (first letter of each word upper, the rest lower)."""
    return F.initcap(_c(c))
