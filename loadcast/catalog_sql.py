"""Oracle SQL (DuckDB dialect) for every registry query.

Written independently of the Spark code: the stand-in derivations, feature formulas and
aggregates are restated here as plain SQL over the benchmark tables, so a mistake in the
DataFrame code shows up as a mismatch instead of being copied into its own check.
"""

from __future__ import annotations

ENERGY_AREA = """
energy_area AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    l_extendedprice / 8.0::DOUBLE AS annual_consume,
    CASE WHEN l_quantity <> 13.0::DOUBLE THEN l_quantity END AS num_connections,
    CASE WHEN l_partkey % 53 <> 0
         THEN ['1x25','1x35','3x25','3x35','3x50','3x63','3x80'][l_linenumber] END
      AS type_of_connection,
    (100.0::DOUBLE - 1000.0::DOUBLE * l_discount) + 0.0::DOUBLE AS perc_of_active_connections,
    CASE WHEN l_orderkey % 41 <> 0 THEN 1000.0::DOUBLE * l_tax + 0.0::DOUBLE END AS smartmeter_perc,
    (100.0::DOUBLE - 100.0::DOUBLE * l_tax) + 0.0::DOUBLE AS delivery_perc,
    CASE WHEN l_suppkey % 37 <> 36 THEN CAST(1000 + (l_suppkey * 89) % 9000 AS VARCHAR) END
      AS zipcode_from,
    s_name AS city, n_name AS company, 'electricity' AS energy_type,
    CAST(year(l_shipdate) AS INTEGER) AS year,
    lower(translate(n_name, ' _', '--')) || '_electricity_'
      || CASE WHEN l_suppkey % 2 = 1 THEN '0101' ELSE '' END
      || CAST(year(l_shipdate) AS VARCHAR) || '.csv' AS source_file
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
)"""

WEATHER_RAW = """
weather_raw AS (
  SELECT o_orderkey AS obs_id,
    ['240','260','330','370','391'][CAST(substr(o_orderpriority, 1, 1) AS INTEGER)] AS STN,
    strftime(o_orderdate, '%Y%m%d') AS YYYYMMDD,
    CAST(o_custkey % 250 AS DOUBLE) AS TG,
    CAST(o_custkey % 250 AS DOUBLE) - 40.0::DOUBLE AS TN,
    CAST(o_custkey % 250 AS DOUBLE) + 40.0::DOUBLE AS TX,
    CASE WHEN o_orderkey % 97 <> 0 THEN CAST(o_orderkey % 80 AS DOUBLE) END AS RH,
    CAST(o_orderkey % 120 AS DOUBLE) AS DR,
    CAST(o_custkey % 90 AS DOUBLE) AS FG,
    CAST(o_orderkey % 3000 AS DOUBLE) AS Q
  FROM orders
)"""

WEATHER_UNITS = """
weather_units AS (
  SELECT obs_id, STN, YYYYMMDD, TG / 10.0::DOUBLE AS TG, TN / 10.0::DOUBLE AS TN, TX / 10.0::DOUBLE AS TX,
    RH / 10.0::DOUBLE AS RH, DR / 10.0::DOUBLE AS DR, FG / 10.0::DOUBLE AS FG, Q
  FROM weather_raw
)"""

WEATHER_DAILY = """
weather_daily AS (
  SELECT *, CAST(strptime(YYYYMMDD, '%Y%m%d') AS DATE) AS date,
    CAST(year(strptime(YYYYMMDD, '%Y%m%d')) AS INTEGER) AS year,
    CAST(month(strptime(YYYYMMDD, '%Y%m%d')) AS INTEGER) AS month,
    CAST(day(strptime(YYYYMMDD, '%Y%m%d')) AS INTEGER) AS day
  FROM weather_units
)"""

STATIONS = """
stations(station, station_name, station_location) AS (
  VALUES ('240', 'Schiphol', 'Amsterdam area'), ('260', 'De Bilt', 'Central Netherlands'),
         ('330', 'Hoek van Holland', 'South-West Netherlands'),
         ('370', 'Eindhoven', 'South Netherlands'), ('380', 'Maastricht', 'South-East Netherlands'),
         ('280', 'Eelde', 'North Netherlands')
)"""

STATION_YEAR = """
station_year_raw AS (
  SELECT STN AS station, year,
    round_even((CAST(sum(CAST(TG AS DECIMAL(18,4))) * 10000 AS BIGINT)::DOUBLE / (count(TG) * 10000)), 2) AS avg_temp,
    round_even((CAST(sum(CAST(TN AS DECIMAL(18,4))) * 10000 AS BIGINT)::DOUBLE / (count(TN) * 10000)), 2) AS avg_min_temp,
    round_even((CAST(sum(CAST(TX AS DECIMAL(18,4))) * 10000 AS BIGINT)::DOUBLE / (count(TX) * 10000)), 2) AS avg_max_temp,
    round_even(coalesce(CAST(sum(CAST(RH AS DECIMAL(18,4))) AS DOUBLE), 0.0), 2) AS total_precipitation,
    round_even((CAST(sum(CAST(RH AS DECIMAL(18,4))) * 10000 AS BIGINT)::DOUBLE / (count(RH) * 10000)), 2) AS avg_precipitation,
    round_even(coalesce(CAST(sum(CAST(DR AS DECIMAL(18,4))) AS DOUBLE), 0.0), 2) AS total_sunshine_hours,
    round_even((CAST(sum(CAST(FG AS DECIMAL(18,4))) * 10000 AS BIGINT)::DOUBLE / (count(FG) * 10000)), 2) AS avg_wind_speed,
    round_even(coalesce(CAST(sum(CAST(Q AS DECIMAL(18,4))) AS DOUBLE), 0.0), 2) AS total_global_radiation
  FROM weather_daily GROUP BY STN, year
),
station_year AS (
  SELECT y.*, coalesce(s.station_name, 'Unknown') AS station_name,
    coalesce(s.station_location, 'Unknown') AS station_location
  FROM station_year_raw y LEFT JOIN stations s ON y.station = s.station
)"""

NATIONAL = """
national AS (
  SELECT year,
    round_even((CAST(sum(CAST(avg_temp AS DECIMAL(18,2))) * 100 AS BIGINT)::DOUBLE / (count(avg_temp) * 100)), 2) AS avg_temp, round_even((CAST(sum(CAST(avg_min_temp AS DECIMAL(18,2))) * 100 AS BIGINT)::DOUBLE / (count(avg_min_temp) * 100)), 2) AS avg_min_temp,
    round_even((CAST(sum(CAST(avg_max_temp AS DECIMAL(18,2))) * 100 AS BIGINT)::DOUBLE / (count(avg_max_temp) * 100)), 2) AS avg_max_temp,
    round_even((CAST(sum(CAST(total_precipitation AS DECIMAL(18,2))) * 100 AS BIGINT)::DOUBLE / (count(total_precipitation) * 100)), 2) AS total_precipitation,
    round_even((CAST(sum(CAST(avg_precipitation AS DECIMAL(18,2))) * 100 AS BIGINT)::DOUBLE / (count(avg_precipitation) * 100)), 2) AS avg_precipitation,
    round_even((CAST(sum(CAST(total_sunshine_hours AS DECIMAL(18,2))) * 100 AS BIGINT)::DOUBLE / (count(total_sunshine_hours) * 100)), 2) AS total_sunshine_hours,
    round_even((CAST(sum(CAST(avg_wind_speed AS DECIMAL(18,2))) * 100 AS BIGINT)::DOUBLE / (count(avg_wind_speed) * 100)), 2) AS avg_wind_speed,
    round_even((CAST(sum(CAST(total_global_radiation AS DECIMAL(18,2))) * 100 AS BIGINT)::DOUBLE / (count(total_global_radiation) * 100)), 2) AS total_global_radiation,
    'KNMI' AS data_source, '240,260,330,370' AS stations_used, 'National average' AS coverage
  FROM station_year_raw WHERE station IN ('240', '260', '330', '370') GROUP BY year
)"""

ENERGY_SUMMARY = """
energy_summary AS (
  SELECT year,
    coalesce(sum(num_connections), 0.0) AS total_connections,
    avg(annual_consume) AS avg_annual_consume,
    coalesce(sum(annual_consume), 0.0) AS total_annual_consume,
    avg(delivery_perc) AS avg_delivery_perc,
    avg(perc_of_active_connections) AS avg_active_connections_perc,
    avg(smartmeter_perc) AS avg_smartmeter_perc,
    count(DISTINCT company) AS num_companies, count(*) AS num_records
  FROM energy_area WHERE energy_type = 'electricity' GROUP BY year
)"""

INTEGRATED = """
integrated AS (
  SELECT e.*, n.avg_temp, n.avg_min_temp, n.avg_max_temp, n.total_precipitation,
    n.avg_precipitation, n.total_sunshine_hours, n.avg_wind_speed, n.total_global_radiation,
    n.data_source, n.stations_used, n.coverage, 'electricity' AS energy_type
  FROM energy_summary e JOIN national n ON e.year = n.year
)"""

WX = [WEATHER_RAW, WEATHER_UNITS, WEATHER_DAILY, STATIONS, STATION_YEAR]


def with_ctes(ctes, body: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + body


R4 = ("total_connections", "avg_annual_consume", "total_annual_consume", "avg_delivery_perc",
      "avg_active_connections_perc", "avg_smartmeter_perc")


def _digits(c: str) -> int:
    """Totals of stand-in values are exact at 5 decimals (prices / 8); means round at 6."""
    return 5 if c.startswith("total_") else 6


def _r4(prefix: str = "") -> str:
    return ", ".join(f"round_even({prefix}{c}, {_digits(c)}) AS {c}" for c in R4)


CORR_PAIRS = [(w, e) for w in ("avg_temp", "total_precipitation", "total_sunshine_hours",
                               "avg_wind_speed")
              for e in ("avg_annual_consume", "total_annual_consume")]

SQL: dict[str, str] = {}

SQL["wx_range_scan"] = with_ctes([WEATHER_RAW], """
SELECT STN, YYYYMMDD, TG, RH, Q FROM weather_raw
WHERE STN IN ('240', '330', '391') AND YYYYMMDD >= '19960101' AND YYYYMMDD <= '19991231'""")

SQL["wx_units"] = with_ctes([WEATHER_RAW, WEATHER_UNITS], "SELECT * FROM weather_units")

SQL["wx_date_parts"] = with_ctes([WEATHER_RAW, WEATHER_UNITS, WEATHER_DAILY],
                                 "SELECT STN, YYYYMMDD, CAST(date AS VARCHAR) AS date, year, month, day FROM weather_daily")

SQL["wx_station_lookup"] = with_ctes([WEATHER_RAW, STATIONS], """
SELECT d.station, coalesce(s.station_name, 'Unknown') AS station_name,
  coalesce(s.station_location, 'Unknown') AS station_location
FROM (SELECT DISTINCT STN AS station FROM weather_raw) d LEFT JOIN stations s
  ON d.station = s.station""")

SQL["wx_station_annual"] = with_ctes(WX, "SELECT * FROM station_year")

SQL["wx_national"] = with_ctes(WX + [NATIONAL], "SELECT * FROM national")

SQL["energy_annual_summary"] = with_ctes([ENERGY_AREA, ENERGY_SUMMARY], f"""
SELECT year, {_r4()}, num_companies, num_records FROM energy_summary""")

SQL["int_annual"] = with_ctes([ENERGY_AREA, ENERGY_SUMMARY] + WX + [NATIONAL, INTEGRATED], f"""
SELECT * REPLACE ({_r4()}) FROM integrated""")

SQL["int_correlation"] = with_ctes(
    [ENERGY_AREA, ENERGY_SUMMARY] + WX + [NATIONAL, INTEGRATED],
    "SELECT 'electricity' AS energy_type, " + ", ".join(
        f"round_even(covar_pop({w}, {e}) / nullif(stddev_pop({w}) * stddev_pop({e}), 0), 3)"
        f" AS {w}_vs_{e}" for w, e in CORR_PAIRS)
    + ", string_agg(CAST(year AS VARCHAR), ',' ORDER BY year) AS data_years,"
      " count(*) AS sample_size FROM integrated")

# ------------------------------------------------------------------------------ features
KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
MEASURES = ("avg_temp, avg_min_temp, avg_max_temp, total_precipitation, avg_precipitation, "
            "total_sunshine_hours, avg_wind_speed, total_global_radiation")

AREA_WEATHER = f"""
area_weather AS (
  SELECT a.*, {', '.join('n.' + m.strip() for m in MEASURES.split(','))}
  FROM energy_area a JOIN national n ON a.year = n.year
)"""

CIRCUITS = """CASE WHEN upper({t}) LIKE '%1X25%' OR upper({t}) LIKE '%1X35%' THEN 10
         WHEN upper({t}) LIKE '%3X25%' THEN 14 WHEN upper({t}) LIKE '%3X35%' THEN 18
         WHEN upper({t}) LIKE '%3X50%' OR upper({t}) LIKE '%3X63%' THEN 22 ELSE 12 END"""

FEATURES = """
fx1 AS (
  SELECT *, """ + CIRCUITS.format(t="type_of_connection") + """ AS circuits_per_household
  FROM area_weather
),
fx2 AS (
  SELECT *,
    CASE WHEN num_connections IS NOT NULL
         THEN greatest(num_connections / circuits_per_household, 0.1::DOUBLE) END
      AS estimated_households,
    substr(zipcode_from, 1, 2) AS postal_code_area,
    substr(zipcode_from, 1, 1) AS postal_first_digit,
    CASE substr(zipcode_from, 1, 1) WHEN '1' THEN 'west_holland' WHEN '2' THEN 'west_holland'
      WHEN '3' THEN 'central' WHEN '4' THEN 'southwest' WHEN '5' THEN 'south'
      WHEN '6' THEN 'east' WHEN '7' THEN 'northeast' WHEN '8' THEN 'north'
      WHEN '9' THEN 'north' ELSE 'other' END AS postal_province,
    upper(trim(city)) AS city_clean, lower(trim(company)) AS company_clean,
    upper(trim(type_of_connection)) AS connection_type_clean,
    smartmeter_perc / 100.0::DOUBLE AS smart_meter_adoption,
    CASE WHEN smartmeter_perc > 75 THEN 1 ELSE 0 END AS high_tech_area,
    CASE WHEN smartmeter_perc < 25 THEN 1 ELSE 0 END AS low_tech_area,
    avg_temp * avg_temp AS temp_squared,
    CASE WHEN avg_temp IS NOT NULL THEN greatest(18.0::DOUBLE - avg_temp, 0.0::DOUBLE) END * 365
      AS heating_degree_days,
    CASE WHEN avg_temp IS NOT NULL THEN greatest(avg_temp - 22.0::DOUBLE, 0.0::DOUBLE) END * 365
      AS cooling_degree_days,
    CASE WHEN avg_temp < 5 THEN 1 ELSE 0 END AS extreme_cold_indicator,
    CASE WHEN avg_temp > 15 THEN 1 ELSE 0 END AS extreme_hot_indicator,
    CASE WHEN total_precipitation > 900 THEN 1 ELSE 0 END AS high_precipitation,
    CASE WHEN total_sunshine_hours < 1400 THEN 1 ELSE 0 END AS low_sunshine,
    total_sunshine_hours / 1800.0::DOUBLE AS sunshine_ratio,
    num_connections AS total_connections,
    round_even(ln(1 + num_connections), 9) AS log_connections,
    perc_of_active_connections AS active_connections_percentage,
    100.0::DOUBLE - perc_of_active_connections AS inactive_connections_percentage,
    num_connections * perc_of_active_connections / 100.0::DOUBLE AS active_connection_count,
    CASE WHEN num_connections <= 50 THEN 'very_low_density'
      WHEN num_connections <= 200 THEN 'low_density'
      WHEN num_connections <= 500 THEN 'medium_density'
      WHEN num_connections <= 1000 THEN 'high_density' ELSE 'very_high_density' END
      AS connection_density_category,
    CASE WHEN perc_of_active_connections <= 50 THEN 'low_activity'
      WHEN perc_of_active_connections <= 75 THEN 'medium_activity'
      WHEN perc_of_active_connections <= 90 THEN 'high_activity' ELSE 'very_high_activity' END
      AS activity_level_category
  FROM fx1
),
fx3 AS (
  SELECT *,
    annual_consume / estimated_households AS household_consumption,
    num_connections / estimated_households AS connections_per_household,
    coalesce(TRY_CAST(nullif(regexp_extract(connection_type_clean, '(?i)(\\d+)x', 1), '') AS INTEGER), 1)
      AS connection_phases,
    coalesce(TRY_CAST(nullif(regexp_extract(connection_type_clean, '(?i)x(\\d+)', 1), '') AS INTEGER), 25)
      AS connection_amperage,
    CASE WHEN regexp_matches(connection_type_clean, '400|500|1000') THEN 1 ELSE 0 END
      AS has_high_voltage,
    CASE WHEN regexp_matches(connection_type_clean, '230|240|250') THEN 1 ELSE 0 END
      AS has_medium_voltage,
    heating_degree_days - cooling_degree_days AS heating_cooling_balance,
    num_connections - active_connection_count AS inactive_connection_count,
    active_connection_count AS total_active_connections,
    annual_consume / CASE WHEN active_connection_count IS NOT NULL
                          THEN greatest(active_connection_count, 1.0::DOUBLE) END
      AS connection_efficiency
  FROM fx2
),
featured AS (
  SELECT *, connection_phases * connection_amperage AS total_electrical_capacity,
    CASE WHEN connection_phases * connection_amperage <= 25 THEN 'small_apartment'
      WHEN connection_phases * connection_amperage <= 50 THEN 'medium_apartment'
      WHEN connection_phases * connection_amperage <= 75 THEN 'large_apartment'
      WHEN connection_phases * connection_amperage <= 100 THEN 'small_house'
      ELSE 'large_house' END AS household_size_category
  FROM fx3
)"""

FEATURE_LIST = """avg_temp, total_precipitation, total_sunshine_hours, avg_wind_speed,
    cooling_degree_days, sunshine_ratio, heating_cooling_balance,
    extreme_cold_indicator, extreme_hot_indicator, high_precipitation, low_sunshine,
    connection_phases, connection_amperage, total_electrical_capacity,
    has_high_voltage, has_medium_voltage, household_size_category, connection_type_clean,
    smart_meter_adoption, high_tech_area, low_tech_area,
    total_connections, log_connections, connections_per_household,
    active_connections_percentage, inactive_connections_percentage,
    active_connection_count, inactive_connection_count,
    connection_density_category, activity_level_category,
    total_active_connections, connection_efficiency,
    postal_code_area, postal_province, city_clean, company_clean"""

FEAT_CTES = [ENERGY_AREA] + WX + [NATIONAL, AREA_WEATHER, FEATURES]


def feat(cols: str) -> str:
    return with_ctes(FEAT_CTES, f"SELECT {KEYS}, {cols} FROM featured")


SQL["feat_weather_join"] = with_ctes([ENERGY_AREA] + WX + [NATIONAL, AREA_WEATHER],
                                     f"SELECT {KEYS}, year, {MEASURES} FROM area_weather")
SQL["feat_cons_per_connection"] = with_ctes([ENERGY_AREA], f"""
SELECT {KEYS}, annual_consume / CASE WHEN num_connections IS NOT NULL
  THEN greatest(num_connections, 0.1::DOUBLE) END AS consumption_per_connection
FROM energy_area""")
SQL["feat_households"] = feat("circuits_per_household, estimated_households, household_consumption")
SQL["feat_postal"] = feat("postal_code_area, postal_first_digit, postal_province")
SQL["feat_clean_strings"] = feat("city_clean, company_clean, connection_type_clean")
SQL["feat_capacity"] = feat("connection_phases, connection_amperage, total_electrical_capacity, "
                            "household_size_category")
SQL["feat_voltage"] = with_ctes([ENERGY_AREA], f"""
SELECT {KEYS},
  CASE WHEN regexp_matches(upper(trim(concat_ws(' ', type_of_connection, zipcode_from))),
       '400|500|1000') THEN 1 ELSE 0 END AS has_high_voltage,
  CASE WHEN regexp_matches(upper(trim(concat_ws(' ', type_of_connection, zipcode_from))),
       '230|240|250') THEN 1 ELSE 0 END AS has_medium_voltage
FROM energy_area""")
SQL["feat_smart_meter"] = feat("smart_meter_adoption, high_tech_area, low_tech_area")
SQL["feat_weather"] = with_ctes([WEATHER_RAW, WEATHER_UNITS], """
SELECT obs_id, TG * TG AS temp_squared,
  CASE WHEN TG IS NOT NULL THEN greatest(18.0::DOUBLE - TG, 0.0::DOUBLE) END * 365 AS heating_degree_days,
  CASE WHEN TG IS NOT NULL THEN greatest(TG - 22.0::DOUBLE, 0.0::DOUBLE) END * 365 AS cooling_degree_days,
  CASE WHEN TG IS NOT NULL THEN greatest(18.0::DOUBLE - TG, 0.0::DOUBLE) END * 365
    - CASE WHEN TG IS NOT NULL THEN greatest(TG - 22.0::DOUBLE, 0.0::DOUBLE) END * 365
    AS heating_cooling_balance,
  CASE WHEN TG < 5 THEN 1 ELSE 0 END AS extreme_cold_indicator,
  CASE WHEN TG > 15 THEN 1 ELSE 0 END AS extreme_hot_indicator,
  CASE WHEN 200.0::DOUBLE * RH > 900 THEN 1 ELSE 0 END AS high_precipitation,
  CASE WHEN Q < 1400 THEN 1 ELSE 0 END AS low_sunshine,
  Q / 1800.0::DOUBLE AS sunshine_ratio
FROM weather_units""")
SQL["feat_connections"] = feat(
    "total_connections, log_connections, connections_per_household, "
    "active_connections_percentage, inactive_connections_percentage, active_connection_count, "
    "inactive_connection_count, total_active_connections, connection_efficiency")
SQL["feat_density"] = with_ctes([ENERGY_AREA], f"""
SELECT {KEYS},
  CASE WHEN num_connections * 25.0::DOUBLE <= 50 THEN 'very_low_density'
    WHEN num_connections * 25.0::DOUBLE <= 200 THEN 'low_density'
    WHEN num_connections * 25.0::DOUBLE <= 500 THEN 'medium_density'
    WHEN num_connections * 25.0::DOUBLE <= 1000 THEN 'high_density' ELSE 'very_high_density' END
    AS connection_density_category,
  CASE WHEN perc_of_active_connections <= 50 THEN 'low_activity'
    WHEN perc_of_active_connections <= 75 THEN 'medium_activity'
    WHEN perc_of_active_connections <= 90 THEN 'high_activity' ELSE 'very_high_activity' END
    AS activity_level_category
FROM energy_area""")
SQL["feat_matrix"] = feat(FEATURE_LIST + ", household_consumption")

# ------------------------------------------------------------------------------ quality
COMPLETE = """
complete AS (
  SELECT *, """ + "CASE WHEN num_connections IS NOT NULL THEN greatest(num_connections / (" \
    + CIRCUITS.format(t="type_of_connection") + """), 0.1::DOUBLE) END AS prelim_households
  FROM area_weather
  WHERE annual_consume IS NOT NULL AND num_connections IS NOT NULL AND avg_temp IS NOT NULL
    AND total_precipitation IS NOT NULL AND delivery_perc IS NOT NULL
    AND perc_of_active_connections IS NOT NULL AND smartmeter_perc IS NOT NULL
),
complete_hh AS (
  SELECT *, annual_consume / prelim_households AS preliminary_household_consumption FROM complete
)"""

QUARTILES = """
quartiles AS (
  SELECT type_of_connection, count(*) AS group_rows,
    quantile_cont(preliminary_household_consumption, 0.25) AS q1,
    quantile_cont(preliminary_household_consumption, 0.75) AS q3
  FROM complete_hh WHERE type_of_connection IS NOT NULL GROUP BY type_of_connection
),
bounds AS (
  SELECT *, q1 - 2.0::DOUBLE * (q3 - q1) AS lower_bound, q3 + 2.0::DOUBLE * (q3 - q1) AS upper_bound
  FROM quartiles
)"""

DQ_CTES = [ENERGY_AREA] + WX + [NATIONAL, AREA_WEATHER, COMPLETE]

SQL["dq_dropna"] = with_ctes(DQ_CTES, f"SELECT {KEYS} FROM complete")
SQL["dq_range"] = with_ctes(DQ_CTES, f"""
SELECT {KEYS}, preliminary_household_consumption FROM complete_hh
WHERE perc_of_active_connections >= 30
  AND preliminary_household_consumption BETWEEN 500 AND 8000""")
SQL["dq_quartiles"] = with_ctes(DQ_CTES + [QUARTILES], """
SELECT type_of_connection, group_rows, round_even(q1, 6) AS q1, round_even(q3, 6) AS q3,
  round_even(lower_bound, 6) AS lower_bound, round_even(upper_bound, 6) AS upper_bound
FROM bounds""")
SQL["dq_iqr_filter"] = with_ctes(DQ_CTES + [QUARTILES], f"""
SELECT {', '.join('c.' + k.strip() for k in KEYS.split(','))} FROM complete_hh c
JOIN bounds b ON c.type_of_connection = b.type_of_connection
WHERE b.group_rows <= 20
   OR c.preliminary_household_consumption BETWEEN b.lower_bound AND b.upper_bound""")
SQL["dq_sketch_quantiles"] = with_ctes([ENERGY_AREA], " UNION ALL ".join(
    f"SELECT '{c}' AS column, {p}::DOUBLE AS prob, count({c}) AS n, "
    f"round_even(quantile_cont({c}, {p}), 4) AS quantile, 1::INTEGER AS within_error "
    f"FROM energy_area" for c in ("annual_consume", "num_connections", "smartmeter_perc")
    for p in (0.25, 0.5, 0.75)))
SQL["dq_funnel"] = with_ctes([ENERGY_AREA] + WX + [NATIONAL], """
, flags AS (
  SELECT a.*, n.year IS NOT NULL AS merged, n.avg_temp, n.total_precipitation,
    CASE WHEN a.num_connections IS NOT NULL THEN greatest(a.num_connections / ("""
    + CIRCUITS.format(t="a.type_of_connection") + """), 0.1::DOUBLE) END AS hh
  FROM energy_area a LEFT JOIN national n ON a.year = n.year
), flags2 AS (
  SELECT *, merged AND annual_consume IS NOT NULL AND num_connections IS NOT NULL
    AND avg_temp IS NOT NULL AND total_precipitation IS NOT NULL AND delivery_perc IS NOT NULL
    AND perc_of_active_connections IS NOT NULL AND smartmeter_perc IS NOT NULL AS complete
  FROM flags
)
SELECT count(*) AS after_load, CAST(count_if(merged) AS BIGINT) AS after_merge,
  CAST(count_if(complete) AS BIGINT) AS after_dropna,
  CAST(count_if(complete AND perc_of_active_connections >= 30) AS BIGINT) AS after_active_filter,
  CAST(count_if(complete AND perc_of_active_connections >= 30
           AND annual_consume / hh BETWEEN 500 AND 8000) AS BIGINT) AS after_range_filter
FROM flags2""".replace("WITH ", "WITH ", 1))

# ------------------------------------------------------------------------------ reports
SQL["rep_target_stats"] = with_ctes(FEAT_CTES, """
SELECT min(household_consumption) AS min, max(household_consumption) AS max,
  round_even(avg(household_consumption), 4) AS mean, count(household_consumption) AS n
FROM featured""")
SQL["rep_by_type"] = with_ctes(FEAT_CTES, """
SELECT type_of_connection, round_even(avg(household_consumption), 4) AS mean_household_consumption,
  count(*) AS n
FROM featured WHERE type_of_connection IS NOT NULL GROUP BY type_of_connection""")
SQL["rep_histogram"] = with_ctes(FEAT_CTES, """
, st AS (SELECT min(household_consumption) AS lo, max(household_consumption) AS hi FROM featured),
w AS (SELECT lo, CASE WHEN hi > lo THEN (hi - lo) / 8 ELSE 1.0::DOUBLE END AS width FROM st),
b AS (
  SELECT CAST(least(floor((household_consumption - lo) / width), 7) AS INTEGER) AS bin, lo, width
  FROM featured, w WHERE household_consumption IS NOT NULL
)
, c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin)
SELECT CAST(i AS INTEGER) AS bin, round_even(lo + i * width, 4) AS bin_lo,
  round_even(lo + (i + 1) * width, 4) AS bin_hi, coalesce(n, 0) AS n
FROM range(8) r(i) CROSS JOIN w LEFT JOIN c ON c.bin = i""")
REPORT_MEANS = ["household_consumption", "estimated_households", "connection_efficiency",
                "active_connection_count", "smart_meter_adoption", "total_electrical_capacity",
                "sunshine_ratio", "inactive_connections_percentage"]
SQL["rep_feature_means"] = with_ctes(FEAT_CTES, "SELECT " + ", ".join(
    f"round_even(avg({c}), 4) AS mean_{c}" for c in REPORT_MEANS) + " FROM featured")

# ------------------------------------------------------------------------------ ML prep
CATS = ["postal_code_area", "city_clean", "company_clean", "connection_type_clean",
        "postal_province", "household_size_category", "connection_density_category",
        "activity_level_category"]
KEY_CONCAT = ("concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), "
              "CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR))")
IS_TRAIN = f"(CAST(('0x' || substr(md5({KEY_CONCAT}), 1, 8)) AS BIGINT) % 100 < 80)"


def vocab_sql(src: str) -> str:
    parts = [f"SELECT DISTINCT '{c}' AS feature, coalesce(CAST({c} AS VARCHAR), 'nan') AS value "
             f"FROM {src}" for c in CATS]
    return ("vocab AS (SELECT feature, value, CAST(dense_rank() OVER (PARTITION BY feature "
            "ORDER BY value) - 1 AS INTEGER) AS code FROM (" + " UNION ALL ".join(parts) + "))")


SQL["ml_label_encode_fit"] = with_ctes(FEAT_CTES + [vocab_sql("featured")],
                                       "SELECT * FROM vocab")
SQL["ml_label_encode_apply"] = with_ctes(
    FEAT_CTES + [f"train AS (SELECT * FROM featured WHERE {IS_TRAIN})", vocab_sql("train")],
    f"SELECT {', '.join('f.' + k.strip() for k in KEYS.split(','))}, " + ", ".join(
        f"coalesce((SELECT code FROM vocab v WHERE v.feature = '{c}' AND "
        f"v.value = coalesce(CAST(f.{c} AS VARCHAR), 'nan')), 0) AS {c}" for c in CATS)
    + " FROM featured f")

IMPUTE = ["num_connections", "smartmeter_perc", "household_consumption", "connection_efficiency"]
SQL["ml_median_impute"] = with_ctes(
    FEAT_CTES + ["med AS (SELECT " + ", ".join(
        f"quantile_cont({c}, 0.5) AS m_{c}" for c in IMPUTE)
        + f" FROM featured WHERE {IS_TRAIN})"],
    f"SELECT {KEYS}, " + ", ".join(f"round_even(coalesce({c}, m_{c}), 6) AS {c}" for c in IMPUTE)
    + " FROM featured, med")

SQL["ml_split"] = with_ctes([ENERGY_AREA], f"SELECT {KEYS}, {IS_TRAIN} AS is_train FROM energy_area")
SQL["ml_sample_n"] = with_ctes([ENERGY_AREA], f"""
SELECT {KEYS} FROM energy_area ORDER BY md5({KEY_CONCAT}), {KEYS} LIMIT 1000""")
SQL["ml_ts_folds"] = with_ctes([ENERGY_AREA], f"""
, r AS (SELECT year, {KEYS}, row_number() OVER (ORDER BY year, {KEYS}) AS rn,
          count(*) OVER () AS n FROM energy_area),
s AS (SELECT *, n // 4 AS size FROM r)
SELECT year, {KEYS}, CAST(CASE WHEN size = 0 THEN -1
  WHEN rn >= n - size + 1 THEN 2 WHEN rn >= n - 2 * size + 1 THEN 1
  WHEN rn >= n - 3 * size + 1 THEN 0 ELSE -1 END AS INTEGER) AS fold FROM s""")

SCALE = ["annual_consume", "num_connections", "perc_of_active_connections", "smartmeter_perc"]
SQL["ml_robust_scale"] = with_ctes(
    [ENERGY_AREA, "q AS (SELECT " + ", ".join(
        f"quantile_cont({c}, 0.25) AS a_{c}, quantile_cont({c}, 0.5) AS m_{c}, "
        f"quantile_cont({c}, 0.75) AS b_{c}" for c in SCALE)
        + f" FROM energy_area WHERE {IS_TRAIN})"],
    f"SELECT {KEYS}, " + ", ".join(
        f"round_even(({c} - coalesce(m_{c}, 0)) / CASE WHEN coalesce(b_{c} - a_{c}, 0) = 0 "
        f"THEN 1.0 ELSE b_{c} - a_{c} END, 6) AS {c}" for c in SCALE)
    + " FROM energy_area, q")

SQL["ml_ols_simple"] = with_ctes([ENERGY_AREA], """
SELECT round_even(regr_slope(annual_consume, num_connections), 6) AS slope,
  round_even(regr_intercept(annual_consume, num_connections), 6) AS intercept,
  round_even(regr_r2(annual_consume, num_connections), 6) AS r2,
  CAST(regr_count(annual_consume, num_connections) AS BIGINT) AS n FROM energy_area""")

MODEL_SCORE = """
model_score AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    ['Linear Regression', 'Ridge Regression', 'Lasso Regression', 'Random Forest'][CAST(l_suppkey % 4 AS INTEGER) + 1] AS model,
    CAST(l_partkey % 3 AS INTEGER) AS fold,
    l_extendedprice / 8.0::DOUBLE AS actual,
    (l_extendedprice / 8.0::DOUBLE) * (1.0::DOUBLE + CAST((l_orderkey + l_linenumber) % 21 - 10 AS DOUBLE)
      * CAST(CAST(l_suppkey % 4 AS INTEGER) + 1 AS DOUBLE) / 100.0::DOUBLE) AS predicted
  FROM lineitem
)"""


def metrics_sql(group: str) -> str:
    return f"""metrics AS (
  SELECT {group}, count(*) AS n, sum((predicted - actual) * (predicted - actual)) AS sse,
    avg(abs(predicted - actual)) AS mae, var_pop(actual) AS var, avg(actual) AS mean_actual
  FROM model_score GROUP BY {group}
), m2 AS (
  SELECT {group}, n, 1.0 - sse / nullif(var * n, 0) AS r2, sqrt(sse / n) AS rmse, mae,
    sqrt(sse / n) / nullif(mean_actual, 0) * 100.0 AS relative_error_pct FROM metrics
)"""


SQL["ml_metrics"] = with_ctes([MODEL_SCORE, metrics_sql("model")], """
SELECT model, n, round_even(r2, 6) AS r2, round_even(rmse, 6) AS rmse, round_even(mae, 6) AS mae,
  round_even(relative_error_pct, 6) AS relative_error_pct FROM m2""")
SQL["ml_cv_summary"] = with_ctes([MODEL_SCORE, metrics_sql("model, fold")], """
SELECT model, round_even(avg(r2), 6) AS cv_r2_mean, round_even(stddev_pop(r2), 6) AS cv_r2_std,
  count(*) AS folds FROM m2 GROUP BY model""")
SQL["ml_best_model"] = with_ctes([MODEL_SCORE, metrics_sql("model")], """
SELECT arg_max(model, r2) AS best_model, round_even(max(r2), 6) AS best_r2 FROM m2""")
SQL["ml_error_report"] = with_ctes([MODEL_SCORE, metrics_sql("model")], f"""
, s AS (SELECT * FROM model_score WHERE model = (SELECT arg_max(model, r2) FROM m2)
        ORDER BY md5({KEY_CONCAT}), {KEYS} LIMIT 10)
SELECT {KEYS}, actual, predicted, round_even(predicted - actual, 1) AS error,
  round_even((predicted - actual) / nullif(actual, 0) * 100.0, 1) AS error_pct FROM s""")

# ------------------------------------------------------------------------------ requests
SCORE_REQUEST = """
score_request AS (
  SELECT event_id AS request_id, ts,
    CASE WHEN user_id % 25 <> 0 THEN CAST(user_id AS VARCHAR) END AS postal_code,
    CASE WHEN user_id % 3 = 1 THEN 'Amsterdam' WHEN user_id % 3 = 2 THEN 'rotterdam' END AS city,
    CASE event_type WHEN 'click' THEN '1x25' WHEN 'view' THEN '3x25' WHEN 'signup' THEN '3x35'
      WHEN 'purchase' THEN '3x50' ELSE CASE WHEN event_id % 2 = 0 THEN '3X25' ELSE 'bad' END END
      AS house_type,
    TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS num_connections,
    value AS active_connections_pct,
    event_id % 2 = 0 AS smart_meter,
    ['liander', 'enexis', 'STEDIN', 'unknown'][CAST(user_id % 4 AS INTEGER) + 1] AS energy_company,
    ['cold', 'NORMAL', 'warm', 'extreme'][CAST(event_id % 4 AS INTEGER) + 1] AS weather_scenario
  FROM events
)"""

CLEAN_PC = "replace(regexp_replace(postal_code, '^\\s+|\\s+$', '', 'g'), ' ', '')"
CHECKED = f"""
checked AS (
  SELECT *, concat_ws('; ',
    CASE WHEN house_type NOT IN ('1x25', '1x35', '3x25', '3x35', '3x50')
      THEN 'house_type must be one of 1x25, 1x35, 3x25, 3x35, 3x50' END,
    CASE WHEN NOT (active_connections_pct BETWEEN 50 AND 95)
      THEN 'active_connections_pct must be between 50 and 95' END,
    CASE WHEN lower(energy_company) NOT IN ('liander', 'enexis', 'stedin', 'westland-infra', 'coteq')
      THEN 'energy_company must be one of liander, enexis, stedin, westland-infra, coteq' END,
    CASE WHEN lower(weather_scenario) NOT IN ('cold', 'normal', 'warm')
      THEN 'weather_scenario must be one of cold, normal, warm' END,
    CASE WHEN postal_code IS NOT NULL AND NOT (regexp_matches({CLEAN_PC}, '^[0-9]+$')
                                               AND length({CLEAN_PC}) >= 2)
      THEN 'postal_code must be at least 2 digits' END) AS errors
  FROM score_request
),
valid AS (SELECT * FROM checked WHERE errors = '')"""

SCENARIOS = """
scenarios(scn, avg_temp, total_precipitation, total_sunshine_hours, avg_wind_speed) AS (
  VALUES ('cold', 8.0::DOUBLE, 900.0::DOUBLE, 1400.0::DOUBLE, 4.5::DOUBLE),
         ('normal', 10.5::DOUBLE, 850.0::DOUBLE, 1580.0::DOUBLE, 4.2::DOUBLE),
         ('warm', 13.0::DOUBLE, 800.0::DOUBLE, 1700.0::DOUBLE, 3.8::DOUBLE)
),
scn AS (
  SELECT *, avg_temp - 4.0::DOUBLE AS avg_min_temp, avg_temp + 4.0::DOUBLE AS avg_max_temp,
    total_precipitation / 365 AS avg_precipitation, 3400.0::DOUBLE AS total_global_radiation
  FROM scenarios
)"""

CIRC_HT = ("CASE house_type WHEN '1x25' THEN 10 WHEN '1x35' THEN 10 WHEN '3x25' THEN 14 "
           "WHEN '3x35' THEN 18 WHEN '3x50' THEN 22 ELSE 14 END")
MODEL_INPUT = f"""
inputs AS (
  SELECT request_id, ts, house_type, smart_meter,
    CASE WHEN postal_code IS NOT NULL AND postal_code <> ''
      THEN rpad(substr({CLEAN_PC}, 1, 4), 4, '0') ELSE '3500' END AS zipcode_from,
    CASE WHEN city IS NOT NULL AND city <> '' THEN city ELSE 'Utrecht' END AS city,
    lower(energy_company) AS company, house_type AS type_of_connection,
    {CIRC_HT} AS circuits_per_household_input,
    CAST(CASE WHEN num_connections IS NOT NULL AND num_connections <> 0 THEN num_connections
      ELSE 30 END AS DOUBLE) AS num_connections,
    active_connections_pct AS perc_of_active_connections,
    97.5::DOUBLE AS delivery_perc,
    CASE WHEN smart_meter THEN 75.0::DOUBLE ELSE 25.0::DOUBLE END AS smartmeter_perc,
    CAST(3500 * {CIRC_HT} AS DOUBLE) AS annual_consume,
    lower(weather_scenario) AS scenario
  FROM valid
),
model_input AS (
  SELECT i.*, s.avg_temp, s.total_precipitation, s.total_sunshine_hours, s.avg_wind_speed,
    s.avg_min_temp, s.avg_max_temp, s.avg_precipitation, s.total_global_radiation
  FROM inputs i LEFT JOIN scn s
    ON s.scn = CASE WHEN i.scenario IN ('cold', 'normal', 'warm') THEN i.scenario ELSE 'normal' END
)"""

REQ = [SCORE_REQUEST, CHECKED]
REQ_INPUT = REQ + [SCENARIOS, MODEL_INPUT]
SCN_COLS = ("avg_temp, total_precipitation, total_sunshine_hours, avg_wind_speed, avg_min_temp, "
            "avg_max_temp, avg_precipitation, total_global_radiation")

SQL["req_parse_json"] = with_ctes([SCORE_REQUEST], """
SELECT request_id, CAST(ts AS VARCHAR) AS ts, postal_code, city, house_type, num_connections,
  active_connections_pct, smart_meter, energy_company, weather_scenario FROM score_request""")
SQL["req_validate"] = with_ctes(REQ, "SELECT request_id, errors = '' AS is_valid, errors FROM checked")
SQL["req_quarantine"] = with_ctes(REQ, """
SELECT request_id, postal_code, house_type, active_connections_pct, energy_company,
  weather_scenario, errors FROM checked WHERE errors <> ''""")
SQL["req_postal_norm"] = with_ctes(REQ, f"""
SELECT request_id, postal_code, rpad(substr({CLEAN_PC}, 1, 4), 4, '0') AS postal_normalized
FROM valid WHERE postal_code IS NOT NULL""")
SQL["req_defaults"] = with_ctes(REQ_INPUT, """
SELECT request_id, zipcode_from, city, company, type_of_connection, circuits_per_household_input,
  num_connections, perc_of_active_connections, delivery_perc, smartmeter_perc, annual_consume,
  scenario FROM model_input""")
SQL["req_scenario_join"] = with_ctes(REQ_INPUT, f"SELECT request_id, scenario, {SCN_COLS} FROM model_input")
SQL["req_from_args"] = with_ctes([SCORE_REQUEST, SCENARIOS], f"""
, a AS (
  SELECT request_id, coalesce(substr(postal_code, 1, 2), '35') || '00' AS zipcode_from,
    'Utrecht' AS city, 'liander' AS company, 30 AS num_connections_input,
    88.0::DOUBLE AS perc_of_active_connections, 97.5::DOUBLE AS delivery_perc,
    CASE WHEN smart_meter THEN 75.0::DOUBLE ELSE 25.0::DOUBLE END AS smartmeter_perc,
    3500.0::DOUBLE AS annual_consume,
    CASE WHEN upper(house_type) IN ('1X25', '1X35', '3X25', '3X35', '3X50')
      THEN lower(upper(house_type)) ELSE '3x25' END AS type_of_connection,
    CASE WHEN lower(weather_scenario) IN ('cold', 'normal', 'warm') THEN lower(weather_scenario)
      ELSE 'normal' END AS scenario
  FROM score_request
)
SELECT a.*, {', '.join('s.' + c.strip() for c in SCN_COLS.split(','))}
FROM a LEFT JOIN scn s ON s.scn = a.scenario""")

# ------------------------------------------------------------------------------ scoring
RULE = """
scored AS (
  SELECT m.*,
    coalesce(CASE house_type WHEN '1x25' THEN 1800.0 WHEN '1x35' THEN 2100.0 WHEN '3x25' THEN 2400.0
      WHEN '3x35' THEN 2900.0 WHEN '3x50' THEN 3600.0 END, 2400.0)::DOUBLE
    * coalesce(CASE substr(zipcode_from, 1, 2) WHEN '10' THEN 1.15 WHEN '35' THEN 1.00
      WHEN '26' THEN 1.05 WHEN '30' THEN 0.95 WHEN '65' THEN 0.90 END, 1.0)::DOUBLE
    * coalesce(CASE scenario WHEN 'cold' THEN 1.20 WHEN 'normal' THEN 1.00 WHEN 'warm' THEN 0.85
      END, 1.0)::DOUBLE
    * CASE WHEN smart_meter THEN 0.92::DOUBLE ELSE 1.0::DOUBLE END AS prediction_kwh
  FROM model_input m
)"""
SCORED = REQ_INPUT + [RULE]
DERIVED = """prediction_kwh / 12.0::DOUBLE AS monthly_kwh, prediction_kwh / 365.0::DOUBLE AS daily_kwh,
  prediction_kwh / 12.0::DOUBLE * 0.25::DOUBLE AS estimated_monthly_cost,
  prediction_kwh / 12.0::DOUBLE * 0.25::DOUBLE * 12.0::DOUBLE AS estimated_yearly_cost"""
PCT = "((prediction_kwh - 2223.0::DOUBLE) / 2223.0::DOUBLE * 100.0::DOUBLE)"
COMPARE = f"""2223 AS typical_dutch_household_kwh, prediction_kwh - 2223.0::DOUBLE AS difference_kwh,
  {PCT} AS percentage_difference,
  CASE WHEN {PCT} < -20 THEN 'Much lower than typical Dutch household'
    WHEN {PCT} < -10 THEN 'Lower than typical Dutch household'
    WHEN {PCT} < 10 THEN 'Similar to typical Dutch household'
    WHEN {PCT} < 20 THEN 'Higher than typical Dutch household'
    ELSE 'Much higher than typical Dutch household' END AS comparison_text"""

SQL["score_rule_baseline"] = with_ctes(SCORED, "SELECT request_id, prediction_kwh FROM scored")
SQL["score_derive"] = with_ctes(SCORED, f"SELECT request_id, prediction_kwh, {DERIVED} FROM scored")
SQL["score_compare"] = with_ctes(SCORED, f"SELECT request_id, {COMPARE} FROM scored")
SQL["score_insights"] = with_ctes(SCORED, f"""
SELECT request_id, concat_ws(' | ',
  CASE WHEN {PCT} > 20 THEN 'use_high'
    WHEN {PCT} < -20 THEN 'use_low'
    ELSE 'use_typical' END,
  CASE WHEN scenario = 'cold' THEN 'heat_more'
    WHEN scenario = 'warm' THEN 'heat_less' END,
  CASE WHEN smart_meter THEN 'meter_smart'
    ELSE 'meter_plain' END) AS insights FROM scored""")
SQL["score_sanity"] = with_ctes(SCORED, """
SELECT request_id, prediction_kwh, prediction_kwh BETWEEN 500 AND 10000 AS is_sane FROM scored""")
SQL["score_scenarios"] = with_ctes(REQ_INPUT, """
, ex AS (
  SELECT i.* EXCLUDE (scenario), x.scenario FROM inputs i,
    (VALUES ('cold'), ('normal'), ('warm')) x(scenario)
), model_input2 AS (SELECT ex.*, s.avg_temp FROM ex LEFT JOIN scn s ON s.scn = ex.scenario)
SELECT request_id, scenario, avg_temp,
  coalesce(CASE house_type WHEN '1x25' THEN 1800.0 WHEN '1x35' THEN 2100.0 WHEN '3x25' THEN 2400.0
    WHEN '3x35' THEN 2900.0 WHEN '3x50' THEN 3600.0 END, 2400.0)::DOUBLE
  * coalesce(CASE substr(zipcode_from, 1, 2) WHEN '10' THEN 1.15 WHEN '35' THEN 1.00
    WHEN '26' THEN 1.05 WHEN '30' THEN 0.95 WHEN '65' THEN 0.90 END, 1.0)::DOUBLE
  * coalesce(CASE scenario WHEN 'cold' THEN 1.20 WHEN 'normal' THEN 1.00 WHEN 'warm' THEN 0.85
    END, 1.0)::DOUBLE
  * CASE WHEN smart_meter THEN 0.92::DOUBLE ELSE 1.0::DOUBLE END AS prediction_kwh
FROM model_input2""")
SQL["score_response"] = with_ctes(SCORED, f"""
SELECT request_id, prediction_kwh, {DERIVED}, 'Rule Baseline' AS model_used, zipcode_from, city,
  company, type_of_connection, circuits_per_household_input, num_connections,
  perc_of_active_connections, delivery_perc, smartmeter_perc, annual_consume, scenario,
  {SCN_COLS}, {COMPARE}, CAST(ts AS VARCHAR) AS timestamp FROM scored""")
SQL["score_latest5"] = with_ctes(SCORED, """
SELECT request_id, CAST(ts AS VARCHAR) AS timestamp, prediction_kwh FROM scored
ORDER BY ts DESC, request_id DESC LIMIT 5""")
SQL["score_features"] = with_ctes(REQ_INPUT, """
, f1 AS (
  SELECT *, CASE WHEN upper(type_of_connection) LIKE '%1X25%' OR upper(type_of_connection) LIKE '%1X35%' THEN 10
    WHEN upper(type_of_connection) LIKE '%3X25%' THEN 14 WHEN upper(type_of_connection) LIKE '%3X35%' THEN 18
    WHEN upper(type_of_connection) LIKE '%3X50%' OR upper(type_of_connection) LIKE '%3X63%' THEN 22
    ELSE 12 END AS cph
  FROM model_input
), f2 AS (
  SELECT *, greatest(num_connections / cph, 0.1::DOUBLE) AS estimated_households,
    coalesce(TRY_CAST(nullif(regexp_extract(upper(trim(type_of_connection)), '(?i)(\\d+)x', 1), '') AS INTEGER), 1) AS connection_phases,
    coalesce(TRY_CAST(nullif(regexp_extract(upper(trim(type_of_connection)), '(?i)x(\\d+)', 1), '') AS INTEGER), 25) AS connection_amperage,
    num_connections * perc_of_active_connections / 100.0::DOUBLE AS active_connection_count
  FROM f1
)
SELECT request_id, estimated_households, annual_consume / estimated_households AS household_consumption,
  substr(zipcode_from, 1, 2) AS postal_code_area,
  CASE substr(zipcode_from, 1, 1) WHEN '1' THEN 'west_holland' WHEN '2' THEN 'west_holland'
    WHEN '3' THEN 'central' WHEN '4' THEN 'southwest' WHEN '5' THEN 'south'
    WHEN '6' THEN 'east' WHEN '7' THEN 'northeast' WHEN '8' THEN 'north'
    WHEN '9' THEN 'north' ELSE 'other' END AS postal_province,
  connection_phases, connection_amperage, connection_phases * connection_amperage AS total_electrical_capacity,
  CASE WHEN connection_phases * connection_amperage <= 25 THEN 'small_apartment'
    WHEN connection_phases * connection_amperage <= 50 THEN 'medium_apartment'
    WHEN connection_phases * connection_amperage <= 75 THEN 'large_apartment'
    WHEN connection_phases * connection_amperage <= 100 THEN 'small_house' ELSE 'large_house' END
    AS household_size_category,
  CASE WHEN smartmeter_perc > 75 THEN 1 ELSE 0 END AS high_tech_area,
  CASE WHEN smartmeter_perc < 25 THEN 1 ELSE 0 END AS low_tech_area,
  greatest(18.0::DOUBLE - avg_temp, 0.0::DOUBLE) * 365 AS heating_degree_days,
  CASE WHEN total_sunshine_hours < 1400 THEN 1 ELSE 0 END AS low_sunshine,
  active_connection_count,
  annual_consume / greatest(active_connection_count, 1.0::DOUBLE) AS connection_efficiency,
  CASE WHEN num_connections <= 50 THEN 'very_low_density' WHEN num_connections <= 200 THEN 'low_density'
    WHEN num_connections <= 500 THEN 'medium_density' WHEN num_connections <= 1000 THEN 'high_density'
    ELSE 'very_high_density' END AS connection_density_category,
  CASE WHEN perc_of_active_connections <= 50 THEN 'low_activity'
    WHEN perc_of_active_connections <= 75 THEN 'medium_activity'
    WHEN perc_of_active_connections <= 90 THEN 'high_activity' ELSE 'very_high_activity' END
    AS activity_level_category
FROM f2""")

FILL_CATS = set(CATS)
_FEATS = [c.strip() for c in FEATURE_LIST.replace("\n", " ").split(",")]
SQL["score_fill"] = with_ctes(FEAT_CTES, f"SELECT {KEYS}, " + ", ".join(
    (f"coalesce({c}, 'default') AS {c}" if c in FILL_CATS else f"coalesce({c}, 0) AS {c}")
    for c in _FEATS) + " FROM featured")

# ------------------------------------------------------------------------------ sources
UND = "(length(source_file) - length(replace(source_file, '_', '')))"
LAST = "replace(string_split(source_file, '_')[-1], '.csv', '')"
AFTER = "replace(string_split(source_file, energy_type || '_')[-1], '.csv', '')"
PARSED_YEAR = f"""CASE WHEN {UND} < 2 THEN NULL
  WHEN regexp_full_match({LAST}, '[0-9]{{4}}') THEN CAST({LAST} AS INTEGER)
  WHEN contains(source_file, energy_type || '_') AND regexp_full_match({AFTER}, '[0-9]{{8}}')
    THEN CAST(substr({AFTER}, 5, 4) AS INTEGER) END"""
FILES = f"""
files AS (
  SELECT DISTINCT source_file, energy_type FROM energy_area
),
parsed AS (
  SELECT source_file, energy_type, split_part(source_file, '_', 1) AS company,
    {PARSED_YEAR} AS year FROM files
)"""
SQL["src_parse_filename"] = with_ctes([ENERGY_AREA, FILES], "SELECT * FROM parsed")
SQL["src_companies"] = with_ctes([ENERGY_AREA, FILES],
                                 "SELECT DISTINCT company FROM parsed ORDER BY company")
SQL["src_years"] = with_ctes([ENERGY_AREA, FILES],
                             "SELECT DISTINCT year FROM parsed WHERE year IS NOT NULL ORDER BY year")
SQL["src_by_year"] = with_ctes([ENERGY_AREA], f"""
SELECT {KEYS}, source_file, split_part(source_file, '_', 1) AS company, {PARSED_YEAR} AS year
FROM energy_area WHERE ({PARSED_YEAR}) = 1997""")
SQL["src_by_company"] = with_ctes([ENERGY_AREA], f"""
SELECT {KEYS}, source_file, 'NATION-1' AS company, energy_type FROM energy_area
WHERE starts_with(lower(source_file), 'nation-1')""")
SQL["src_summary"] = with_ctes([ENERGY_AREA, FILES], """
SELECT CAST(count_if(energy_type = 'electricity') AS BIGINT) AS electricity_files,
  CAST(count_if(energy_type = 'gas') AS BIGINT) AS gas_files,
  string_agg(DISTINCT company, ',' ORDER BY company) AS companies,
  coalesce(string_agg(DISTINCT CAST(year AS VARCHAR), ',' ORDER BY CAST(year AS VARCHAR))
    FILTER (WHERE energy_type = 'electricity' AND year IS NOT NULL), '') AS years_electricity,
  coalesce(string_agg(DISTINCT CAST(year AS VARCHAR), ',' ORDER BY CAST(year AS VARCHAR))
    FILTER (WHERE energy_type = 'gas' AND year IS NOT NULL), '') AS years_gas,
  count(*) AS total_files, min(year) AS min_year, max(year) AS max_year
FROM parsed""")
SQL["set_union_by_name"] = with_ctes([ENERGY_AREA], f"""
SELECT {KEYS}, annual_consume, city, NULL::VARCHAR AS company, NULL::DOUBLE AS num_connections
FROM energy_area WHERE year <= 1997
UNION ALL
SELECT {KEYS}, NULL::DOUBLE AS annual_consume, city, company, num_connections
FROM energy_area WHERE year > 1997""")
SQL["set_union_distinct"] = with_ctes([ENERGY_AREA], """
SELECT company FROM energy_area WHERE l_linenumber % 2 = 1
UNION SELECT company FROM energy_area WHERE l_linenumber % 2 = 0""")

# ------------------------------------------------------------------------------ streaming
SQL["st_station_annual"] = SQL["wx_station_annual"]
SQL["st_score_requests"] = SQL["score_response"]

# ------------------------------------------------------------------------------ variants
SQL["feat_exact_circuits"] = with_ctes([ENERGY_AREA], f"""
, c AS (
  SELECT *, CASE type_of_connection WHEN '1x25' THEN 10 WHEN '1x35' THEN 10 WHEN '3x25' THEN 14
    WHEN '3x35' THEN 18 WHEN '3x50' THEN 22 END AS circuits_per_household_exact,
    num_connections * perc_of_active_connections / 100.0::DOUBLE AS active
  FROM energy_area
), h AS (
  SELECT *, CASE WHEN circuits_per_household_exact <> 0
    THEN num_connections / circuits_per_household_exact END AS estimated_households_exact
  FROM c
)
SELECT {KEYS}, CAST(circuits_per_household_exact AS DOUBLE) AS circuits_per_household_exact,
  estimated_households_exact,
  CASE WHEN estimated_households_exact <> 0 THEN annual_consume / estimated_households_exact END
    AS household_consumption_exact,
  CASE WHEN active <> 0 THEN annual_consume / active END AS connection_efficiency_unfloored
FROM h""")
SQL["req_display_names"] = with_ctes([SCORE_REQUEST], """
SELECT request_id,
  upper(substr(city, 1, 1)) || lower(substr(city, 2)) AS city_display,
  upper(substr(energy_company, 1, 1)) || lower(substr(energy_company, 2)) AS company_display
FROM score_request""")

# ------------------------------------------------------------------------------ files
FILE_AREA = """
file_area AS (
  SELECT * EXCLUDE (smartmeter_perc, energy_type, source_file, company),
    CASE WHEN l_linenumber % 2 = 1 THEN smartmeter_perc END AS smartmeter_perc,
    CASE WHEN l_linenumber % 2 = 1 THEN 'electricity' ELSE 'gas' END AS energy_type,
    CASE WHEN l_linenumber % 2 = 1 THEN source_file
      ELSE replace(source_file, '_electricity_', '_gas_') END AS source_file,
    string_split(source_file, '_')[1] AS company
  FROM energy_area
)"""
FILE_COLS = KEYS + """, annual_consume, num_connections, type_of_connection,
  perc_of_active_connections, smartmeter_perc, delivery_perc, zipcode_from, city, source_file,
  energy_type, year"""
DAILY_COLS = "STN, YYYYMMDD, TG, TN, TX, RH, DR, FG, Q, year, month, day"
SQL["src_read_energy"] = with_ctes([ENERGY_AREA, FILE_AREA],
                                   f"SELECT {FILE_COLS}, company FROM file_area")
SQL["src_load_company"] = with_ctes([ENERGY_AREA, FILE_AREA], f"""
SELECT {FILE_COLS}, 'NATION-1' AS company FROM file_area
WHERE energy_type = 'electricity' AND starts_with(lower(source_file), 'nation-1')""")
SQL["src_load_year"] = with_ctes([ENERGY_AREA, FILE_AREA], f"""
SELECT {FILE_COLS}, company FROM file_area WHERE energy_type = 'gas' AND year = 1997""")
SQL["src_preview"] = with_ctes([ENERGY_AREA], f"""
SELECT {KEYS}, city, company, year FROM energy_area ORDER BY {KEYS} LIMIT 10""")
SQL["wx_station_text"] = with_ctes([WEATHER_RAW, WEATHER_UNITS, WEATHER_DAILY],
                                   f"SELECT {DAILY_COLS} FROM weather_daily")
SQL["wx_cache_scan"] = with_ctes([WEATHER_RAW, WEATHER_UNITS, WEATHER_DAILY], f"""
SELECT {DAILY_COLS} FROM weather_daily
WHERE STN IN ('240', '330') AND year BETWEEN 1996 AND 1998""")
SQL["wx_cache_gaps"] = with_ctes([WEATHER_RAW, WEATHER_UNITS, WEATHER_DAILY], """
, held AS (
  SELECT DISTINCT STN, variable, date FROM weather_daily, (VALUES ('TG'), ('Q')) v(variable)
  WHERE (STN IN ('240', '330') AND date < DATE '1998-03-01')
     OR (STN IN ('260', '330') AND date >= DATE '1997-05-01' AND variable = 'TG')),
asked AS (
  SELECT STN, variable, CAST(d AS DATE) AS date
  FROM (VALUES ('240'), ('260'), ('330'), ('391')) s(STN), (VALUES ('TG'), ('Q')) v(variable),
    generate_series(TIMESTAMP '1996-06-01', TIMESTAMP '1998-06-30', INTERVAL 1 DAY) g(d)),
missing AS (SELECT * FROM asked ANTI JOIN held USING (STN, variable, date)),
runs AS (SELECT *, date - CAST(row_number() OVER (PARTITION BY STN, variable ORDER BY date)
                               AS INTEGER) AS run FROM missing)
SELECT STN, variable, CAST(min(date) AS VARCHAR) AS first, CAST(max(date) AS VARCHAR) AS last
FROM runs GROUP BY STN, variable, run""")
SQL["req_density"] = """
WITH e AS (
  SELECT event_id AS request_id, value AS pct,
    ['urban', 'Rural', 'suburban', NULL][CAST(user_id % 4 AS INTEGER) + 1] AS word FROM events)
SELECT request_id,
  CAST(CASE lower(word) WHEN 'urban' THEN 500 WHEN 'rural' THEN 50 ELSE 30 END AS INTEGER)
    AS num_connections,
  CASE WHEN pct BETWEEN 50 AND 95 THEN pct ELSE 88.0 END::DOUBLE AS active_pct FROM e"""
SQL["st_quarantine"] = with_ctes(REQ, "SELECT request_id, errors FROM checked WHERE errors <> ''")

# ------------------------------------------------------------------------------ linear models


def two_features(x1: str, x2: str, y: str, source: str, alpha: float = 0.0) -> str:
    """Least squares on two features from centred sums: b1, b2, b0, r2, rmse."""
    return f"""sums AS (
  SELECT count(*) AS n, avg({x1}) AS m1, avg({x2}) AS m2, avg({y}) AS my,
    count(*) * var_pop({x1}) AS s11, count(*) * var_pop({x2}) AS s22,
    count(*) * covar_pop({x1}, {x2}) AS s12, count(*) * covar_pop({x1}, {y}) AS s1y,
    count(*) * covar_pop({x2}, {y}) AS s2y, count(*) * var_pop({y}) AS syy
  FROM {source} WHERE {x1} IS NOT NULL AND {x2} IS NOT NULL AND {y} IS NOT NULL
), slopes AS (
  SELECT *, ((s22 + {alpha}) * s1y - s12 * s2y) / ((s11 + {alpha}) * (s22 + {alpha}) - s12 * s12)
      AS b1,
    ((s11 + {alpha}) * s2y - s12 * s1y) / ((s11 + {alpha}) * (s22 + {alpha}) - s12 * s12) AS b2
  FROM sums
), fit AS (
  SELECT *, my - b1 * m1 - b2 * m2 AS b0, (b1 * s1y + b2 * s2y) / syy AS r2,
    sqrt((syy - b1 * s1y - b2 * s2y) / n) AS rmse FROM slopes
)"""


AREA_FIT = ("num_connections", "perc_of_active_connections", "annual_consume", "energy_area")
AREA_COEFS = """
SELECT round_even(b0, 4) AS intercept, round_even(b1, 4) AS coef_num_connections,
  round_even(b2, 4) AS coef_perc_of_active_connections FROM fit"""
SQL["ml_ols"] = with_ctes([ENERGY_AREA, two_features(*AREA_FIT)], AREA_COEFS)
SQL["ml_ridge"] = with_ctes([ENERGY_AREA, two_features(*AREA_FIT, 100.0)], AREA_COEFS)
SQL["ml_lasso"] = with_ctes([ENERGY_AREA], """
, m AS (
  SELECT avg(num_connections) AS mx, avg(annual_consume) AS my, var_pop(num_connections) AS q,
    covar_pop(num_connections, annual_consume) AS c
  FROM energy_area WHERE num_connections IS NOT NULL
), w AS (SELECT *, sign(c) * greatest(abs(c) - 10.0, 0.0) / q AS b FROM m)
SELECT round_even(my - b * mx, 4) AS intercept, round_even(b, 4) AS coef_num_connections FROM w""")
SQL["ml_forest_stump"] = with_ctes([ENERGY_AREA], """
, v AS (
  SELECT delivery_perc AS d, count(*) AS n, sum(annual_consume) AS s FROM energy_area GROUP BY 1
), c AS (
  SELECT a.d AS t, sum(CASE WHEN b.d <= a.d THEN b.n ELSE 0 END) AS nl,
    sum(CASE WHEN b.d <= a.d THEN b.s ELSE 0 END) AS sl, sum(b.n) AS n, sum(b.s) AS s
  FROM v a, v b GROUP BY a.d
), g AS (
  SELECT t, sl / nl AS low, (s - sl) / (n - nl) AS high FROM c WHERE nl < n
  ORDER BY sl * sl / nl + (s - sl) * (s - sl) / (n - nl) DESC LIMIT 1
)
SELECT d AS delivery_perc, round_even(CASE WHEN d <= t THEN low ELSE high END, 4) AS prediction
FROM v, g""")
SQL["ml_national_model"] = with_ctes(
    [ENERGY_AREA, ENERGY_SUMMARY] + WX + [NATIONAL, INTEGRATED, two_features(
        "avg_temp", "total_precipitation", "avg_annual_consume", "integrated")], """
SELECT round_even(r2, 3) AS r2, round_even(rmse, 3) AS rmse, round_even(b0, 3) AS intercept,
  round_even(b1, 3) AS coef_avg_temp, round_even(b2, 3) AS coef_total_precipitation FROM fit""")

# ------------------------------------------------------------------------------ trees
def tree_ctes(columns: list[str], depth: int, y: str = "annual_consume") -> list[str]:
    """``level<l>``: the rows with their node; ``best<l>``: each node's best split by value
    counts; ``stats``: each node's rows, mean and variance."""
    xs = "[" + ", ".join(columns) + "]"
    out = [f"level0 AS (SELECT 1 AS node, {xs} AS x, {y} AS y FROM energy_area WHERE "
           + " AND ".join(f"{c} IS NOT NULL" for c in [*columns, y]) + ")"]
    for d in range(depth):
        out += [f"""counts{d} AS (
  SELECT node, f, v, count(*) AS n, sum(y) AS s
  FROM (SELECT node, y, unnest(x) AS v, generate_subscripts(x, 1) AS f FROM level{d})
  GROUP BY node, f, v
)""", f"""cuts{d} AS (
  SELECT node, f, v, sum(n) OVER upto AS nl, sum(s) OVER upto AS sl,
    sum(n) OVER whole AS n, sum(s) OVER whole AS s FROM counts{d}
  WINDOW upto AS (PARTITION BY node, f ORDER BY v), whole AS (PARTITION BY node, f)
)""", f"""best{d} AS (
  SELECT node, f, v, (sl * sl / nl + (s - sl) * (s - sl) / (n - nl) - s * s / n) / n AS gain
  FROM cuts{d} WHERE nl >= 2 AND n - nl >= 2 AND n >= 5
  QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, v) = 1
)""", f"""level{d + 1} AS (
  SELECT CAST(2 * l.node + CASE WHEN l.x[b.f] <= b.v THEN 0 ELSE 1 END AS INTEGER) AS node, l.x,
    l.y FROM level{d} l JOIN best{d} b USING (node)
)"""]
    every = " UNION ALL ".join(f"SELECT node, y FROM level{d}" for d in range(depth + 1))
    splits = " UNION ALL ".join(f"SELECT * FROM best{d}" for d in range(depth))
    return out + [f"splits AS ({splits})",
                  f"stats AS (SELECT node, count(*) AS n, avg(y) AS mean, var_pop(y) AS var "
                  f"FROM ({every}) GROUP BY node)"]


TREE_X = ["num_connections", "perc_of_active_connections", "delivery_perc"]
TREE_NAME = "[" + ", ".join(f"'{c}'" for c in TREE_X) + "]"
SQL["ml_tree_depth2"] = with_ctes([ENERGY_AREA, *tree_ctes(TREE_X, 2)], f"""
SELECT CAST(node AS INTEGER) AS node, {TREE_NAME}[f] AS feature, round_even(v, 4) AS threshold,
  n, round_even(mean, 4) AS prediction, round_even(var, 1) AS impurity,
  round_even(coalesce(gain, 0), 1) AS gain
FROM stats LEFT JOIN splits USING (node)""")
SQL["ml_importance"] = with_ctes([ENERGY_AREA, *tree_ctes(TREE_X, 2)], f"""
, names AS (SELECT unnest({TREE_NAME}) AS feature), shares AS (
  SELECT feature, coalesce(sum(n * gain), 0) / (SELECT sum(n * gain)
    FROM stats JOIN splits USING (node)) AS importance
  FROM names LEFT JOIN (SELECT {TREE_NAME}[f] AS feature, n, gain
                        FROM stats JOIN splits USING (node)) USING (feature)
  GROUP BY feature)
SELECT feature, round_even(importance, 6) AS importance,
  CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INTEGER) AS rank FROM shares""")

# ------------------------------------------------------------------------------ grids
SELECT_X = {
    "total_connections": "num_connections", "log_connections": "ln(1 + num_connections)",
    "active_connections_percentage": "perc_of_active_connections",
    "smart_meter_adoption": "smartmeter_perc / 100.0::DOUBLE",
    "total_electrical_capacity": "CASE type_of_connection WHEN '1x35' THEN 35.0 WHEN '3x25' THEN "
                                 "75.0 WHEN '3x35' THEN 105.0 WHEN '3x50' THEN 150.0 WHEN '3x63' "
                                 "THEN 189.0 WHEN '3x80' THEN 240.0 ELSE 25.0 END::DOUBLE",
    "postal_digit": "CAST(substr(zipcode_from, 1, 1) AS DOUBLE)",
}
_N = len(SELECT_X)
SCALED = ["plain AS (SELECT " + KEYS + ", year, annual_consume / greatest(num_connections / ("
          + CIRCUITS.format(t="type_of_connection") + "), 0.1) AS y, "
          + ", ".join(f"{e} AS {c}" for c, e in SELECT_X.items()) + " FROM energy_area), "
          "whole AS (SELECT * FROM plain WHERE "
          + " AND ".join(f"{c} IS NOT NULL" for c in SELECT_X) + "), quartiles AS (SELECT "
          + ", ".join(f"quantile_cont({c}, 0.25) AS a_{c}, quantile_cont({c}, 0.5) AS m_{c}, "
                      f"quantile_cont({c}, 0.75) AS b_{c}" for c in SELECT_X)
          + " FROM whole), scaled AS (SELECT " + KEYS + ", year, y, "
          + ", ".join(f"({c} - m_{c}) / CASE WHEN b_{c} - a_{c} = 0 THEN 1.0 ELSE b_{c} - a_{c} "
                      f"END AS x{i}" for i, c in enumerate(SELECT_X, 1))
          + " FROM whole, quartiles)"]


def moments(source: str, by: str) -> str:
    """Covariances of the features (q) and with the target (c), and means, per ``by``."""
    q = "[" + ", ".join("[" + ", ".join(f"covar_pop(x{i}, x{j})" for j in range(1, _N + 1)) + "]"
                        for i in range(1, _N + 1)) + "]"
    c = "[" + ", ".join(f"covar_pop(x{i}, y)" for i in range(1, _N + 1)) + "]"
    m = "[" + ", ".join(f"avg(x{i})" for i in range(1, _N + 1)) + "]"
    return (f"SELECT {by}, count(*) AS n, {q} AS q, {c} AS c, {m} AS m, avg(y) AS my "
            f"FROM {source} GROUP BY {by}")


def descent(name: str, source: str, key: str, sweeps: int = 300) -> str:
    """Coordinate descent for the lasso: rows of ``source`` (key, alpha, q, c) get weights w."""
    at = f"(step % {_N} + 1)"
    rho = f"(c[{at}] - list_dot_product(q[{at}], w) + q[{at}][{at}] * w[{at}])"
    return f"""{name}_steps AS (
  SELECT {key}, alpha, q, c, 0 AS step, {[0.0] * _N}::DOUBLE[] AS w FROM {source}
  UNION ALL
  SELECT {key}, alpha, q, c, step + 1, list_transform(w, lambda v, i: CASE
    WHEN i = {at} AND q[{at}][{at}] = 0 THEN 0 WHEN i = {at}
    THEN sign({rho}) * greatest(abs({rho}) - alpha, 0) / q[{at}][{at}] ELSE v END)
  FROM {name}_steps WHERE step < {_N * sweeps}
), {name} AS (SELECT * FROM {name}_steps WHERE step = {_N * sweeps})"""


SQL["ml_selector"] = with_ctes([ENERGY_AREA, *SCALED, f"""
asked AS (SELECT * FROM (VALUES (0.01::DOUBLE), (60.0::DOUBLE)) v(alpha),
  ({moments("scaled", "1::INTEGER")}) t(one, n, q, c, m, my))""",
    descent("lasso", "asked", "one")], f"""
, flat AS (
  SELECT alpha, unnest({list(SELECT_X)}) AS feature, unnest(w) AS coefficient,
    unnest(list_transform(c, lambda v, i: v - list_dot_product(q[i], w))) AS gradient FROM lasso)
SELECT alpha, feature, round_even(coefficient, 3) + 0.0 AS coefficient,
  round_even(gradient, 3) + 0.0 AS gradient,
  round_even(alpha - abs(gradient), 3) + 0.0 AS slack,
  CAST(abs(coefficient) >= median(abs(coefficient)) OVER (PARTITION BY alpha) AS INTEGER) AS kept
FROM flat""").replace("WITH ", "WITH RECURSIVE ", 1)

_X = "[" + ", ".join(f"x{i}" for i in range(1, _N + 1)) + "]"
SQL["ml_grid_cv"] = with_ctes([ENERGY_AREA, *SCALED, f"""
placed AS (SELECT *, row_number() OVER (ORDER BY year, {KEYS}) AS rn, count(*) OVER () AS total
  FROM scaled)""", """
folded AS (SELECT *, CASE WHEN total // 4 = 0 THEN -1 WHEN rn > total - total // 4 THEN 2
  WHEN rn > total - 2 * (total // 4) THEN 1 WHEN rn > total - 3 * (total // 4) THEN 0
  ELSE -1 END AS fold FROM placed)""", f"""
trained AS ({moments("(SELECT t.fold AS test, f.* FROM folded f JOIN (VALUES (0), (1), (2)) "
                     "t(fold) ON f.fold < t.fold)", "test")})""", """
ridge_steps AS (
  SELECT model, alpha, test, n, m, my, 0 AS step,
    list_transform(q, lambda r, i: list_append(list_transform(r, lambda v, j:
      v + CASE WHEN i = j THEN alpha / n ELSE 0 END), c[i])) AS a
  FROM trained, (VALUES ('Linear Regression', 0.0::DOUBLE), ('Ridge Regression', 0.1::DOUBLE),
    ('Ridge Regression', 1.0::DOUBLE), ('Ridge Regression', 10.0::DOUBLE),
    ('Ridge Regression', 100.0::DOUBLE)) g(model, alpha)
  UNION ALL
  SELECT model, alpha, test, n, m, my, step + 1, list_transform(a, lambda r, i:
    CASE WHEN a[step + 1][step + 1] = 0 THEN r      -- a constant feature has no weight
    WHEN i = step + 1 THEN list_transform(r, lambda v: v / a[step + 1][step + 1])
    ELSE list_transform(r, lambda v, k: v - r[step + 1] * a[step + 1][k]
      / a[step + 1][step + 1]) END)
  FROM ridge_steps WHERE step < """ + str(_N) + """
)""", "asked AS (SELECT * FROM trained, (VALUES (0.01::DOUBLE), (0.1::DOUBLE), (1.0::DOUBLE), "
      "(10.0::DOUBLE)) g(alpha))", descent("lasso", "asked", "test, n, m, my")], f"""
, fits AS (
  SELECT model, alpha, test, n, m, my, list_transform(a, lambda r: r[{_N + 1}]) AS w
  FROM ridge_steps WHERE step = {_N}
  UNION ALL SELECT 'Lasso Regression', alpha, test, n, m, my, w FROM lasso),
scored AS (
  SELECT model, alpha, test AS fold, any_value(f.n) AS n_train, count(*) AS n_test,
    1 - sum((y - (my + list_dot_product(w, list_transform({_X}, lambda v, i: v - m[i])))) ** 2)
      / (count(*) * var_pop(y)) AS r2
  FROM fits f JOIN folded r ON r.fold = f.test GROUP BY model, alpha, test),
means AS (SELECT model, alpha, avg(r2) AS mean FROM scored GROUP BY model, alpha),
best AS (SELECT model, alpha FROM means
         QUALIFY row_number() OVER (PARTITION BY model ORDER BY mean DESC, alpha) = 1)
SELECT s.model, s.alpha, CAST(fold AS INTEGER) AS fold, n_train, n_test,
  round_even(r2, 6) AS r2, CAST(b.alpha IS NOT NULL AS INTEGER) AS chosen
FROM scored s LEFT JOIN best b ON b.model = s.model AND b.alpha = s.alpha""").replace(
    "WITH ", "WITH RECURSIVE ", 1)

# ------------------------------------------------------------------------------ package


def province(zipcode: str) -> str:
    return (f"CASE substr({zipcode}, 1, 1) WHEN '1' THEN 'west_holland' WHEN '2' THEN 'west_holland' "
            f"WHEN '3' THEN 'central' WHEN '4' THEN 'southwest' WHEN '5' THEN 'south' "
            f"WHEN '6' THEN 'east' WHEN '7' THEN 'northeast' WHEN '8' THEN 'north' "
            f"WHEN '9' THEN 'north' ELSE 'other' END")


SQL["score_package"] = with_ctes(
    REQ_INPUT + [ENERGY_AREA, two_features(*AREA_FIT), f"""vocabulary AS (
  SELECT value, dense_rank() OVER (ORDER BY value) - 1 AS code
  FROM (SELECT DISTINCT {province('zipcode_from')} AS value FROM energy_area)
  WHERE value <> 'other'
)"""], f"""
SELECT request_id, 'Linear Regression' AS model_used,
  round_even(b0 + b1 * coalesce(num_connections, 30.0)
    + b2 * coalesce(perc_of_active_connections, 88.0) + 5.0 * coalesce(code, 0), 4)
    AS prediction_kwh
FROM model_input CROSS JOIN fit LEFT JOIN vocabulary ON value = {province('zipcode_from')}""")
_ROUTE = "CASE WHEN x[s{0}.f] <= s{0}.v THEN 0 ELSE 1 END"
SQL["score_forest_package"] = with_ctes(REQ_INPUT + [ENERGY_AREA, *tree_ctes(
    ["num_connections", "perc_of_active_connections"], 2)], f"""
, asked AS (SELECT request_id, [coalesce(num_connections, 30.0),
    coalesce(perc_of_active_connections, 88.0)] AS x FROM model_input),
first AS (SELECT request_id, x, coalesce(2 + {_ROUTE.format(1)}, 1) AS node
          FROM asked LEFT JOIN splits s1 ON s1.node = 1),
second AS (SELECT request_id, coalesce(2 * first.node + {_ROUTE.format(2)}, first.node) AS node
           FROM first LEFT JOIN splits s2 ON s2.node = first.node AND first.node > 1)
SELECT request_id, 'Random Forest' AS model_used, round_even(mean, 4) AS prediction_kwh
FROM second JOIN stats USING (node)""")
SQL["ml_model_info"] = with_ctes([ENERGY_AREA, two_features(*AREA_FIT)], """
SELECT 'Linear Regression' AS model_name, 'annual_consume' AS target_column,
  false AS use_scaled, round_even(r2, 6) AS test_r2, CAST(3 AS INTEGER) AS feature_count,
  CAST(3 AS INTEGER) AS selected_feature_count, '1x25,1x35,3x25,3x35,3x50' AS house_types,
  'coteq,enexis,liander,stedin,westland-infra' AS companies,
  'cold,normal,warm' AS weather_scenarios FROM fit""")
SQL["st_corrections"] = SQL["wx_station_annual"].replace(
    "CAST(o_custkey % 250 AS DOUBLE) AS TG", "CAST(o_custkey % 250 AS DOUBLE) + CASE WHEN "
    "o_orderkey % 6 = 0 THEN 30.0 ELSE 0.0 END::DOUBLE AS TG")
