"""Golden feature rows and boundary cases (FIXTURES.md sections 2-3)."""

import math

import pytest
from pyspark.sql import functions as F

from loadcast.functions import features as FT

GOLDEN = [  # zip, type, connections, annual, active %, T, households, household kWh, capacity,
            # HDD, sun ratio, active count, efficiency, log1p
    ("1012", "3x25", 250, 580000, 92, 10.5, 17.8571, 32480.0, 75, 2737.5, 0.8778, 230.0, 2521.7391, 5.5255),
    ("3500", "3x35", 180, 420000, 88, 10.2, 10.0, 42000.0, 105, 2847.0, 0.9, 158.4, 2651.5152, 5.1985),
    ("2611", "1x25", 45, 95000, 76, 10.8, 4.5, 21111.1111, 25, 2628.0, 0.8556, 34.2, 2777.7778, 3.8286),
    ("4815", "3x50", 320, 750000, 94, 10.1, 14.5455, 51562.5, 150, 2883.5, 0.8278, 300.8, 2493.3511, 5.7714),
    ("6521", "3x25", 150, 340000, 85, 10.3, 10.7143, 31733.3333, 75, 2810.5, 0.8944, 127.5, 2666.6667, 5.0173),
]
SUN = 1580.0


def _frame(spark, rows):
    schema = ("zipcode_from string, type_of_connection string, num_connections double, "
              "annual_consume double, perc_of_active_connections double, avg_temp double, "
              "smartmeter_perc double, city string, company string, total_precipitation double, "
              "total_sunshine_hours double")
    return spark.createDataFrame(rows, schema)


def test_golden_rows(spark):
    rows = [(z, t, float(n), float(a), float(p), tt, 60.0, " amsterdam ", " Liander ", 850.0, SUN)
            for z, t, n, a, p, tt, *_ in GOLDEN]
    out = {r["zipcode_from"]: r for r in FT.with_features(_frame(spark, rows)).collect()}
    for z, t, n, a, p, tt, hh, hkwh, cap, hdd, sun, act, eff, lg in GOLDEN:
        r = out[z]
        assert r["estimated_households"] == pytest.approx(hh, abs=1e-4)
        assert r["household_consumption"] == pytest.approx(hkwh, abs=1e-4)
        assert r["total_electrical_capacity"] == cap
        assert r["heating_degree_days"] == pytest.approx(hdd, abs=1e-6)
        assert r["sunshine_ratio"] == pytest.approx(SUN / 1800, abs=1e-4)
        assert r["active_connection_count"] == pytest.approx(act, abs=1e-6)
        assert r["connection_efficiency"] == pytest.approx(eff, abs=1e-4)
        assert r["log_connections"] == pytest.approx(lg, abs=1e-4)
        assert r["city_clean"] == "AMSTERDAM" and r["company_clean"] == "liander"
        # all five lie outside the 500-8000 household range (removed by F3)
        assert not (500 <= r["household_consumption"] <= 8000)


def test_capacity_buckets(spark):
    df = spark.createDataFrame([(c,) for c in (25, 26, 50, 75, 100, 101)] + [(None,)],
                               "total_electrical_capacity int")
    got = [r[0] for r in df.select(FT.household_size_category()).collect()]
    assert got == ["small_apartment", "medium_apartment", "medium_apartment", "large_apartment",
                   "small_house", "large_house", "large_house"]


def test_density_and_activity_buckets(spark):
    df = spark.createDataFrame([(float(c),) for c in (50, 51, 200, 500, 1000, 1001)] + [(None,)],
                               "num_connections double")
    got = [r[0] for r in df.select(FT.connection_density_category()).collect()]
    assert got == ["very_low_density", "low_density", "low_density", "medium_density",
                   "high_density", "very_high_density", "very_high_density"]
    df = spark.createDataFrame([(float(c),) for c in (50, 75, 90, 90.1)] + [(None,)],
                               "perc_of_active_connections double")
    got = [r[0] for r in df.select(FT.activity_level_category()).collect()]
    assert got == ["low_activity", "medium_activity", "high_activity", "very_high_activity",
                   "very_high_activity"]


def test_flags_at_thresholds(spark):
    rows = [("1000", "3x25", 10.0, 1000.0, 80.0, t, sm, "c", "x", pr, sun)
            for t, sm, pr, sun in [(5.0, 75.0, 900.0, 1400.0), (15.0, 25.0, 900.0, 1400.0)]]
    for r in FT.with_features(_frame(spark, rows)).collect():
        assert r["high_tech_area"] == 0 and r["low_tech_area"] == 0
        assert r["extreme_cold_indicator"] == 0 and r["extreme_hot_indicator"] == 0
        assert r["high_precipitation"] == 0 and r["low_sunshine"] == 0


def test_households_edge_cases(spark):
    rows = [("1000", "3x25", 0.0), ("1000", "3x25", None), ("1000", None, 24.0),
            ("1000", "3X63", 44.0), ("1000", "3x80", 24.0)]
    df = spark.createDataFrame(rows, "zipcode_from string, type_of_connection string, "
                                     "num_connections double")
    got = [r[0] for r in df.select(FT.estimated_households()).collect()]
    assert got[0] == pytest.approx(0.1)
    assert got[1] is None
    assert got[2] == pytest.approx(2.0)     # null type -> 12 circuits
    assert got[3] == pytest.approx(2.0)     # 3X63 -> 22
    assert got[4] == pytest.approx(2.0)     # 3x80 -> 12


def test_province_defaults(spark):
    df = spark.createDataFrame([("0123",), ("A123",), (None,), ("9000",), ("3500",)],
                               "zipcode_from string")
    got = [r[0] for r in df.select(FT.postal_province()).collect()]
    assert got == ["other", "other", "other", "north", "central"]


def test_phases_parse_case_insensitive(spark):
    df = spark.createDataFrame([("3X25",), ("1X35",), ("UNKNOWN",), (None,)],
                               "connection_type_clean string")
    got = [(r[0], r[1]) for r in df.select(FT.connection_phases(), FT.connection_amperage()).collect()]
    assert got == [(3, 25), (1, 35), (1, 25), (1, 25)]
