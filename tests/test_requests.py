"""Request cases (FIXTURES.md section 4) through validation, defaults and scoring."""

import pytest
from pyspark.sql import functions as F

from loadcast.functions import constants as K
from loadcast.functions.requests import REQUEST_SCHEMA
from loadcast.operators import scoring as SC


def _req(spark, rows):
    full = []
    for i, r in enumerate(rows):
        full.append((i, None, r.get("postal_code"), r.get("city"), r.get("house_type"),
                     r.get("num_connections"), r.get("active_connections_pct"),
                     r.get("smart_meter"), r.get("energy_company"), r.get("weather_scenario")))
    return spark.createDataFrame(full, REQUEST_SCHEMA)


# cases follow from the rules: every allowed value, each bound and one step beyond, absent fields
GOOD = ([{}] + [{"house_type": h} for h in K.HOUSE_TYPES]
        + [{"energy_company": c} for c in K.COMPANIES]
        + [{"energy_company": c.upper()} for c in K.COMPANIES]
        + [{"weather_scenario": s} for s in K.WEATHER_SCENARIOS]
        + [{"active_connections_pct": v} for v in (K.ACTIVE_PCT_MIN, K.ACTIVE_PCT_MAX)]
        + [{"num_connections": v} for v in (0, 1, 250)]
        + [{"postal_code": p} for p in ("45", "45 67", "456789")])
BAD = ([{"house_type": h} for h in ("", "2x40", K.HOUSE_TYPES[0].upper())]
       + [{"energy_company": c} for c in ("", "nobody")]
       + [{"weather_scenario": s} for s in ("", "stormy")]
       + [{"active_connections_pct": v} for v in (K.ACTIVE_PCT_MIN - 0.5, K.ACTIVE_PCT_MAX + 0.5)]
       + [{"postal_code": p} for p in ("", "4", "12a", "-1")])


def test_validation_cases(spark):
    cases = GOOD + BAD
    v = SC.validate(_req(spark, cases)).orderBy("request_id").collect()
    wrong = [(c, r["errors"]) for c, r, ok in
             zip(cases, v, [True] * len(GOOD) + [False] * len(BAD)) if r["is_valid"] != ok]
    assert not wrong
    assert all((len(r["errors"]) == 0) == r["is_valid"] for r in v)


def test_defaults_and_normalisation(spark):
    rows = [{}, {"postal_code": "987654321"}, {"energy_company": K.COMPANIES[0].upper()},
            {"num_connections": 0}, {"weather_scenario": "cold"}, {"house_type": "none"}]
    valid, bad = SC.split_valid(SC.validate(_req(spark, rows)))
    inp = {r["request_id"]: r for r in SC.to_model_input(valid).collect()}
    empty = inp[0]
    assert (empty["zipcode_from"], empty["city"], empty["num_connections"],
            empty["perc_of_active_connections"], empty["smartmeter_perc"]) == \
        ("3500", "Utrecht", 30.0, 88.0, 75.0)
    assert empty["annual_consume"] == 3500 * 14 and empty["avg_temp"] == 10.5
    assert inp[1]["zipcode_from"] == "9876"
    assert inp[2]["company"] == K.COMPANIES[0]
    assert inp[3]["num_connections"] == 30.0
    assert inp[4]["avg_temp"] == 8.0 and inp[4]["avg_min_temp"] == 4.0
    assert inp[4]["avg_precipitation"] == pytest.approx(900 / 365)
    assert [r["request_id"] for r in bad.collect()] == [5]


def test_rule_baseline_and_response(spark):
    valid, _ = SC.split_valid(SC.validate(_req(spark, [{"postal_code": "1012", "house_type": "3x25", "smart_meter": True,
                                                   "weather_scenario": "normal"}])))
    scored = SC.rule_baseline(SC.to_model_input(valid))
    r = SC.response(scored, "Rule Baseline").first()
    assert r["prediction_kwh"] == pytest.approx(2400 * 1.15 * 1.0 * 0.92)
    assert r["monthly_kwh"] == pytest.approx(r["prediction_kwh"] / 12)
    assert r["estimated_yearly_cost"] == pytest.approx(r["prediction_kwh"] * 0.25)
    assert r["comparison_to_average"]["typical_dutch_household_kwh"] == 2223
    pct = (r["prediction_kwh"] - 2223) / 2223 * 100
    assert r["comparison_to_average"]["comparison_text"] == (
        "Similar to typical Dutch household" if -10 <= pct < 10 else
        "Higher than typical Dutch household" if 10 <= pct < 20 else r["comparison_to_average"]["comparison_text"])


def test_comparison_text_bounds(spark):
    df = spark.createDataFrame([(p,) for p in (-20.0, -10.0, 10.0, 20.0, -20.1)], "pct double")
    got = [x[0] for x in df.select(SC.comparison_text(F.col("pct"))).collect()]
    assert got == ["Lower than typical Dutch household", "Similar to typical Dutch household",
                   "Higher than typical Dutch household", "Much higher than typical Dutch household",
                   "Much lower than typical Dutch household"]


def test_scenarios_fan_out_without_cross_join(spark):
    valid, _ = SC.split_valid(SC.validate(_req(spark, [{}])))
    ex = SC.expand_scenarios(SC.to_model_input(valid))
    assert sorted(r["scenario"] for r in ex.collect()) == ["cold", "normal", "warm"]
    assert "CartesianProduct" not in ex._jdf.queryExecution().executedPlan().toString()
