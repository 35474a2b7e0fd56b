"""Registry of queries run against the benchmark tables (via the stand-in views).

Each entry takes ``(spark, sf_dir)`` and returns a lazy DataFrame. Final double aggregates are
rounded half-even (numpy-style, = DuckDB ``round_even`` on doubles) so that an independent engine with a different summation order
produces the same values; counts are ``bigint``, flags ``int``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.numeric import round_half_even
from .operators import annual, weather
from .sources import standins as S

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, QueryFn] = {}


def query(name: str):
    def deco(fn: QueryFn) -> QueryFn:
        REGISTRY[name] = fn
        return fn
    return deco


def _round(df: DataFrame, cols, digits: int) -> DataFrame:
    return df.withColumns({c: round_half_even(F.col(c), digits) for c in cols})


# ------------------------------------------------------------------------------ weather
def _daily(spark, sf_dir) -> DataFrame:
    return weather.with_date_parts(weather.to_units(S.weather_raw(spark, sf_dir)))


def _national(spark, sf_dir) -> DataFrame:
    """Nation-year weather: one row per year."""
    return weather.national_from_raw(S.weather_raw(spark, sf_dir))


@query("wx_range_scan")
def wx_range_scan(spark, sf_dir):
    return weather.range_scan(S.weather_raw(spark, sf_dir), ["240", "330", "391"], 1996, 1999,
                              ["TG", "RH", "Q"])


@query("wx_units")
def wx_units(spark, sf_dir):
    return weather.to_units(S.weather_raw(spark, sf_dir))


@query("wx_date_parts")
def wx_date_parts(spark, sf_dir):
    return weather.with_date_parts(S.weather_raw(spark, sf_dir)).select(
        "STN", "YYYYMMDD", F.col("date").cast("string").alias("date"), "year", "month", "day")


@query("wx_station_lookup")
def wx_station_lookup(spark, sf_dir):
    stations = S.weather_raw(spark, sf_dir).select(F.col("STN").alias("station")).distinct()
    return weather.with_station_info(stations, "station")


@query("wx_station_annual")
def wx_station_annual(spark, sf_dir):
    return weather.station_annual(_daily(spark, sf_dir))


@query("wx_national")
def wx_national(spark, sf_dir):
    return _national(spark, sf_dir)


# ------------------------------------------------------------------------------ annual
def _round_summary(df: DataFrame) -> DataFrame:
    """Totals of stand-in values are exact at 5 decimals (prices / 8), so rounding there
    removes only summation-order noise; means are rounded at 6."""
    return df.withColumns({c: round_half_even(F.col(c), 5 if c.startswith("total_") else 6)
                           for c in annual.SUMMARY_MEASURES})


@query("energy_annual_summary")
def energy_annual_summary(spark, sf_dir):
    s = annual.energy_year_summary(S.energy_area(spark, sf_dir), "electricity")
    return _round_summary(s)


@query("int_annual")
def int_annual(spark, sf_dir):
    df = annual.integrated_annual(S.energy_area(spark, sf_dir), _national(spark, sf_dir))
    return _round_summary(df)


@query("int_correlation")
def int_correlation(spark, sf_dir):
    integ = annual.integrated_annual(S.energy_area(spark, sf_dir), _national(spark, sf_dir))
    c = annual.weather_energy_correlation(integ)
    return c.select("energy_type", *[n for n, _, _ in annual.correlation_columns()],
                    F.array_join(F.col("data_years").cast("array<string>"), ",").alias("data_years"),
                    "sample_size")


# ------------------------------------------------------------------------------ features
KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _area_weather(spark, sf_dir) -> DataFrame:
    """Area rows x national weather on year (many-to-one; a row per year is broadcast)."""
    from .operators.joins import join_by_year
    nat = _national(spark, sf_dir).select("year", *weather.MEASURES)
    return join_by_year(S.energy_area(spark, sf_dir), nat)


def _featured(spark, sf_dir) -> DataFrame:
    from .functions.features import with_features
    return with_features(_area_weather(spark, sf_dir))


def _area_featured(spark, sf_dir) -> DataFrame:
    """The features that need no weather: no weather is read or joined."""
    from .functions.features import with_features
    return with_features(S.energy_area(spark, sf_dir), weather=False)


@query("feat_weather_join")
def feat_weather_join(spark, sf_dir):
    return _area_weather(spark, sf_dir).select(*KEYS, "year", *weather.MEASURES)


@query("feat_cons_per_connection")
def feat_cons_per_connection(spark, sf_dir):
    from .functions.features import consumption_per_connection
    return S.energy_area(spark, sf_dir).select(
        *KEYS, consumption_per_connection().alias("consumption_per_connection"))


@query("feat_households")
def feat_households(spark, sf_dir):
    return _area_featured(spark, sf_dir).select(*KEYS, "circuits_per_household",
                                           "estimated_households", "household_consumption")


@query("feat_postal")
def feat_postal(spark, sf_dir):
    return _area_featured(spark, sf_dir).select(*KEYS, "postal_code_area", "postal_first_digit",
                                           "postal_province")


@query("feat_clean_strings")
def feat_clean_strings(spark, sf_dir):
    return _area_featured(spark, sf_dir).select(*KEYS, "city_clean", "company_clean",
                                           "connection_type_clean")


@query("feat_capacity")
def feat_capacity(spark, sf_dir):
    return _area_featured(spark, sf_dir).select(*KEYS, "connection_phases", "connection_amperage",
                                           "total_electrical_capacity", "household_size_category")


@query("feat_voltage")
def feat_voltage(spark, sf_dir):
    """Voltage marks are searched in type + postal code (the stand-in types carry none)."""
    from .functions import constants as K
    from .functions.features import clean_upper, voltage_flag
    t = clean_upper(F.concat_ws(" ", "type_of_connection", "zipcode_from"))
    return S.energy_area(spark, sf_dir).select(
        *KEYS, voltage_flag(t, K.HIGH_VOLTAGE_MARKS).alias("has_high_voltage"),
        voltage_flag(t, K.MEDIUM_VOLTAGE_MARKS).alias("has_medium_voltage"))


@query("feat_smart_meter")
def feat_smart_meter(spark, sf_dir):
    return _area_featured(spark, sf_dir).select(*KEYS, "smart_meter_adoption", "high_tech_area",
                                           "low_tech_area")


@query("feat_weather")
def feat_weather(spark, sf_dir):
    """Weather features on single daily rows, where every flag takes both values."""
    from .functions.features import weather_features
    d = weather.to_units(S.weather_raw(spark, sf_dir))
    cols = weather_features(F.col("TG"), F.lit(200.0) * F.col("RH"), F.col("Q"))
    return d.select("obs_id", *[v.alias(k) for k, v in cols.items()])


@query("feat_connections")
def feat_connections(spark, sf_dir):
    df = _area_featured(spark, sf_dir)
    return df.select(*KEYS, "total_connections",
                     round_half_even(F.col("log_connections"), 9).alias("log_connections"),
                     "connections_per_household", "active_connections_percentage",
                     "inactive_connections_percentage", "active_connection_count",
                     "inactive_connection_count", "total_active_connections",
                     "connection_efficiency")


@query("feat_density")
def feat_density(spark, sf_dir):
    """Density buckets on 25x the stand-in connection count (which alone never exceeds 50)."""
    from .functions.features import activity_level_category, connection_density_category
    return S.energy_area(spark, sf_dir).select(
        *KEYS, connection_density_category(F.col("num_connections") * F.lit(25.0))
        .alias("connection_density_category"),
        activity_level_category().alias("activity_level_category"))


@query("feat_matrix")
def feat_matrix(spark, sf_dir):
    from .functions import constants as K
    df = _featured(spark, sf_dir).withColumn(
        "log_connections", round_half_even(F.col("log_connections"), 9))
    return df.select(*KEYS, *K.FEATURE_COLUMNS, K.TARGET_COLUMN)


# ------------------------------------------------------------------------------ quality
def _complete(spark, sf_dir) -> DataFrame:
    from .operators.quality import drop_incomplete, with_preliminary_household
    return with_preliminary_household(drop_incomplete(_area_weather(spark, sf_dir)))


@query("dq_dropna")
def dq_dropna(spark, sf_dir):
    from .operators.quality import drop_incomplete
    return drop_incomplete(_area_weather(spark, sf_dir)).select(*KEYS)


@query("dq_range")
def dq_range(spark, sf_dir):
    from .operators.quality import active_filter, household_range_filter
    df = household_range_filter(active_filter(_complete(spark, sf_dir)))
    return df.select(*KEYS, "preliminary_household_consumption")


@query("dq_quartiles")
def dq_quartiles(spark, sf_dir):
    from .operators.quality import iqr_bounds
    b = iqr_bounds(_complete(spark, sf_dir).where(F.col("type_of_connection").isNotNull()),
                   "type_of_connection", "preliminary_household_consumption")
    return _round(b, ["q1", "q3", "lower_bound", "upper_bound"], 6)


@query("dq_sketch_quantiles")
def dq_sketch_quantiles(spark, sf_dir):
    """A6/A7 from stored sketches, one a year: the exact quartiles of all years, and whether the
    merged sketches' quartiles have a rank within their stated error."""
    from .operators import sketches as SK
    from .operators.ml_prep import column_quantiles
    columns, probs = ["annual_consume", "num_connections", "smartmeter_perc"], [0.25, 0.5, 0.75]
    area = S.energy_area(spark, sf_dir)
    path = _scratch(spark, "dq_sketch_quantiles")
    for part in (F.col("year") < 1998, F.col("year") >= 1998):
        SK.store_sketches(SK.sketch_columns(area.where(part), columns), path)
    merged = SK.merged_quantiles(SK.load_sketches(spark, path), probs).collect()  # a row a column
    ranks = SK.ranks(area, {(r["column"], p): r[f"q_{p}"] for r in merged for p in probs})
    error = SK.rank_error()
    held = spark.createDataFrame(
        [(c, p, int(low - error <= p <= high + error)) for (c, p), (low, high) in ranks.items()],
        "column string, prob double, within_error int")
    exact = column_quantiles(area, columns, probs)
    long = exact.select("column", "n", F.explode(F.array(*[
        F.struct(F.lit(p).alias("prob"), F.col(f"`q_{p}`").alias("quantile"))
        for p in probs])).alias("_q")).select("column", "n", "_q.*")
    return _round(long.join(held, ["column", "prob"]), ["quantile"], 4)


@query("dq_iqr_filter")
def dq_iqr_filter(spark, sf_dir):
    from .operators.quality import iqr_filter
    return iqr_filter(_complete(spark, sf_dir), "type_of_connection",
                      "preliminary_household_consumption").select(*KEYS)


@query("dq_funnel")
def dq_funnel(spark, sf_dir):
    from .operators.quality import funnel
    return funnel(S.energy_area(spark, sf_dir), _national(spark, sf_dir))


# ------------------------------------------------------------------------------ reports
@query("rep_target_stats")
def rep_target_stats(spark, sf_dir):
    from .operators.reports import target_stats
    return _round(target_stats(_featured(spark, sf_dir)), ["mean"], 4)


@query("rep_by_type")
def rep_by_type(spark, sf_dir):
    from .operators.reports import mean_by_group
    return _round(mean_by_group(_featured(spark, sf_dir), "type_of_connection"),
                  ["mean_household_consumption"], 4)


@query("rep_histogram")
def rep_histogram(spark, sf_dir):
    from .operators.reports import histogram
    return _round(histogram(_featured(spark, sf_dir), "household_consumption", 8),
                  ["bin_lo", "bin_hi"], 4)


REPORT_MEANS = ["household_consumption", "estimated_households", "connection_efficiency",
                "active_connection_count", "smart_meter_adoption", "total_electrical_capacity",
                "sunshine_ratio", "inactive_connections_percentage"]


@query("rep_feature_means")
def rep_feature_means(spark, sf_dir):
    from .operators.reports import feature_means
    return _round(feature_means(_featured(spark, sf_dir), REPORT_MEANS),
                  [f"mean_{c}" for c in REPORT_MEANS], 4)


# ------------------------------------------------------------------------------ ML prep
NUMERIC_IMPUTE = ["num_connections", "smartmeter_perc", "household_consumption",
                  "connection_efficiency"]
SCALE_COLS = ["annual_consume", "num_connections", "perc_of_active_connections",
              "smartmeter_perc"]


def _train_flag():
    from .operators.ml_prep import split_flag
    return split_flag(KEYS)


@query("ml_label_encode_fit")
def ml_label_encode_fit(spark, sf_dir):
    from .functions import constants as K
    from .operators.ml_prep import fit_label_vocabularies
    return fit_label_vocabularies(_featured(spark, sf_dir), K.CATEGORICAL_COLUMNS)


@query("ml_label_encode_apply")
def ml_label_encode_apply(spark, sf_dir):
    """Vocabulary fitted on the training part only; test rows with unseen values get 0."""
    from .functions import constants as K
    from .operators.ml_prep import apply_label_codes, fit_label_vocabularies
    df = _featured(spark, sf_dir)
    vocab = fit_label_vocabularies(df.where(_train_flag()), K.CATEGORICAL_COLUMNS)
    return apply_label_codes(df, vocab, K.CATEGORICAL_COLUMNS).select(
        *KEYS, *K.CATEGORICAL_COLUMNS)


@query("ml_median_impute")
def ml_median_impute(spark, sf_dir):
    from .operators.ml_prep import fit_medians, impute
    df = _featured(spark, sf_dir)
    med = fit_medians(df.where(_train_flag()), NUMERIC_IMPUTE)
    return _round(impute(df, med).select(*KEYS, *NUMERIC_IMPUTE), NUMERIC_IMPUTE, 6)


@query("ml_split")
def ml_split(spark, sf_dir):
    return S.energy_area(spark, sf_dir).select(*KEYS, _train_flag().alias("is_train"))


@query("ml_sample_n")
def ml_sample_n(spark, sf_dir):
    from .operators.ml_prep import sample_n
    return sample_n(S.energy_area(spark, sf_dir).select(*KEYS), 1000, KEYS)


@query("ml_ts_folds")
def ml_ts_folds(spark, sf_dir):
    from .operators.ml_prep import expanding_folds
    return expanding_folds(S.energy_area(spark, sf_dir).select("year", *KEYS),
                           ["year", *KEYS])


@query("ml_robust_scale")
def ml_robust_scale(spark, sf_dir):
    from .operators.ml_prep import fit_robust_scaler, robust_scale
    df = S.energy_area(spark, sf_dir)
    params = fit_robust_scaler(df.where(_train_flag()), SCALE_COLS)
    return _round(robust_scale(df, params).select(*KEYS, *SCALE_COLS), SCALE_COLS, 6)


@query("ml_ols_simple")
def ml_ols_simple(spark, sf_dir):
    from .operators.ml_prep import simple_ols
    return _round(simple_ols(S.energy_area(spark, sf_dir), "num_connections", "annual_consume"),
                  ["slope", "intercept", "r2"], 6)


@query("ml_metrics")
def ml_metrics(spark, sf_dir):
    from .operators.ml_prep import regression_metrics
    m = regression_metrics(S.model_score(spark, sf_dir), group_cols=["model"])
    return _round(m, ["r2", "rmse", "mae", "relative_error_pct"], 6)


@query("ml_cv_summary")
def ml_cv_summary(spark, sf_dir):
    from .operators.ml_prep import cv_summary, regression_metrics
    per_fold = regression_metrics(S.model_score(spark, sf_dir), group_cols=["model", "fold"])
    return _round(cv_summary(per_fold), ["cv_r2_mean", "cv_r2_std"], 6)


@query("ml_best_model")
def ml_best_model(spark, sf_dir):
    from .operators.ml_prep import best_model, regression_metrics
    m = regression_metrics(S.model_score(spark, sf_dir), group_cols=["model"])
    return _round(best_model(m), ["best_r2"], 6)


@query("ml_error_report")
def ml_error_report(spark, sf_dir):
    """P31 on the best model by R2: ten sampled rows (the report's length)."""
    from .operators.ml_prep import best_model, error_report, regression_metrics, sample_n
    scores = S.model_score(spark, sf_dir)
    best = best_model(regression_metrics(scores, group_cols=["model"])).select("best_model")
    of_best = scores.join(F.broadcast(best), F.col("model") == F.col("best_model"))   # one row
    return error_report(sample_n(of_best, 10, KEYS)).select(*KEYS, "actual", "predicted", "error",
                                                        "error_pct")


@query("ml_importance")
def ml_importance(spark, sf_dir):
    """Importances read from the node table of a fitted tree of depth two, sorted."""
    from .operators.forest import importances
    from .operators.ml_prep import top_k_importance
    nodes, _ = _tree(spark, sf_dir, TREE_X, 2)
    shares = importances(nodes).select(_named("feature").alias("feature"), "importance")
    wide = shares.agg(*[F.coalesce(F.max(F.when(F.col("feature") == c, F.col("importance"))),
                                   F.lit(0.0)).alias(c) for c in TREE_X])
    return _round(top_k_importance(wide, TREE_X, 10), ["importance"], 6)


# ------------------------------------------------------------------------------ requests
def _validated(spark, sf_dir) -> DataFrame:
    from .operators.scoring import validate
    return validate(S.score_request(spark, sf_dir))


def _model_input(spark, sf_dir) -> DataFrame:
    from .operators.scoring import split_valid, to_model_input
    valid, _ = split_valid(_validated(spark, sf_dir))
    return to_model_input(valid)


INPUT_COLS = ["zipcode_from", "city", "company", "type_of_connection",
              "circuits_per_household_input", "num_connections", "perc_of_active_connections",
              "delivery_perc", "smartmeter_perc", "annual_consume", "scenario"]
SCENARIO_COLS = ["avg_temp", "total_precipitation", "total_sunshine_hours", "avg_wind_speed",
                 "avg_min_temp", "avg_max_temp", "avg_precipitation", "total_global_radiation"]


@query("req_parse_json")
def req_parse_json(spark, sf_dir):
    """Requests serialised to JSON documents and parsed back with the request schema."""
    from .functions.requests import REQUEST_SCHEMA
    req = S.score_request(spark, sf_dir)
    fmt = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
           "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    docs = req.select(F.to_json(F.struct(*req.columns), fmt).alias("json"))
    parsed = docs.select(F.from_json("json", REQUEST_SCHEMA, fmt).alias("r")).select("r.*")
    return parsed.withColumn("ts", F.col("ts").cast("string"))


@query("req_validate")
def req_validate(spark, sf_dir):
    return _validated(spark, sf_dir).select("request_id", "is_valid",
                                            F.array_join("errors", "; ").alias("errors"))


@query("req_quarantine")
def req_quarantine(spark, sf_dir):
    from .operators.scoring import split_valid
    _, bad = split_valid(_validated(spark, sf_dir))
    return bad.select("request_id", "postal_code", "house_type", "active_connections_pct",
                      "energy_company", "weather_scenario",
                      F.array_join("errors", "; ").alias("errors"))


@query("req_postal_norm")
def req_postal_norm(spark, sf_dir):
    from .functions.requests import normalized_postal
    from .operators.scoring import split_valid
    valid, _ = split_valid(_validated(spark, sf_dir))
    return valid.where(F.col("postal_code").isNotNull()).select(
        "request_id", "postal_code", normalized_postal().alias("postal_normalized"))


@query("req_defaults")
def req_defaults(spark, sf_dir):
    return _model_input(spark, sf_dir).select("request_id", *INPUT_COLS)


@query("req_scenario_join")
def req_scenario_join(spark, sf_dir):
    return _model_input(spark, sf_dir).select("request_id", "scenario", *SCENARIO_COLS)


@query("req_from_args")
def req_from_args(spark, sf_dir):
    from .functions.requests import args_input_columns
    from .operators.scoring import with_scenario_weather
    req = S.score_request(spark, sf_dir).select(
        "request_id", "house_type", "weather_scenario", "smart_meter",
        F.coalesce(F.substring("postal_code", 1, 2), F.lit("35")).alias("postal_area"))
    df = with_scenario_weather(req.withColumns(
        args_input_columns(house="house_type", area="postal_area", weather="weather_scenario")))
    return df.select("request_id", "zipcode_from", "city", "company", "num_connections_input",
                     "perc_of_active_connections", "delivery_perc", "smartmeter_perc",
                     "annual_consume", "type_of_connection", "scenario", *SCENARIO_COLS)


# ------------------------------------------------------------------------------ scoring
def _scored(spark, sf_dir) -> DataFrame:
    from .operators.scoring import rule_baseline
    return rule_baseline(_model_input(spark, sf_dir))


@query("score_features")
def score_features(spark, sf_dir):
    """The training feature functions applied to request rows."""
    from .functions.features import with_features
    f = with_features(_model_input(spark, sf_dir))
    return f.select("request_id", "estimated_households", "household_consumption",
                    "postal_code_area", "postal_province", "connection_phases",
                    "connection_amperage", "total_electrical_capacity", "household_size_category",
                    "high_tech_area", "low_tech_area", "heating_degree_days", "low_sunshine",
                    "active_connection_count", "connection_efficiency",
                    "connection_density_category", "activity_level_category")


@query("score_fill")
def score_fill(spark, sf_dir):
    from .functions import constants as K
    from .operators.scoring_model import fill_missing_features
    df = _featured(spark, sf_dir).withColumn(
        "log_connections", round_half_even(F.col("log_connections"), 9))
    return fill_missing_features(df, K.FEATURE_COLUMNS).select(*KEYS, *K.FEATURE_COLUMNS)


@query("score_rule_baseline")
def score_rule_baseline(spark, sf_dir):
    return _scored(spark, sf_dir).select("request_id", "prediction_kwh")


@query("score_derive")
def score_derive(spark, sf_dir):
    from .operators.scoring import derived_outputs
    d = derived_outputs()
    return _scored(spark, sf_dir).select("request_id", "prediction_kwh",
                                         *[v.alias(k) for k, v in d.items()])


@query("score_compare")
def score_compare(spark, sf_dir):
    from .operators.scoring import comparison
    c = comparison()
    return _scored(spark, sf_dir).select("request_id", *[v.alias(k) for k, v in c.items()])


@query("score_insights")
def score_insights(spark, sf_dir):
    from .operators.scoring import comparison, insights
    df = _scored(spark, sf_dir).withColumn("percentage_difference",
                                           comparison()["percentage_difference"])
    return df.select("request_id", F.array_join(insights(), " | ").alias("insights"))


@query("score_scenarios")
def score_scenarios(spark, sf_dir):
    from .operators.scoring import expand_scenarios, rule_baseline
    df = rule_baseline(expand_scenarios(_model_input(spark, sf_dir)))
    return df.select("request_id", "scenario", "avg_temp", "prediction_kwh")


@query("score_sanity")
def score_sanity(spark, sf_dir):
    from .operators.scoring import sane
    return _scored(spark, sf_dir).select("request_id", "prediction_kwh",
                                         sane().alias("is_sane"))


def _responses(spark, sf_dir) -> DataFrame:
    from .operators.scoring import response
    return response(_scored(spark, sf_dir), "Rule Baseline")


SUMMARY_COLS = ["zipcode_from", "city", "company", "type_of_connection",
                "circuits_per_household_input", "num_connections", "perc_of_active_connections",
                "delivery_perc", "smartmeter_perc", "annual_consume", "scenario", *SCENARIO_COLS]


def _flat_response(r: DataFrame) -> DataFrame:
    """Response rows with every nested field as a column."""
    return r.select("request_id", "prediction_kwh", "monthly_kwh", "daily_kwh",
                    "estimated_monthly_cost", "estimated_yearly_cost", "model_used",
                    *[f"input_summary.{c}" for c in SUMMARY_COLS],
                    "comparison_to_average.typical_dutch_household_kwh",
                    "comparison_to_average.difference_kwh",
                    "comparison_to_average.percentage_difference",
                    "comparison_to_average.comparison_text",
                    F.col("timestamp").cast("string").alias("timestamp"))


@query("score_response")
def score_response(spark, sf_dir):
    return _flat_response(_responses(spark, sf_dir))


@query("req_density")
def req_density(spark, sf_dir):
    """Connections from a density word, and activity shares outside the range replaced."""
    from .functions.requests import activity_or_default, density_connections
    words = F.array(F.lit("urban"), F.lit("Rural"), F.lit("suburban"), F.lit(None).cast("string"))
    e = S.read_table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"), F.col("value").alias("pct"),
        F.element_at(words, (F.col("user_id") % 4 + 1).cast("int")).alias("word"))
    return e.select("request_id", density_connections(F.col("word")).cast("int")
                    .alias("num_connections"),
                    activity_or_default(F.col("pct")).cast("double").alias("active_pct"))


@query("score_latest5")
def score_latest5(spark, sf_dir):
    from .operators.scoring import latest
    return latest(_responses(spark, sf_dir), 5).select(
        "request_id", F.col("timestamp").cast("string").alias("timestamp"), "prediction_kwh")


# ------------------------------------------------------------------------------ sources
def _files(spark, sf_dir) -> DataFrame:
    from .sources.energy import files_of
    return files_of(S.energy_area(spark, sf_dir))


@query("src_parse_filename")
def src_parse_filename(spark, sf_dir):
    from .sources.energy import with_file_fields
    return with_file_fields(_files(spark, sf_dir)).select("source_file", "energy_type",
                                                          "company", "year")


@query("src_companies")
def src_companies(spark, sf_dir):
    from .sources.energy import companies
    return companies(_files(spark, sf_dir)).orderBy("company")


@query("src_years")
def src_years(spark, sf_dir):
    from .sources.energy import years
    return years(_files(spark, sf_dir)).orderBy("year")


@query("src_by_year")
def src_by_year(spark, sf_dir):
    from .sources.energy import by_year, with_file_fields
    df = with_file_fields(S.energy_area(spark, sf_dir).drop("company", "year"))
    return by_year(df, 1997).select(*KEYS, "source_file", "company", "year")


@query("src_by_company")
def src_by_company(spark, sf_dir):
    from .sources.energy import by_company
    df = S.energy_area(spark, sf_dir)
    return by_company(df, "NATION-1").select(*KEYS, "source_file", "company", "energy_type")


@query("src_summary")
def src_summary(spark, sf_dir):
    from .sources.energy import summary
    s = summary(_files(spark, sf_dir))
    return s.select("electricity_files", "gas_files",
                    F.array_join("companies", ",").alias("companies"),
                    F.array_join(F.col("years_electricity").cast("array<string>"), ",")
                    .alias("years_electricity"),
                    F.array_join(F.col("years_gas").cast("array<string>"), ",").alias("years_gas"),
                    "total_files", "min_year", "max_year")


@query("set_union_by_name")
def set_union_by_name(spark, sf_dir):
    """Early and late years with different columns, unioned by name."""
    area = S.energy_area(spark, sf_dir)
    a = area.where(F.col("year") <= 1997).select(*KEYS, "annual_consume", "city")
    b = area.where(F.col("year") > 1997).select("company", "city", *KEYS, "num_connections")
    return a.unionByName(b, allowMissingColumns=True)


@query("set_union_distinct")
def set_union_distinct(spark, sf_dir):
    """Companies that have electricity or gas rows (odd and even line numbers)."""
    area = S.energy_area(spark, sf_dir)
    electricity = area.where(F.col("l_linenumber") % 2 == 1).select("company")
    gas = area.where(F.col("l_linenumber") % 2 == 0).select("company")
    return electricity.union(gas).distinct()


@query("src_preview")
def src_preview(spark, sf_dir):
    """The first ten rows by key."""
    return S.energy_area(spark, sf_dir).select(*KEYS, "city", "company", "year").orderBy(
        *KEYS).limit(10)


# ------------------------------------------------------------------------------ files
FILE_COLS = ["annual_consume", "num_connections", "type_of_connection",
             "perc_of_active_connections", "smartmeter_perc", "delivery_perc", "zipcode_from",
             "city", "source_file", "company", "energy_type", "year"]


def _scratch(spark, name: str) -> str:
    import uuid
    from .session import scratch_path
    return scratch_path(spark, f"{name}/{uuid.uuid4().hex}")


def _file_rows(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(k).cast("int" if k == "l_linenumber" else "bigint").alias(k)
                       for k in KEYS], *FILE_COLS)


@query("src_read_energy")
def src_read_energy(spark, sf_dir):
    """CSV files of both energy types, with different headers, read and unioned."""
    from .sources.energy import read_energy
    folders = S.energy_csv_files(spark, sf_dir, _scratch(spark, "src_read_energy"))
    electricity = read_energy(spark, folders["electricity"], "electricity")
    gas = read_energy(spark, folders["gas"], "gas")
    return _file_rows(electricity.unionByName(gas, allowMissingColumns=True))


@query("src_load_company")
def src_load_company(spark, sf_dir):
    """The files of the companies whose names start with the argument."""
    from .sources.energy import load_company
    folders = S.energy_csv_files(spark, sf_dir, _scratch(spark, "src_load_company"))
    return _file_rows(load_company(spark, folders["electricity"], "NATION-1", "electricity"))


@query("src_load_year")
def src_load_year(spark, sf_dir):
    """The gas files of one year."""
    from .sources.energy import load_year
    folders = S.energy_csv_files(spark, sf_dir, _scratch(spark, "src_load_year"))
    gas = load_year(spark, folders["gas"], 1997, "gas")
    return _file_rows(gas.withColumn("smartmeter_perc", F.lit(None).cast("double")))


DAILY_COLS = ["STN", "YYYYMMDD", "TG", "TN", "TX", "RH", "DR", "FG", "Q", "year", "month", "day"]


@query("wx_station_text")
def wx_station_text(spark, sf_dir):
    """Station text written from the daily rows and read back."""
    from .sources.weather import read_station_text
    path = _scratch(spark, "wx_station_text")
    S.station_text_files(spark, sf_dir, path)
    return read_station_text(spark, path).select(*DAILY_COLS)


@query("wx_cache_scan")
def wx_cache_scan(spark, sf_dir):
    """The daily weather cached by station and year; a scan of two stations and three years
    prunes the other folders."""
    from .sources.weather import read_cache, write_cache
    path = _scratch(spark, "wx_cache_scan")
    write_cache(_daily(spark, sf_dir), path)
    return read_cache(spark, path, ["240", "330"], 1996, 1998).select(*DAILY_COLS)


@query("wx_cache_gaps")
def wx_cache_gaps(spark, sf_dir):
    """A cache filled in two steps, the second with another station and fewer variables;
    the days that a later request still has to fetch, by station and variable."""
    from .sources.weather import missing_days, write_cache
    path = _scratch(spark, "wx_cache_gaps")
    daily = _daily(spark, sf_dir)
    write_cache(daily.where("STN in ('240', '330') and YYYYMMDD < '19980301'"), path)
    write_cache(daily.where("STN in ('260', '330') and YYYYMMDD >= '19970501'"), path,
                ["TG", "RH"])
    gaps = missing_days(spark, path, ["240", "260", "330", "391"], "1996-06-01", "1998-06-30",
                        ["TG", "Q"])
    return gaps.select("STN", "variable", F.col("first").cast("string").alias("first"),
                       F.col("last").cast("string").alias("last"))


# ------------------------------------------------------------------------------ streaming
def _stream_of(spark, sf_dir, table):
    path = f"{sf_dir.rstrip('/')}/{table}.parquet"
    return (spark.readStream.schema(spark.read.parquet(path).schema)
            .option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir))


@query("st_station_annual")
def st_station_annual(spark, sf_dir):
    """ST2: the daily rows arrive as a stream; running station-year aggregates are upserted
    into a table, which must equal the batch station-year aggregate."""
    import uuid
    from .session import scratch_path
    from .streaming.jobs import read_station_year_table, station_year_stream
    run = uuid.uuid4().hex
    table = scratch_path(spark, f"st_station_annual/{run}/table")
    q = station_year_stream(S.weather_raw_from(_stream_of(spark, sf_dir, "orders")), table,
                            scratch_path(spark, f"st_station_annual/{run}/checkpoint"))
    q.awaitTermination()
    return read_station_year_table(spark, table).select("year", *weather.MEASURES, "station",
                                            "station_name", "station_location")


@query("st_corrections")
def st_corrections(spark, sf_dir):
    """ST2 with a second delivery: readings that come again unchanged count once, corrected ones
    take the place of the first. The stream is stopped and resumed in between."""
    from .streaming.jobs import read_station_year_table, station_year_stream
    path = _scratch(spark, "st_corrections")
    first = S.weather_raw(spark, sf_dir)
    again = first.where("obs_id % 3 = 0").withColumn(
        "TG", F.when(F.col("obs_id") % 2 == 0, F.col("TG") + F.lit(30.0))
        .otherwise(F.col("TG")))
    for delivery in (first, again):
        delivery.write.mode("append").parquet(f"{path}/in")
        station_year_stream(spark.readStream.schema(first.schema).parquet(f"{path}/in"),
                            f"{path}/table", f"{path}/checkpoint").awaitTermination()
    return read_station_year_table(spark, f"{path}/table").select(
        "year", *weather.MEASURES, "station", "station_name", "station_location")


def _score_stream(spark, sf_dir) -> tuple[str, str]:
    """ST1: requests arrive as a stream and are validated, defaulted and scored per
    micro-batch into a scored table and a quarantine table."""
    from .streaming.jobs import score_request_stream
    run = _scratch(spark, "st_score")
    out, bad = f"{run}/scored", f"{run}/quarantine"
    q = score_request_stream(S.score_request_from(_stream_of(spark, sf_dir, "events")), out, bad,
                             f"{run}/checkpoint")
    q.awaitTermination()
    return out, bad


@query("st_score_requests")
def st_score_requests(spark, sf_dir):
    """The scored table of ST1."""
    out, _ = _score_stream(spark, sf_dir)
    return _flat_response(spark.read.parquet(out))


@query("st_quarantine")
def st_quarantine(spark, sf_dir):
    """The quarantine table of ST1."""
    _, bad = _score_stream(spark, sf_dir)
    return spark.read.parquet(bad).select("request_id", "errors")


# ------------------------------------------------------------------------------ variants
@query("feat_exact_circuits")
def feat_exact_circuits(spark, sf_dir):
    """Exact-match circuits map without floors (unmatched types and zero divisors ->
    NULL)."""
    from .functions.features import exact_circuit_columns
    cols = exact_circuit_columns()
    cols["circuits_per_household_exact"] = cols["circuits_per_household_exact"].cast("double")
    return S.energy_area(spark, sf_dir).select(*KEYS, *[v.alias(k) for k, v in cols.items()])


@query("req_display_names")
def req_display_names(spark, sf_dir):
    """Title-cased city and company for display."""
    from .functions.features import display_name
    return S.score_request(spark, sf_dir).select(
        "request_id", display_name("city").alias("city_display"),
        display_name("energy_company").alias("company_display"))


# ------------------------------------------------------------------------------ linear models
LINEAR_X = ["num_connections", "perc_of_active_connections"]


def _area_sums(spark, sf_dir, columns):
    """Sums of products of the columns and annual_consume over rows that have them all."""
    from .operators.gram import block_grams
    rows = S.energy_area(spark, sf_dir).select(*columns, "annual_consume").dropna()
    return block_grams(rows.withColumns({"x": F.array(*columns), "b": F.lit(0)}), "x",
                       "annual_consume", "b")[0]


def _coefficients(spark, model, columns) -> DataFrame:
    row = [model.intercept, *model.coefficients]
    names = ["intercept", *[f"coef_{c}" for c in columns]]
    df = spark.createDataFrame([tuple(row)], ", ".join(f"{n} double" for n in names))
    return _round(df, names, 4)


@query("ml_ols")
def ml_ols(spark, sf_dir):
    """M6: least squares on two features."""
    from .operators.gram import ridge
    return _coefficients(spark, ridge(_area_sums(spark, sf_dir, LINEAR_X)), LINEAR_X)


@query("ml_ridge")
def ml_ridge(spark, sf_dir):
    """M7: ridge with the largest alpha of the grid."""
    from .operators.gram import ridge
    return _coefficients(spark, ridge(_area_sums(spark, sf_dir, LINEAR_X), 100.0), LINEAR_X)


@query("ml_lasso")
def ml_lasso(spark, sf_dir):
    """M8: lasso on one feature with the largest alpha of the grid."""
    from .operators.gram import lasso
    return _coefficients(spark, lasso(_area_sums(spark, sf_dir, LINEAR_X[:1]), 10.0),
                         LINEAR_X[:1])


SELECT_X = ["total_connections", "log_connections", "active_connections_percentage",
            "smart_meter_adoption", "total_electrical_capacity", "postal_digit"]
SELECT_ALPHAS = [0.01, 60.0]      # the selector's, and one that leaves features out


def _scaled_rows(spark, sf_dir) -> DataFrame:
    """Keys, year, x (the columns SELECT_X, robustly scaled) and household_consumption."""
    from .operators import ml_prep as M
    rows = _area_featured(spark, sf_dir).withColumn(
        "postal_digit", F.substring("zipcode_from", 1, 1).cast("double"))
    rows = rows.select(*KEYS, "year", "household_consumption",
                       *[F.col(c).cast("double").alias(c) for c in SELECT_X])
    # computed once for all readers, and not a second time by the null filter
    rows = rows.checkpoint().dropna()
    scaled = M.robust_scale(rows, M.fit_robust_scaler(rows, SELECT_X))
    return scaled.select(*KEYS, "year", F.array(*SELECT_X).alias("x"),
                         "household_consumption")


@query("ml_selector")
def ml_selector(spark, sf_dir):
    """M5: lasso coefficients of every feature with their optimality certificate, and which
    features the selector keeps."""
    from .operators import gram as G
    rows = _scaled_rows(spark, sf_dir).withColumn("b", F.lit(0))
    sums = G.block_grams(rows, "x", "household_consumption", "b")[0]
    values = ["coefficient", "gradient", "slack"]
    found = [(a, *r) for a in SELECT_ALPHAS for r in G.selection(sums, SELECT_X, a)]
    out = spark.createDataFrame(found, "alpha double, feature string, coefficient double, "
                                       "gradient double, slack double, kept boolean")
    out = _round(out.withColumn("kept", F.col("kept").cast("int")), values, 3)
    return out.withColumns({c: F.col(c) + F.lit(0.0) for c in values})      # no -0.0


@query("ml_grid_cv")
def ml_grid_cv(spark, sf_dir):
    """Every candidate of the linear models' grids on every expanding-window fold, and
    the one chosen by its mean."""
    from .operators import gram as G
    from .operators import ml_prep as M
    from .plans.training import LINEAR_GRIDS
    folds = M.expanding_folds(_scaled_rows(spark, sf_dir), ["year", *KEYS])
    blocks = G.block_grams(folds, "x", "household_consumption", "fold")
    rows, best = G.grid_search(blocks, LINEAR_GRIDS, 3)
    out = spark.createDataFrame(
        [(m, a or 0.0, f, n, t, r, int(best[m][2] == a)) for m, a, f, n, t, r in rows],
        "model string, alpha double, fold int, n_train bigint, n_test bigint, r2 double, "
        "chosen int")
    return _round(out, ["r2"], 6)


TREE_X = ["num_connections", "perc_of_active_connections", "delivery_perc"]


def _tree(spark, sf_dir, columns, depth):
    """(nodes, thresholds) of one tree over all rows of the area table that have the columns."""
    from .operators import forest as FO
    rows = (S.energy_area(spark, sf_dir).select(*KEYS, *columns, "annual_consume").dropna()
            .select(F.xxhash64(*KEYS).alias("id"), F.lit(0).alias("fold"),
                    F.array(*columns).alias("x"), "annual_consume"))
    params = FO.ForestParams(trees=1, depth=depth, bootstrap=False, bins=64)
    cuts = FO.feature_bins(rows, "x", len(columns), params.bins)
    binned = FO.binned_rows(rows, "x", "annual_consume", cuts).checkpoint()
    return FO.grow_forests(binned, cuts, [1], params), cuts


@query("ml_forest_stump")
def ml_forest_stump(spark, sf_dir):
    """M9: one tree of depth one, no bagging; the prediction of every feature value."""
    from .operators.forest import ForestModel
    nodes, cuts = _tree(spark, sf_dir, TREE_X[2:], 1)
    out = S.energy_area(spark, sf_dir).select("delivery_perc").distinct().select(
        "delivery_perc", ForestModel(nodes, cuts).predict([F.col("delivery_perc")])
        .alias("prediction"))
    return _round(out, ["prediction"], 4)


def _named(feature):
    return F.get(F.array(*[F.lit(c) for c in TREE_X]), F.col(feature))


@query("ml_tree_depth2")
def ml_tree_depth2(spark, sf_dir):
    """M9: the nodes of one tree of depth two over three features, no bagging."""
    nodes, _ = _tree(spark, sf_dir, TREE_X, 2)
    out = nodes.select("node", _named("feature").alias("feature"), "threshold",
                       F.col("weight").cast("bigint").alias("n"), "prediction", "impurity",
                       "gain")
    out = _round(out, ["threshold", "prediction"], 4)
    return _round(out, ["impurity", "gain"], 1)


@query("ml_national_model")
def ml_national_model(spark, sf_dir):
    """M20 on two yearly weather measures."""
    from .plans.training import national_model
    integ = annual.integrated_annual(S.energy_area(spark, sf_dir), _national(spark, sf_dir))
    _, out = national_model(integ, features=("avg_temp", "total_precipitation"))
    return _round(out.select("r2", "rmse", "intercept", "coef_avg_temp",
                             "coef_total_precipitation"),
                  ["r2", "rmse", "intercept", "coef_avg_temp", "coef_total_precipitation"], 3)


# ------------------------------------------------------------------------------ package
PROVINCE_KWH = 5.0


def _package(spark, sf_dir) -> dict:
    """A package made from the area table, stored and loaded: least squares on two features,
    and a fixed step per province code."""
    from types import SimpleNamespace
    from .operators.gram import LinearModel, r2, ridge
    from .operators.ml_prep import fit_label_vocabularies
    from .plans.package import load_package, save_package
    sums = _area_sums(spark, sf_dir, LINEAR_X)
    fit = ridge(sums)
    vocab = fit_label_vocabularies(_area_featured(spark, sf_dir).where(
        "postal_province != 'other'"), ["postal_province"])
    feats = ["total_connections", "active_connections_percentage", "postal_province"]
    meta = {"model_name": "Linear Regression", "feature_columns": feats,
            "selected_indices": [0, 1, 2], "target_column": "annual_consume",
            "use_scaled": False, "test_r2": r2(sums, fit), "test_rmse": None,
            "cv_r2_mean": None, "cv_r2_std": None}
    path = _scratch(spark, "package")
    save_package(SimpleNamespace(
        best_model=LinearModel([*fit.coefficients, PROVINCE_KWH], fit.intercept),
        vocabulary=vocab, medians={"total_connections": 30.0,
                                   "active_connections_percentage": 88.0},
        scaler={}, meta=meta), path)
    return load_package(spark, path)


@query("score_package")
def score_package(spark, sf_dir):
    """Requests scored with a stored package."""
    from .plans.package import score_requests
    scored, _ = score_requests(_package(spark, sf_dir), S.score_request(spark, sf_dir))
    return _round(scored.select("request_id", "model_used", "prediction_kwh"),
                  ["prediction_kwh"], 4)


@query("score_forest_package")
def score_forest_package(spark, sf_dir):
    """M16/M17, S13/S14 with a forest: a tree of depth two, stored, loaded and applied."""
    from types import SimpleNamespace
    from .operators.forest import ForestModel
    from .operators.ml_prep import fit_label_vocabularies
    from .plans.package import load_package, save_package, score_requests
    nodes, cuts = _tree(spark, sf_dir, LINEAR_X, 2)
    feats = ["total_connections", "active_connections_percentage"]
    meta = {"model_name": "Random Forest", "feature_columns": feats, "selected_indices": [0, 1],
            "target_column": "annual_consume", "use_scaled": False}
    vocabulary = fit_label_vocabularies(_area_featured(spark, sf_dir), ["postal_province"])
    path = _scratch(spark, "forest_package")
    save_package(SimpleNamespace(
        best_model=ForestModel(nodes, cuts), vocabulary=vocabulary, scaler={}, meta=meta,
        medians={"total_connections": 30.0, "active_connections_percentage": 88.0}), path)
    scored, _ = score_requests(load_package(spark, path), S.score_request(spark, sf_dir))
    return _round(scored.select("request_id", "model_used", "prediction_kwh"),
                  ["prediction_kwh"], 4)


@query("ml_model_info")
def ml_model_info(spark, sf_dir):
    """The stored package's performance, counts and allowed values."""
    from .plans.package import model_info
    info = model_info(spark, _package(spark, sf_dir))
    lists = ["house_types", "companies", "weather_scenarios"]
    return _round(info.select("model_name", "target_column", "use_scaled", "test_r2",
                              "feature_count", "selected_feature_count",
                              *[F.array_join(F.array_sort(c), ",").alias(c) for c in lists]),
                  ["test_r2"], 6)


# ------------------------------------------------------------------------------ training
@query("ml_train_models")
def ml_train_models(spark, sf_dir):
    """Prepare (join, features, cleaning), encode/impute/scale on the training part,
    LASSO selection, OLS/ridge/lasso/forest with expanding-window CV; one metrics row per model.
    Iterative fits have no SQL form: the driver checks rows only."""
    from .plans.training import discard, prepare_with_counts, train_models
    data, counts = prepare_with_counts(S.energy_area(spark, sf_dir), _national(spark, sf_dir))
    res = train_models(data, KEYS, stage_counts=counts)
    discard(data)
    return res.metrics
