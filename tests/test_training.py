"""Training on the smallest tables: four models, selection, package round trip, scoring."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL


def test_train_package_and_score(spark, tmpdir_path):
    from loadcast.operators import weather
    from loadcast.plans.package import load_package, save_package, score_requests
    from loadcast.plans.training import prepare_training_data, train_models
    from loadcast.sources import standins as S
    from loadcast.operators import ml_prep as M
    KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    data = prepare_training_data(S.energy_area(spark, SF_SMALL),
                                 weather.national_from_raw(S.weather_raw(spark, SF_SMALL)))
    res = train_models(data, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"],
                       forest_trees=5)
    m = {r["model"]: r for r in res.metrics.collect()}
    assert set(m) == {"Linear Regression", "Ridge Regression", "Lasso Regression", "Random Forest"}
    assert all(r["test_r2"] is not None and r["cv_r2_std"] >= 0 for r in m.values())
    assert res.meta["training_rows"] == data.where(M.split_flag(KEYS)).count()
    assert res.meta["selected_feature_count"] == len(res.selected) > 0
    assert "connection_efficiency" not in res.feature_columns          # leaky feature excluded
    assert res.importance.count() == min(10, len(res.selected))
    save_package(res, tmpdir_path + "/pkg")
    pkg = load_package(spark, tmpdir_path + "/pkg")
    assert pkg is not None and pkg["model_name"] == res.best_model_name
    assert load_package(spark, tmpdir_path + "/missing") is None
    resp, bad = score_requests(pkg, S.score_request(spark, SF_SMALL))
    assert resp.count() + bad.count() == S.score_request(spark, SF_SMALL).count()
    assert resp.where(F.col("prediction_kwh").isNull()).count() == 0


def _rows(spark, n=400, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1.0, 5.0, 0.3]
    y = x @ np.array([2.0, -1.0, 0.5]) + 3 + rng.normal(scale=0.5, size=n)
    fold = np.repeat([-1, 0, 1, 2], n // 4)
    df = spark.createDataFrame([([float(v) for v in r], float(t), int(f))
                                for r, t, f in zip(x, y, fold)],
                               "x array<double>, y double, fold int")
    return df, x, y, fold


@pytest.mark.parametrize("alpha", [0.0, 0.1, 10.0, 100.0])
def test_ridge_of_every_fold_matches_numpy(spark, alpha):
    """The penalty is applied to each fold's own rows."""
    from loadcast.operators import gram as G
    df, x, y, fold = _rows(spark)
    grams = G.block_grams(df, "x", "y", "fold")
    for i in range(3):
        xf, yf = x[fold < i], y[fold < i]
        xc, yc = xf - xf.mean(0), yf - yf.mean()
        w = np.linalg.solve(xc.T @ xc + alpha * np.eye(3), xc.T @ yc)
        seen = [g for k, g in grams.items() if k < i]
        model = G.ridge(sum(seen[1:], seen[0]), alpha)
        assert np.allclose(model.coefficients, w, atol=1e-8)
        test, truth = x[fold == i], y[fold == i]
        pred = test @ w + model.intercept
        want = 1 - ((truth - pred) ** 2).sum() / ((truth - truth.mean()) ** 2).sum()
        assert G.r2(grams[i], model) == pytest.approx(want, abs=1e-9)


def test_lasso_meets_its_optimality_conditions(spark):
    from loadcast.operators import gram as G
    df, x, y, fold = _rows(spark)
    total = sum(G.block_grams(df, "x", "y", "fold").values(), np.zeros((5, 5)))
    for alpha in (0.01, 0.3, 1.0, 100.0):
        m = G.lasso(total, alpha)
        residual = y - m.intercept - x @ np.array(m.coefficients)
        pull = (x - x.mean(0)).T @ residual / len(y)
        for g, w in zip(pull, m.coefficients):
            assert abs(g) <= alpha + 1e-7
            if w:
                assert g == pytest.approx(alpha * np.sign(w), abs=1e-7)


def test_constant_target_scores_zero(spark):
    from loadcast.operators import gram as G
    df = spark.createDataFrame([([float(i)], 5.0, 0) for i in range(10)],
                               "x array<double>, y double, fold int")
    g = G.block_grams(df, "x", "y", "fold")[0]
    assert G.r2(g, G.ridge(g)) == 0.0


def test_no_default_drops_rows():
    """Sampling is off unless the caller asks for it."""
    import inspect
    from loadcast.plans.training import train_models
    defaults = {k: p.default for k, p in inspect.signature(train_models).parameters.items()}
    assert defaults["forest_sample_rows"] is None
    assert not [k for k in defaults if "rows" in k and k != "forest_sample_rows"]


def test_national_model(spark):
    import __spark_entry__ as E
    from loadcast.plans.training import national_model
    from loadcast.operators import annual, weather
    from loadcast.sources import standins as S
    integ = annual.integrated_annual(S.energy_area(spark, SF_SMALL),
                                     weather.national_from_raw(S.weather_raw(spark, SF_SMALL)))
    _, out = national_model(integ)
    r = out.first()
    assert r["r2"] is not None and "coef_avg_temp" in out.columns


def test_stage_counts_of_a_training_run_equal_the_funnel(spark):
    import __spark_entry__ as E
    from loadcast.operators import weather
    from loadcast.plans.training import prepare_with_counts
    from loadcast.sources import standins as S
    data, counts = prepare_with_counts(S.energy_area(spark, SF_SMALL), weather.national_from_raw(
        S.weather_raw(spark, SF_SMALL)))
    funnel = E.queries()["dq_funnel"](spark, SF_SMALL).first().asDict()
    assert counts == {**funnel, "after_iqr_filter": data.count()}


def test_training_stores_narrow_tables_and_deletes_them(spark):
    """The cleaned table holds the joined columns only, its features follow as it is read; what
    training stores beside it is gone afterwards, and the table itself when it is discarded."""
    from loadcast.functions.features import with_features
    from loadcast.operators import quality as Q
    from loadcast.operators import weather
    from loadcast.plans import training as T
    from loadcast.session import scratch_path
    from loadcast.sources import standins as S
    from loadcast.sources.storage import names
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    national = weather.national_from_raw(S.weather_raw(spark, SF_SMALL)).checkpoint()
    area = S.energy_area(spark, SF_SMALL)
    data, _ = T.prepare_with_counts(area, national)
    folders = {f.rpartition("/")[0] for f in data.inputFiles()}
    assert len(folders) == 1
    stored = spark.read.parquet(*folders)
    assert "household_consumption" not in stored.columns and "annual_consume" in stored.columns
    plain = Q.drop_incomplete(with_features(T.join_by_year(area, national.drop(
        "data_source", "stations_used", "coverage"))))
    plain = Q.iqr_filter(Q.household_range_filter(Q.active_filter(
        Q.with_preliminary_household(plain))), "type_of_connection",
        "preliminary_household_consumption")
    assert data.columns == plain.columns
    assert sorted(map(str, data.collect())) == sorted(map(str, plain.collect()))
    T.train_models(data, [*keys, "year"], forest_trees=2)
    left = lambda name: names(spark, scratch_path(spark, name))
    assert left(T.RANGE_FOLDER) == left(T.ENCODED_FOLDER) == []
    before = left(T.CLEANED_FOLDER)
    T.discard(data)
    assert len(left(T.CLEANED_FOLDER)) == len(before) - 1
