"""Training job: prepare (join, features, cleaning), encode/impute/split/scale, LASSO feature
selection, four regressors with expanding-window CV grid search, evaluation, importance,
and the model package (M1-M20, S13).

Scale notes
-----------
* The training table is stored twice, by columns: as cleaned (the joined rows only; features
  follow from them as they are read), and as encoded (scaled values follow from its columns).
  Every fit re-reads the latter; what is no longer read is deleted.
* Encoders, medians and scaling parameters are fitted on the training part only, from counts of
  distinct values.
* Folds are labelled by comparing order keys with three boundary keys (no join back).
* One pass adds up the feature products per fold; the selector, every linear candidate and its
  scores on every fold are solved from these sums.
* The forests of all folds and the final one grow side by side over one binned table, their
  subtrees in rounds of a few bags each.
* Every model is fitted and scored on the same rows and folds; nothing is sampled unless the
  caller asks for it.
"""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.features import with_features
from ..operators import forest as FO
from ..operators import gram as G
from ..operators import ml_prep as M
from ..operators import quality as Q
from ..operators.joins import join_by_year
from ..session import release_disk, store_table
from ..sources.storage import delete

ROWS_PER_PARTITION = 25_000     # of a training table with fewer partitions than there are cores

RANGE_FOLDER, CLEANED_FOLDER = "training_in_range", "training_cleaned"
ENCODED_FOLDER = "training_encoded"

LINEAR_GRIDS = {
    "Linear Regression": [(None, G.ridge)],
    "Ridge Regression": [(a, lambda g, a=a: G.ridge(g, a)) for a in K.RIDGE_ALPHAS],
    "Lasso Regression": [(a, lambda g, a=a: G.lasso(g, a)) for a in K.LASSO_ALPHAS],
}


def prepare_with_counts(area: DataFrame, national: DataFrame) -> tuple[DataFrame, dict]:
    """Area rows x national weather (J2) -> features -> F1 -> F2 -> F3 -> F4, in the order of
    the source system. The IQR filter groups by the raw connection type. Returns the cleaned
    table, and how many rows each stage kept (F8): counted while the rows pass, without a scan of
    their own. The rows are stored under the shared checkpoint folder without the features,
    which follow from each row as it is read (``discard`` deletes them)."""
    spark = area.sparkSession
    weather_cols = [c for c in national.columns if c not in ("data_source", "stations_used",
                                                             "coverage")]
    seen = Observation("funnel")
    df = join_by_year(area, national.select(*weather_cols, F.lit(True).alias("_merged")), "left")
    df = df.observe(seen, *Q.funnel_counts()).where("_merged").drop("_merged")
    joined, household = df.columns, "preliminary_household_consumption"
    df = Q.drop_incomplete(with_features(df))
    df = Q.household_range_filter(Q.active_filter(Q.with_preliminary_household(df)))
    # the range-filtered table feeds both the quartiles and the filter: written once, to the
    # shared checkpoint folder (lineage cut, survives executor loss)
    in_range, path = store_table(df.select(*dict.fromkeys([*joined, household])), RANGE_FOLDER)
    release_disk(spark)
    kept = Observation("kept")
    try:
        out, _ = store_table(Q.iqr_filter(in_range, "type_of_connection", household).observe(
            kept, F.count(F.lit(1)).alias("after_iqr_filter")).select(*joined), CLEANED_FOLDER)
    finally:
        delete(spark, path)
    release_disk(spark)
    return Q.with_preliminary_household(with_features(out)), {**seen.get, **kept.get}


def discard(data: DataFrame) -> None:
    """Delete the rows of a table of ``prepare_with_counts`` that nobody reads any more."""
    folder = f"/{CLEANED_FOLDER}/"
    for path in {f.rpartition("/")[0] for f in data.inputFiles() if folder in f}:
        delete(data.sparkSession, path)


def prepare_training_data(area: DataFrame, national: DataFrame) -> DataFrame:
    """The table of ``prepare_with_counts``."""
    return prepare_with_counts(area, national)[0]


def feature_list(include_leaky: bool = False):
    return [c for c in K.FEATURE_COLUMNS if include_leaky or c not in K.LEAKY_FEATURES]


@dataclass
class TrainResult:
    metrics: DataFrame                  # one row per model (test + CV metrics)
    best_model_name: str
    best_model: object
    use_scaled: bool
    feature_columns: list
    selected: list
    vocabulary: DataFrame
    medians: dict
    scaler: dict
    importance: DataFrame
    meta: dict = field(default_factory=dict)


def train_models(data: DataFrame, key_cols, target: str = K.TARGET_COLUMN,
                 include_leaky: bool = False, select_by: str = "cv",
                 forest_trees: int = K.FOREST_TREES, cv_splits: int = K.CV_SPLITS,
                 models=None, forest_sample_rows: int | None = None,
                 exact_quantiles: bool = True, stage_counts: dict | None = None) -> TrainResult:
    """Fit the four regressors and report CV and test metrics, all on the same rows and folds.

    ``forest_sample_rows`` fits the final forest on about so many training rows (a deterministic
    md5-of-key sample, off by default); CV and evaluation always use all rows.
    ``exact_quantiles=False`` fits medians and scaling quartiles from sketches in one pass (for
    very large tables) instead of exact value counts. ``stage_counts`` (of
    ``prepare_with_counts``) goes into the metadata."""
    spark = data.sparkSession
    feats = feature_list(include_leaky)
    cats = [c for c in feats if c in K.CATEGORICAL_COLUMNS]
    nums = [c for c in feats if c not in K.CATEGORICAL_COLUMNS]
    key_cols = list(key_cols)
    phases: dict[str, float] = {}
    clock = [time.time()]

    def mark(phase: str) -> None:  # wall seconds per phase, reported in meta
        now = time.time()
        phases[phase] = round(now - clock[0], 3)
        clock[0] = now

    own = list(dict.fromkeys([*key_cols, "year"]))      # the year may be one of the keys
    base = data.select(*own, *feats, target).withColumn("_train",
                                                                     M.split_flag(key_cols))
    # a few large files: as many tasks as there are cores. A table that has them stays where it
    # is, as dealing it by the keys would write all its features
    parts = min(-(-data.count() // ROWS_PER_PARTITION), 4 * spark.sparkContext.defaultParallelism)
    if data.rdd.getNumPartitions() < min(parts, spark.sparkContext.defaultParallelism):
        base = base.repartition(parts, *key_cols)
    train = base.where("_train")
    vocab = M.fit_label_vocabularies(train, cats)
    coded = M.apply_label_codes(base, vocab, cats)
    if exact_quantiles:
        medians, scaler = M.fit_medians_and_scaler(coded.where("_train"), nums, feats)
        enc = M.impute(coded, medians).withColumns({c: F.col(c).cast("double") for c in feats})
    else:
        medians = M.fit_medians(train, nums, exact=False)
        enc = M.impute(coded, medians).withColumns({c: F.col(c).cast("double") for c in feats})
        scaler = M.fit_robust_scaler(enc.where("_train"), feats, exact=False)
    mark("fit_encoders_medians_scaler")
    encoded, path = store_table(enc.select(
        *own, F.col(target).cast("double").alias(target), "_train", *feats),
        ENCODED_FOLDER)
    release_disk(spark)
    enc = M.robust_scale(encoded, scaler, suffix="_s").select(
        *own, target, "_train",
        F.array(*[F.coalesce(c, F.lit(0.0)) for c in feats]).alias("x_raw"),
        F.array(*[F.coalesce(c + "_s", F.lit(0.0)) for c in feats]).alias("x_scaled"))
    te = enc.where(~F.col("_train"))
    tr = M.expanding_folds(enc.where("_train"), list(dict.fromkeys(["year", *key_cols])),
                           n_splits=cv_splits)
    mark("encode_and_folds")

    grams = G.block_grams(tr, "x_scaled", target, "fold")
    zero = np.zeros((len(feats) + 2, len(feats) + 2))
    total = sum(grams.values(), zero)
    n = int(total[0, 0])
    # M5: LASSO selector on scaled features, keep |coef| >= median |coef|
    chosen = G.selection(total, feats, K.SELECTOR_LASSO_ALPHA)
    selected = [i for i, row in enumerate(chosen) if row[4]]
    total = G.subset(total, selected)
    blocks = {k: G.subset(g, selected) for k, g in grams.items()}
    mark("products_and_selection")

    linear = {m: candidates for m, candidates in LINEAR_GRIDS.items()
              if not models or m in models}
    names = [*linear, *(["Random Forest"] if not models or "Random Forest" in models else [])]
    _, best = G.grid_search(blocks, linear, cv_splits)
    cv = {m: (mean, std, {} if alpha is None else {"alpha": alpha})
          for m, (mean, std, alpha, _) in best.items()}
    fitted: dict[str, object] = {m: fit(total) for m, (_, _, _, fit) in best.items()}
    mark("linear_models")

    inputs = {m: [F.col("x_scaled" if m in linear else "x_raw")[i] for i in selected]
              for m in names}
    if "Random Forest" in names:
        params = FO.ForestParams(trees=forest_trees, depth=K.FOREST_DEPTH,
                                 min_split=K.FOREST_MIN_SPLIT, min_leaf=K.FOREST_MIN_LEAF,
                                 features=max(1, int(len(selected) ** 0.5)), seed=K.FOREST_SEED)
        rows = tr.select(F.xxhash64(*key_cols).alias("id"), *key_cols, "fold",
                         F.col(target).alias("y"), F.array(*inputs["Random Forest"]).alias("x"))
        cuts = FO.feature_bins(rows, "x", len(selected), params.bins)
        binned = FO.binned_rows(rows, "x", "y", cuts).checkpoint()
        tested = [i for i in range(cv_splits) if i in blocks]
        if forest_sample_rows is None:
            nodes = FO.grow_forests(binned, cuts, [*tested, cv_splits], params)
            final = nodes.where(F.col("forest") == len(tested))
        else:
            nodes = FO.grow_forests(binned, cuts, tested, params)
            some = M.sample_about_n(rows, forest_sample_rows, n, key_cols)
            final = FO.grow_forests(FO.binned_rows(some, "x", "y", cuts).checkpoint(), cuts,
                                    [cv_splits], params)
        del binned
        release_disk(spark)
        scores = []
        for k, i in enumerate(tested):
            model = FO.ForestModel(nodes.where(F.col("forest") == k), cuts)
            scores.append(_r2(tr.where(F.col("fold") == i).select(
                target, model.predict(inputs["Random Forest"]).alias("prediction")), target))
        fitted["Random Forest"] = FO.ForestModel(final, cuts)
        cv["Random Forest"] = (float(np.mean(scores or [0.0])), float(np.std(scores or [0.0])),
                               {})
    mark("forest")

    # one pass over both parts scores every model
    scored = enc.withColumns({f"_p{i}": fitted[m].predict(inputs[m])
                              for i, m in enumerate(names)})
    long = scored.select("_train", F.col(target).alias("actual"), F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), F.col(f"_p{i}").alias("predicted"))
        for i, m in enumerate(names)])).alias("_s")).select("_train", "actual", "_s.*")
    measured = {(r["model"], r["_train"]): r for r in M.regression_metrics(
        long, group_cols=["model", "_train"]).collect()}
    mark("evaluation")
    delete(spark, path)
    rows = []
    for m in names:
        mean, std, params = cv[m]
        t, f = measured.get((m, False)), measured[(m, True)]
        rows.append((m, json.dumps(params), mean, std, f["r2"],
                     *([t["r2"], t["rmse"], t["mae"], t["relative_error_pct"]] if t
                       else [None] * 4), m != "Random Forest"))
    metrics = spark.createDataFrame(rows, "model string, params string, cv_r2_mean double, "
                                          "cv_r2_std double, train_r2 double, test_r2 double, "
                                          "test_rmse double, test_mae double, "
                                          "relative_error_pct double, use_scaled boolean")
    column = 2 if select_by == "cv" else 5
    best_row = max(rows, key=lambda r: float("-inf") if r[column] is None else r[column])
    best_name = best_row[0]
    best_model = fitted[best_name]
    sel_names = [feats[i] for i in selected]
    if best_name in linear:
        imp = np.abs(best_model.coefficients)
    else:
        imp = np.zeros(len(selected))
        for r in FO.importances(best_model.nodes).collect():     # a row per feature
            imp[r["feature"]] = r["importance"]
    wide = spark.createDataFrame([tuple(float(v) for v in imp)], sel_names)
    importance = M.top_k_importance(wide, sel_names, 10)
    meta = {"model_name": best_name, "feature_columns": feats, "selected_features": sel_names,
            "selected_indices": selected, "target_column": target, "use_scaled": best_row[9],
            "test_r2": best_row[5], "test_rmse": best_row[6], "cv_r2_mean": best_row[2],
            "cv_r2_std": best_row[3], "feature_count": len(feats),
            "selected_feature_count": len(selected), "training_rows": n,
            "phase_seconds": phases, "stage_counts": stage_counts or {}}
    return TrainResult(metrics, best_name, best_model, best_row[9], feats, selected, vocab,
                       medians, scaler, importance, meta)


def _r2(pred: DataFrame, label: str) -> float:
    """R2 of the column ``prediction``; 0 where the label is constant."""
    r = M.regression_metrics(pred, actual=label, predicted="prediction").first()["r2"]
    return 0.0 if r is None else r


def national_model(integrated: DataFrame, target: str = "avg_annual_consume",
                   features=("avg_temp", "total_precipitation", "total_sunshine_hours",
                             "avg_wind_speed")):
    """OLS of a yearly energy measure on the national weather (one row per year).
    Returns (model, one-row DataFrame with r2, rmse and the coefficients by name)."""
    feats = list(features)
    rows = integrated.select(*feats, target).dropna()
    sums = G.block_grams(rows.withColumns({"_x": F.array(*[F.col(f).cast("double") for f in feats]),
                                           "_b": F.lit(0)}), "_x", target, "_b")[0]
    model = G.ridge(sums)
    score = G.r2(sums, model)
    sst = sums[-1, -1] - sums[0, -1] ** 2 / sums[0, 0]
    rmse = float(max((1 - score) * sst, 0.0) / sums[0, 0]) ** 0.5
    coefs = {f"coef_{f}": c for f, c in zip(feats, model.coefficients)}
    out = integrated.sparkSession.createDataFrame(
        [dict(r2=score, rmse=rmse, intercept=model.intercept, **coefs)])
    return model, out
