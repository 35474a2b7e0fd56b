"""Model package store (S13/S14, M19) and batch scoring with a stored package.

Layout under one directory on shared storage:
  v-<id>/vocabulary/     parquet (feature, value, code)
  v-<id>/nodes/          parquet, a forest's nodes (a linear model is its coefficients, in the
                         manifest)
  manifest-<number>.json model name, feature list, selected indices, medians, scaler, metrics, the
                         folder of the version and digests of its tables

A version's tables are written to a folder of their own, the manifest last and under a number
that no other writer holds: a package is there once its manifest is. Readers take the newest
manifest that is whole and refuse tables that don't have its digests, so neither a writer that
stops half-way nor two writers at once can make a mixed package. The tables of the two newest
versions are kept.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.features import with_features
from ..operators import ml_prep as M
from ..operators import scoring as SC
from ..operators.forest import ForestModel
from ..operators.gram import LinearModel
from ..operators.scoring_model import fill_missing_features
from ..sources import storage

VERSIONS_KEPT = 2


def _digest(table: DataFrame) -> list[str]:
    """Rows and a checksum that does not depend on their order."""
    rows, sums = table.agg(F.count("*"), F.sum(F.xxhash64(*sorted(table.columns))
                                               .cast("decimal(38,0)"))).first()
    return [str(rows), str(sums)]


def _sealed(body: dict) -> str:
    text = json.dumps(body, sort_keys=True)
    return json.dumps({"sha256": hashlib.sha256(text.encode()).hexdigest(), "body": text})


def _unsealed(text: str) -> dict | None:
    """The manifest, or None if it was not written to its end."""
    try:
        outer = json.loads(text)
        if hashlib.sha256(outer["body"].encode()).hexdigest() == outer["sha256"]:
            return json.loads(outer["body"])
    except (ValueError, KeyError, TypeError):
        pass
    return None


def _manifests(spark: SparkSession, path: str) -> list[tuple[int, dict]]:
    """Whole manifests, the newest first."""
    found = []
    for name in storage.names(spark, path):
        number = name.removeprefix("manifest-").removesuffix(".json")
        if name == f"manifest-{number}.json" and number.isdigit():
            body = _unsealed(storage.read_text(spark, f"{path}/{name}"))
            if body is not None:
                found.append((int(number), body))
    return sorted(found, key=lambda m: -m[0])


def save_package(result, path: str) -> int:
    """Store a training result (anything with best_model, vocabulary, medians, scaler, meta).
    Returns the version's number."""
    spark, path = result.vocabulary.sparkSession, path.rstrip("/")
    meta = dict(result.meta, medians=result.medians,
                scaler={k: list(v) for k, v in result.scaler.items()})
    meta["folder"] = f"v-{uuid.uuid4().hex}"
    tables = {"vocabulary": result.vocabulary}
    if isinstance(result.best_model, LinearModel):
        meta["linear"] = vars(result.best_model)
    else:
        meta["thresholds"] = result.best_model.thresholds
        tables["nodes"] = result.best_model.nodes
    meta["digests"] = {}
    for name, table in tables.items():
        table.write.parquet(f"{path}/{meta['folder']}/{name}")
        meta["digests"][name] = _digest(spark.read.parquet(f"{path}/{meta['folder']}/{name}"))
    while True:
        taken = [int(n[9:-5]) for n in storage.names(spark, path)
                 if n.startswith("manifest-") and n[9:-5].isdigit()]
        number = max(taken, default=0) + 1
        if storage.write_new(spark, f"{path}/manifest-{number:09d}.json", _sealed(meta)):
            break
    for old, body in _manifests(spark, path)[VERSIONS_KEPT:]:
        storage.delete(spark, f"{path}/manifest-{old:09d}.json")
        storage.delete(spark, f"{path}/{body['folder']}")
    return number


def load_package(spark: SparkSession, path: str) -> dict | None:
    """The newest package, or None when there is none or its tables are not those that its
    manifest describes. Errors of the storage itself are raised. The vocabularies' sizes are
    measured here once, not for every scored batch."""
    path = path.rstrip("/")
    manifests = _manifests(spark, path)
    if not manifests:
        return None
    meta = manifests[0][1]
    tables = {}
    for name, digest in meta["digests"].items():
        try:
            tables[name] = spark.read.parquet(f"{path}/{meta['folder']}/{name}")
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise
        if _digest(tables[name]) != digest:
            return None
    meta["model"] = LinearModel(**meta["linear"]) if "linear" in meta else \
        ForestModel(tables["nodes"], meta["thresholds"])
    meta["vocabulary"] = tables["vocabulary"]
    meta["vocabulary_sides"] = M.vocabulary_sides(meta["vocabulary"])
    return meta


def score_inputs(pkg: dict, inputs: DataFrame, pred: str = "prediction_kwh") -> DataFrame:
    """Model-input rows (see ``operators.scoring.to_model_input``) -> prediction column,
    with the same feature functions as training, stored vocabulary (unseen -> 0), stored
    medians for missing numbers (0 for absent columns), stored scaling and the stored feature
    selection; one projection for the whole table."""
    feats = pkg["feature_columns"]
    cats = [c for c in feats if c in K.CATEGORICAL_COLUMNS]
    df = fill_missing_features(with_features(inputs), feats, fill_numbers=False)
    df = M.apply_label_codes(df, pkg["vocabulary"], cats, sides=pkg["vocabulary_sides"])
    df = M.impute(df, pkg["medians"])
    x = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in feats]
    if pkg["use_scaled"]:
        x = [(v - F.lit(float(pkg["scaler"][c][0]))) / F.lit(float(pkg["scaler"][c][1]))
             for v, c in zip(x, feats)]
    x = [x[i] for i in pkg["selected_indices"]]
    return df.withColumn(pred, pkg["model"].predict(x))


def model_info(spark: SparkSession, pkg: dict) -> DataFrame:
    """One row with the stored performance, the feature counts and the values that requests
    may hold."""
    row = {k: pkg.get(k) for k in ("model_name", "target_column", "use_scaled", "test_r2",
                                   "test_rmse", "cv_r2_mean", "cv_r2_std")}
    row |= {"feature_count": len(pkg["feature_columns"]),
            "selected_feature_count": len(pkg["selected_indices"]),
            "house_types": list(K.HOUSE_TYPES), "companies": list(K.COMPANIES),
            "weather_scenarios": list(K.WEATHER_SCENARIOS)}
    return spark.createDataFrame(
        [tuple(row.values())], "model_name string, target_column string, use_scaled boolean, "
        "test_r2 double, test_rmse double, cv_r2_mean double, cv_r2_std double, "
        "feature_count int, selected_feature_count int, house_types array<string>, "
        "companies array<string>, weather_scenarios array<string>")


def score_requests(pkg: dict, requests: DataFrame):
    """Requests -> (responses, quarantine). Invalid rows keep their reasons."""
    valid, bad = SC.split_valid(SC.validate(requests))
    scored = score_inputs(pkg, SC.to_model_input(valid))
    return SC.response(scored, pkg["model_name"]), bad
