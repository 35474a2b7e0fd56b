"""ML preprocessing as DataFrame operators: label vocabularies (M1/J5), median imputation
(M2/A7), stable hash split (M3), deterministic sample (T5), expanding-window folds (M11),
exact robust scaling (M4), closed-form simple OLS (M6 check) and evaluation metrics
(A12-A14, M13-M15).

Fitted parameters (codes, medians, quartiles, fold boundaries) are small tables whose size is
bounded by the number of columns or distinct category values, never by the row count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from .joins import broadcast_bytes
from .ranking import counted_quantiles, global_row_number, group_quantiles, running_total

MAP_VALUES = 64       # a map is searched value by value
NULL_CATEGORY = "nan"  # a missing category is a category of its own, as pandas astype(str)


def _as_category(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(NULL_CATEGORY))


# ----------------------------------------------------------------------------- M1 / J5
def fit_label_vocabularies(df: DataFrame, columns) -> DataFrame:
    """Long vocabulary table ``(feature, value, code)``: codes 0..k-1 in sorted value order per
    column. All columns are ranked in ONE sort of the distinct (column, value) pairs."""
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), _as_category(c).alias("value")) for c in columns]))
        .alias("_s")).select("_s.feature", "_s.value").distinct()
    ranked = running_total(pairs, ["feature", "value"])
    first = ranked.groupBy("feature").agg(F.min("_before").alias("_first"))  # a row per column
    return ranked.join(F.broadcast(first), "feature").select(
        "feature", "value", (F.col("_before") - F.col("_first")).cast("int").alias("code")) \
        .checkpoint(eager=True)


def vocabulary_sides(vocab: DataFrame) -> dict[str, int | dict[str, int]]:
    """How each column's vocabulary is looked up: its values and codes themselves where there are
    ``MAP_VALUES`` or fewer, else about how many bytes it takes as a broadcast side."""
    rows = vocab.groupBy("feature").agg(F.count("*").alias("n"), F.sum(
        F.octet_length("value") + F.lit(48)).alias("bytes")).collect()
    out: dict = {r["feature"]: {} if r["n"] <= MAP_VALUES else r["bytes"] for r in rows}
    few = [c for c, side in out.items() if side == {}]
    for r in vocab.where(F.col("feature").isin(few)).collect():
        out[r["feature"]][r["value"]] = r["code"]
    return out


def apply_label_codes(df: DataFrame, vocab: DataFrame, columns, suffix: str = "",
                      sides: dict | None = None) -> DataFrame:
    """Replace each categorical column by its code; unseen values get code 0 (the
    alphabetically first label, as the source system does). All small vocabularies are map
    lookups in one projection, without a join. Of the others, those whose bytes stay below the
    session's broadcast limit are broadcast; beyond it a vocabulary is joined with a shuffle,
    whose hot values Spark splits. Pass ``sides`` (see :func:`vocabulary_sides`) where the same
    vocabulary is applied often."""
    sides = vocabulary_sides(vocab) if sides is None else sides
    limit = broadcast_bytes(df.sparkSession)
    lookups, out = {}, df
    for c in columns:
        side = sides.get(c, {})
        if isinstance(side, dict):
            codes = F.create_map(*[F.lit(x) for pair in side.items() for x in pair])
            lookups[c + suffix] = F.coalesce(F.try_element_at(codes, _as_category(c)), F.lit(0)) \
                if side else F.lit(0)
            continue
        v = vocab.where(F.col("feature") == c).select(F.col("value").alias(f"_v_{c}"),
                                                      F.col("code").alias(f"_code_{c}"))
        out = out.withColumn(f"_k_{c}", _as_category(c)).join(
            F.broadcast(v) if side <= limit else v, F.col(f"_k_{c}") == F.col(f"_v_{c}"), "left")
        out = out.withColumn(c + suffix, F.coalesce(F.col(f"_code_{c}"), F.lit(0))) \
                 .drop(f"_k_{c}", f"_v_{c}", f"_code_{c}")
    return out.withColumns(lookups)


# ----------------------------------------------------------------------------- M2 / M4 / A7
def _stacked(df: DataFrame, columns) -> DataFrame:
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
        for c in columns])).alias("_s")).select("_s.column", "_s.value")


def column_quantiles(df: DataFrame, columns, probs) -> DataFrame:
    """Exact quantiles of many numeric columns together: the columns are stacked into
    ``(column, value)`` rows, counted by value where they are read, and only the distinct values
    are ranked. One row per column."""
    return group_quantiles(_stacked(df, columns), ["column"], "value", probs)


def fit_medians(df: DataFrame, columns, exact: bool = True) -> dict[str, float]:
    """Median per column (nulls ignored). A fitted parameter per column is returned to the
    driver: its size is the number of columns. ``exact=False`` uses sketches."""
    if not exact:
        return {c: q[0] for c, q in approx_column_quantiles(df, columns, [0.5]).items()}
    rows = column_quantiles(df, columns, [0.5]).collect()
    return {r["column"]: r["q_0.5"] for r in rows}


def impute(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(float(m)))
                           for c, m in medians.items() if m is not None})


def fit_robust_scaler(df: DataFrame, columns,
                      exact: bool = True) -> dict[str, tuple[float, float]]:
    """(median, IQR) per column with exact linear quantiles (or sketches with
    ``exact=False``); zero or missing IQR -> 1.0."""
    if not exact:
        params = {}
        for c, (q1, med, q3) in approx_column_quantiles(df, columns, [0.25, 0.5, 0.75]).items():
            iqr = (q3 - q1) if q3 is not None else None
            params[c] = (med or 0.0, iqr if iqr else 1.0)
        return params
    rows = column_quantiles(df, columns, [0.25, 0.5, 0.75]).collect()
    params = {}
    for r in rows:
        iqr = (r["q_0.75"] - r["q_0.25"]) if r["q_0.75"] is not None else None
        params[r["column"]] = (r["q_0.5"] or 0.0, iqr if iqr else 1.0)
    return params


def robust_scale(df: DataFrame, params: dict[str, tuple[float, float]],
                 suffix: str = "") -> DataFrame:
    return df.withColumns({c + suffix: (F.col(c) - F.lit(float(m))) / F.lit(float(s))
                           for c, (m, s) in params.items()})


def fit_medians_and_scaler(df: DataFrame, impute_columns, scale_columns):
    """Medians of ``impute_columns`` and the robust scaler of ``scale_columns`` *after* those
    medians fill the nulls, from one table of value counts: the counts of null move to the
    median's value, so no row is read twice. Equal to ``fit_medians`` followed by ``impute`` and
    ``fit_robust_scaler``."""
    impute_columns, scale_columns = list(impute_columns), list(scale_columns)
    columns = list(dict.fromkeys([*impute_columns, *scale_columns]))
    counts = (_stacked(df, columns).groupBy("column", "value")
              .agg(F.count(F.lit(1)).alias("n")).checkpoint(eager=True))
    medians = {c: None for c in impute_columns}
    if impute_columns:
        rows = counted_quantiles(counts.where(F.col("column").isin(impute_columns)), ["column"],
                                 "value", "n", [0.5]).collect()
        medians.update({r["column"]: r["q_0.5"] for r in rows})
    fill = [(c, m) for c, m in medians.items() if m is not None and c in scale_columns]
    filled = counts.where(F.col("column").isin(scale_columns))
    if fill:
        by_column = F.create_map(*[F.lit(x) for c, m in fill for x in (c, float(m))])
        filled = (filled.withColumn("value", F.coalesce(
            "value", F.try_element_at(by_column, F.col("column"))))
            .groupBy("column", "value").agg(F.sum("n").alias("n")))
    scaler = {c: (0.0, 1.0) for c in scale_columns}
    for r in counted_quantiles(filled, ["column"], "value", "n", [0.25, 0.5, 0.75]).collect():
        if r["n"]:
            iqr = r["q_0.75"] - r["q_0.25"]
            scaler[r["column"]] = (r["q_0.5"] or 0.0, iqr if iqr else 1.0)
    return medians, scaler


# ----------------------------------------------------------------------------- M3 / T5
def hash_bucket(key_cols, buckets: int = 100) -> Column:
    """Stable bucket in [0, buckets) from md5 of the '|'-joined key (same in any engine)."""
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in key_cols])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") % buckets


def split_flag(key_cols, test_fraction: float = K.TEST_FRACTION) -> Column:
    """True for the training part: a row's side depends only on its key, so the split is
    reproducible, needs no shuffle and survives recomputation."""
    return hash_bucket(key_cols) < F.lit(int(round(100 * (1 - test_fraction))))


def sample_n(df: DataFrame, n: int, key_cols, total: int | None = None) -> DataFrame:
    """Deterministic sample of ``n`` rows without replacement: the ``n`` smallest md5 keys.

    An ordered limit merges ``n`` rows per input partition in one task, which grows with the
    partition count. So the rows are first filtered by the leading 32 bits of their hash
    against a threshold that lets about ``4n`` rows through (a distributed filter); when at
    least ``n`` rows pass, every row outside has a larger hash than every row inside, so the
    ordered limit over the candidates is exactly the one over the whole table. Otherwise the
    threshold is widened. ``total`` (the row count, if known) saves one counting job."""
    h = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in key_cols]))
    keyed = df.withColumn("_h", h)
    total = df.count() if total is None else total
    if total > 4 * n:
        prefix = F.conv(F.substring("_h", 1, 8), 16, 10).cast("bigint")
        threshold = int(4 * n / total * 2 ** 32) + 1
        while threshold < 2 ** 32:
            cand = keyed.where(prefix < F.lit(threshold))
            if cand.count() >= n:
                return cand.orderBy("_h", *key_cols).limit(n).drop("_h")
            threshold *= 4
    return keyed.orderBy("_h", *key_cols).limit(n).drop("_h")


# ----------------------------------------------------------------------------- M11
def expanding_folds(df: DataFrame, order_cols, n_splits: int = K.CV_SPLITS,
                    fold_col: str = "fold") -> DataFrame:
    """Expanding-window CV folds over the rows ordered by ``order_cols`` (must be unique):
    test size = n // (n_splits + 1); fold i tests on the i-th block after the first
    n - n_splits*size rows and trains on everything before it. ``fold`` is the test block
    index (0..n_splits-1) or -1 for rows that are only ever training rows.

    The first order column is a calendar column (few distinct values): its counts tell in which
    year each boundary lies, and only the rows of those years are ranked. Rows are then labelled
    by comparing their order key with the boundaries, with no join back."""
    first = order_cols[0]
    per = {r[0]: r[1] for r in df.groupBy(first).count().collect()}
    n = sum(per.values())
    size = n // (n_splits + 1)
    if size == 0:
        return df.withColumn(fold_col, F.lit(-1))
    starts = [n - (n_splits - i) * size for i in range(n_splits)]
    ranks, years, before, ranked_before = [], [], 0, 0
    for year in sorted(per, key=lambda y: (y is not None, y)):
        inside = [s - before for s in starts if before <= s < before + per[year]]
        if inside:
            ranks += [ranked_before + s + 1 for s in inside]
            years.append(year)
            ranked_before += per[year]
        before += per[year]
    near = F.col(first).isin([y for y in years if y is not None])
    if None in years:
        near = near | F.col(first).isNull()
    ranked = global_row_number(df.where(near).select(*order_cols), list(order_cols))
    bounds = ranked.where(F.col("_rn").isin(ranks)).orderBy("_rn").collect()
    key = F.struct(*[F.col(c) for c in order_cols])
    expr = F.lit(-1)
    for i, b in enumerate(bounds):
        lit = F.struct(*[F.lit(b[c]).cast(df.schema[c].dataType).alias(c) for c in order_cols])
        expr = F.when(key >= lit, F.lit(i)).otherwise(expr)
    return df.withColumn(fold_col, expr.cast("int"))


# ----------------------------------------------------------------------------- A12 - A14
def regression_metrics(df: DataFrame, actual: str = "actual", predicted: str = "predicted",
                       group_cols=()) -> DataFrame:
    """R2, RMSE, MAE and relative error (RMSE / mean(actual) x 100) per group, one pass."""
    err = F.col(predicted) - F.col(actual)
    agg = df.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(err * err).alias("_sse"),
        F.avg(F.abs(err)).alias("mae"),
        F.var_pop(actual).alias("_var"),
        F.avg(actual).alias("mean_actual"),
    )
    rmse = F.sqrt(F.col("_sse") / F.col("n"))
    return agg.select(
        *group_cols, "n",
        (F.lit(1.0) - F.try_divide(F.col("_sse"), F.col("_var") * F.col("n"))).alias("r2"),
        rmse.alias("rmse"), "mae",
        (F.try_divide(rmse, F.col("mean_actual")) * F.lit(100.0)).alias("relative_error_pct"))


def cv_summary(fold_metrics: DataFrame, group: str = "model", metric: str = "r2") -> DataFrame:
    """Mean and population std of a per-fold metric (numpy ``std``)."""
    return fold_metrics.groupBy(group).agg(
        F.avg(metric).alias(f"cv_{metric}_mean"), F.stddev_pop(metric).alias(f"cv_{metric}_std"),
        F.count(F.lit(1)).alias("folds"))


def best_model(metrics: DataFrame, name: str = "model", metric: str = "r2") -> DataFrame:
    return metrics.agg(F.max_by(name, metric).alias("best_model"),
                       F.max(metric).alias(f"best_{metric}"))


def error_report(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Signed error and error % of actual, rounded half-even to 1 digit."""
    from ..functions.numeric import round_half_even
    err = F.col(predicted) - F.col(actual)
    return df.withColumns({
        "error": round_half_even(err, 1),
        "error_pct": round_half_even(F.try_divide(err, F.col(actual)) * F.lit(100.0), 1),
    })


def simple_ols(df: DataFrame, x: str, y: str) -> DataFrame:
    """Closed-form one-feature least squares (slope, intercept, r2)."""
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
                  F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))


def top_k_importance(wide: DataFrame, features, k: int = 10) -> DataFrame:
    """One-row table of per-feature importances -> long form, sorted descending
    (feature name breaks ties), top ``k`` with their rank."""
    from pyspark.sql import Window
    long = wide.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("importance"))
        for f in features])).alias("_s")).select("_s.feature", "_s.importance")
    top = long.orderBy(F.desc_nulls_last("importance"), "feature").limit(k)
    w = Window.orderBy(F.desc_nulls_last("importance"), "feature")
    return top.withColumn("rank", F.row_number().over(w).cast("int"))


def sample_about_n(df: DataFrame, n: int, total: int, key_cols) -> DataFrame:
    """Deterministic sample of about ``n`` of ``total`` rows: keep a row when the md5 bucket of
    its key (32 bits) falls below ``n / total`` of the range. A plain distributed filter - no
    top-n merge in one task, so it suits large ``n`` on many partitions."""
    if total <= n:
        return df
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in key_cols])
    bucket = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")
    return df.where(bucket < F.lit(int((n / total) * 2 ** 32)))


def approx_column_quantiles(df: DataFrame, columns, probs, accuracy: int = 100_000) -> dict:
    """Per-column quantiles from mergeable sketches (``percentile_approx``; rank error about
    1/accuracy) in ONE aggregate - the choice for very large training tables, where the exact
    path would sort columns x rows values. Returns {column: [q for q in probs]}."""
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), [float(p) for p in probs],
                                       accuracy).alias(c) for c in columns]).first()
    return {c: list(row[c]) if row[c] is not None else [None] * len(probs) for c in columns}
