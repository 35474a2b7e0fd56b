"""Quantiles that can be stored and merged (A6/A7/M4 beyond one table).

A sketch (KLL) of each column and year is a few kilobytes. Years are sketched where they are read,
stored by year, and merged for any set of years without reading their rows again: a new year costs
its own rows only. A quantile read from a merged sketch has a rank within ``rank_error`` of the
asked one (99 % confidence), however many sketches were merged; the exact quantiles of
``operators.ranking`` stay the default.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SKETCH_K = 4096


def rank_error(k: int = SKETCH_K) -> float:
    """The share of all rows by which a quantile's rank may be off (the sketch's published
    bound for one quantile)."""
    return 2.296 / k ** 0.9021


def sketch_columns(df: DataFrame, columns, by: str = "year", k: int = SKETCH_K) -> DataFrame:
    """(by, column, n, sketch): a sketch of the values of each column for each value of ``by``;
    nulls are not counted. One pass, partial sketches are merged on the way."""
    value = {c: F.col(c).cast("double") for c in columns}
    wide = df.groupBy(by).agg(
        *[F.kll_sketch_agg_double(v, F.lit(k)).alias(f"s{i}")
          for i, v in enumerate(value.values())],
        *[F.count(v).alias(f"n{i}") for i, v in enumerate(value.values())])
    return wide.select(by, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n"), F.col(f"s{i}")
                 .alias("sketch")) for i, c in enumerate(columns)])).alias("_s")) \
        .select(by, "_s.*").where("n > 0")


def store_sketches(sketches: DataFrame, path: str, by: str = "year") -> None:
    """Write sketches by ``by``; values that are already stored are replaced, others stay."""
    (sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(by).parquet(path))


def load_sketches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def merged_quantiles(sketches: DataFrame, probs) -> DataFrame:
    """(column, n, q_<p> ...): quantiles over all rows that the given sketches saw."""
    merged = sketches.groupBy("column").agg(F.sum("n").alias("n"),
                                            F.kll_merge_agg_double("sketch").alias("_m"))
    return merged.select("column", "n", *[
        F.kll_sketch_get_quantile_double("_m", F.lit(float(p))).alias(f"q_{float(p)}")
        for p in probs])


def medians(sketches: DataFrame) -> dict[str, float]:
    """Median of each column (see ``ml_prep.fit_medians``)."""
    return {r["column"]: r["q_0.5"] for r in merged_quantiles(sketches, [0.5]).collect()}


def robust_scaler(sketches: DataFrame) -> dict[str, tuple[float, float]]:
    """(median, IQR) of each column, an IQR of zero is 1 (see ``ml_prep.fit_robust_scaler``)."""
    return {r["column"]: (r["q_0.5"], (r["q_0.75"] - r["q_0.25"]) or 1.0)
            for r in merged_quantiles(sketches, [0.25, 0.5, 0.75]).collect()}


def ranks(df: DataFrame, values: dict[tuple[str, float], float]) -> dict:
    """For each (column, prob) -> value the shares of the column's rows below the value and not
    above it: the asked rank lies between them if the value is that quantile. One pass."""
    keys = list(values)
    row = df.agg(*[F.count_if(F.col(c) < F.lit(values[c, p])).alias(f"b{i}")
                   for i, (c, p) in enumerate(keys)],
                 *[F.count_if(F.col(c) <= F.lit(values[c, p])).alias(f"u{i}")
                   for i, (c, p) in enumerate(keys)],
                 *[F.count(c).alias(f"n{i}") for i, (c, p) in enumerate(keys)]).first()
    return {key: (row[f"b{i}"] / row[f"n{i}"], row[f"u{i}"] / row[f"n{i}"])
            for i, key in enumerate(keys)}
