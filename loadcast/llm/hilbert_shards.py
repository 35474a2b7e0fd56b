"""Sharding along a Hilbert curve.

Every row becomes a point: each chosen metadata column is quantised into ``2**bits`` levels of
near-equal row counts (exact cuts over all rows). Rows are ordered by their point's index on the
Hilbert curve and the order is cut into ``n_shards`` runs whose row counts differ by one at most
(law ``rows``). Neighbouring rows share ranges in all dimensions at once, so per-file minima and
maxima prune files for a filter on any of them.

Defined cases: a null in a dimension takes level 0; a null text has no bytes (size 1, CRC of the
empty string); equal rows follow each other in any order; null ids sort first; an empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .common import with_running_total


def hilbert_index(levels: np.ndarray, bits: int) -> np.ndarray:
    """Curve index of integer points (one row each): the Gray-code form of the curve, worked
    from the highest bit down (Skilling, 2004)."""
    x = levels.astype(np.int64).copy()
    n, dims = x.shape
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        low = q - 1
        for d in range(dims):
            high = (x[:, d] & q) != 0
            swap = np.where(high, 0, (x[:, 0] ^ x[:, d]) & low)
            x[:, 0] ^= np.where(high, low, swap)
            x[:, d] ^= swap
    for d in range(1, dims):
        x[:, d] ^= x[:, d - 1]
    turn = np.zeros(n, np.int64)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        turn ^= np.where((x[:, -1] & q) != 0, q - 1, 0)
    x ^= turn[:, None]
    index = np.zeros(n, np.int64)
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            index = (index << 1) | ((x[:, d] >> b) & 1)
    return index


def level_cuts(df: DataFrame, dims: list[str], levels: int) -> dict[str, list]:
    """For each column the smallest value of every level but the first, over all rows.

    Columns are counted by value first, so a value that many rows share costs one row. At most
    ``levels`` values a column reach the driver.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    counted = None
    for k, d in enumerate(dims):
        number = isinstance(kinds[d], NumericType)
        one = (df.groupBy(F.col(d).alias("v")).count().select(
            F.lit(k).alias("dim"),
            (F.col("v").cast("double") if number else F.lit(None).cast("double")).alias("num"),
            (F.lit(None).cast("string") if number else F.col("v").cast("string")).alias("txt"),
            "count"))
        counted = one if counted is None else counted.unionByName(one)
    placed = with_running_total(counted, ["dim", "num", "txt"], "count")
    rows = df.count()
    level = F.floor((F.col("before") - F.col("dim") * F.lit(rows)) * F.lit(levels)
                    / F.lit(max(rows, 1)))
    first = (placed.where("num is not null or txt is not null")
             .groupBy("dim", level.alias("level"))
             .agg(F.min("num").alias("num"), F.min("txt").alias("txt")).collect())
    cuts: dict[str, list] = {d: [] for d in dims}
    for r in sorted(first, key=lambda r: (r["dim"], r["level"])):
        if r["level"] > 0:
            cuts[dims[r["dim"]]].append(r["num"] if r["txt"] is None else r["txt"])
    return cuts


def level_of(column: Column, cuts: list) -> Column:
    """Number of cuts at or below the value; 0 for null."""
    out = F.lit(0)
    for c in cuts:
        out = out + F.when(column >= F.lit(c), 1).otherwise(0)
    return out


def hilbert_order(df: DataFrame, dims: list[str], bits: int = 5) -> DataFrame:
    """Add ``hilbert`` (long) to ``df``, the index of its point over the columns ``dims``."""
    cuts = level_cuts(df.select(*dims), dims, 1 << bits)

    @F.pandas_udf("long")
    def curve(points: pd.Series) -> pd.Series:
        grid = np.stack(points.to_numpy()) if len(points) else np.zeros((0, len(dims)), int)
        return pd.Series(hilbert_index(grid, bits))

    point = F.array(*[level_of(F.col(d), cuts[d]).cast("int") for d in dims])
    return df.withColumn("hilbert", curve(point))


def shard_runs(ordered: DataFrame, order_cols: list[str], n_shards: int) -> DataFrame:
    """Cut the order into ``n_shards`` runs of near-equal row counts: adds shard and slot."""
    placed = with_running_total(ordered, order_cols, name="place")
    rows = placed.count()
    shard = F.floor(((F.col("place") + 1) * n_shards - 1) / F.lit(max(rows, 1)))
    start = F.floor(F.col("shard") * F.lit(rows) / F.lit(n_shards))
    return (placed.withColumn("shard", shard.cast("int"))
            .withColumn("slot", (F.col("place") - start).cast("long")).drop("place"))


def shard_documents(docs: DataFrame, n_shards: int = 16, dims: tuple[str, ...] =
                    ("lang", "source", "size"), bits: int = 5) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, hilbert and the dimensions) of every document.

    ``size`` is the text's UTF-8 bytes plus 1 and may be used as a dimension.
    """
    own = [d for d in dims if d != "size"]
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", *own,
                       (F.octet_length(text).cast("long") + 1).alias("size"),
                       F.crc32(text).alias("text_crc32")).checkpoint()
    return shard_runs(hilbert_order(slim, list(dims), bits),
                      ["hilbert", "text_crc32", "doc_id"], n_shards)


def write_shards(docs: DataFrame, path: str, n_shards: int = 16,
                 dims: tuple[str, ...] = ("lang", "source", "size"), bits: int = 5) -> DataFrame:
    """Write whole documents as one Parquet folder a shard and return the manifest: per shard
    its rows and the minimum and maximum of each dimension, for pruning. Documents meet their
    shard on (doc_id, text CRC, size, dimensions), null-safe; rows that agree in all of them
    are dealt by their own count among equals."""
    from pyspark.sql import Window
    own = [d for d in dims if d != "size"]
    placed = shard_documents(docs, n_shards, dims, bits)
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = ["doc_id", *own, "size", "text_crc32"]
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(1)))
    left = docs.withColumns({"size": F.octet_length(text).cast("long") + 1,
                             "text_crc32": F.crc32(text)}).withColumn("_llm_nth", nth)
    right = placed.withColumn("_llm_nth", nth).select(
        *[F.col(k).alias(f"_llm_{k}") for k in keys], F.col("_llm_nth").alias("_llm_n"),
        F.col("shard").alias("_llm_shard"), F.col("slot").alias("_llm_slot"))
    on = [F.col(k).eqNullSafe(F.col(f"_llm_{k}")) for k in keys]
    whole = left.join(right, [*on, F.col("_llm_nth") == F.col("_llm_n")])
    (whole.select(*docs.columns, F.col("_llm_shard").alias("shard"), "_llm_slot")
     .repartitionByRange(n_shards, "shard").sortWithinPartitions("shard", "_llm_slot")
     .drop("_llm_slot").write.partitionBy("shard").parquet(path))
    limits = [f(F.col(d)).alias(f"{n}_{d}") for d in dims for n, f in (("min", F.min),
                                                                       ("max", F.max))]
    return placed.groupBy("shard").agg(F.count("*").alias("rows"), *limits)
