"""Exact ranks and quantiles without collecting a group into one task.

``percentile`` (exact) keeps a value->count map per group and merges all maps of a group in
one reducer; ``row_number() over (partition by g order by v)`` sorts a whole group in one
task. With one group holding a third of the rows both break at scale. Instead:

1. ``running_total``: range-partition + sort on the order columns, sum a weight inside each
   partition, and add the total of all earlier partitions (one number per partition reaches the
   driver). The sorted narrow table is checkpointed into the shared folder, so its totals and its
   rows see the same partitioning and a lost executor does not re-sort with different bounds.
2. ``group_quantiles``: count rows by (group, value) first, so a value that many rows share is one
   row; a running total over the counts gives the ranks each value covers, and a quantile is read
   from the one or two values that cover its ranks (numpy's ``linear`` method, as pandas
   ``quantile``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROW_BITS = (1 << 33) - 1   # of monotonically_increasing_id, the place within a partition


def running_total(df: DataFrame, order_cols, weight: str | None = None,
                  name: str = "_before") -> DataFrame:
    """Add ``name``: the sum of ``weight`` (default: one a row) over all rows that sort earlier.
    Pass a narrow projection: every column is carried through the sort."""
    spark = df.sparkSession
    placed = (df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")),
                                    *order_cols)
              .sortWithinPartitions(*order_cols).checkpoint(eager=True)
              .withColumns({"_pid": F.spark_partition_id(),
                            "_row": F.monotonically_increasing_id().bitwiseAND(F.lit(ROW_BITS))}))
    amount = F.lit(1) if weight is None else F.col(weight)
    totals = {r[0]: r[1] for r in placed.groupBy("_pid").agg(F.sum(amount)).collect()}
    offsets, total = [], 0
    for pid in range(max(totals, default=-1) + 1):
        offsets.append(total)
        total += totals.get(pid, 0)
    offset = F.element_at(F.array(*[F.lit(v).cast("long") for v in offsets or [0]]),
                          F.col("_pid") + 1)
    if weight is None:
        inside = F.col("_row")
    else:
        earlier = (Window.partitionBy("_pid").orderBy("_row")
                   .rowsBetween(Window.unboundedPreceding, -1))
        inside = F.coalesce(F.sum(weight).over(earlier), F.lit(0))
    return placed.withColumn(name, (offset + inside).cast("long")).drop("_pid", "_row")


def global_row_number(df: DataFrame, order_cols, name: str = "_rn") -> DataFrame:
    """1-based row number in ``order_cols`` order over the whole DataFrame. The input position is
    the last sort key, so a run of identical keys is still split across range partitions."""
    numbered = running_total(df.withColumn("_tb", F.monotonically_increasing_id()),
                             [*order_cols, "_tb"], name="_b")
    return numbered.withColumn(name, F.col("_b") + 1).drop("_tb", "_b")


def _lerp(a: Column, b: Column, t: Column) -> Column:
    """numpy's linear interpolation (``a + t(b-a)``, mirrored for t >= 0.5)."""
    d = b - a
    return F.when(t >= F.lit(0.5), b - d * (F.lit(1.0) - t)).otherwise(a + d * t)


def counted_quantiles(counts: DataFrame, group_cols, value: str, count: str, probs) -> DataFrame:
    """Quantiles per group of a table that holds one row per (group, value) with its row count.
    Returns the group columns, ``rows``, ``n`` (non-null values) and ``q_<p>`` per probability."""
    group_cols = list(group_cols)
    probs = [float(p) for p in probs]
    keys = [f"_g{i}" for i in range(max(len(group_cols), 1))]
    source = [F.col(c) for c in group_cols] or [F.lit(0)]
    placed = running_total(
        counts.select(*[c.alias(k) for c, k in zip(source, keys)], F.col(value).alias("_v"),
                      F.col(count).alias("_n")), [*keys, "_v"], "_n")
    has = F.col("_v").isNotNull()
    stats = placed.groupBy(*keys).agg(
        F.sum("_n").alias("rows"), F.coalesce(F.sum(F.when(has, F.col("_n"))), F.lit(0)).alias("n"),
        F.min(F.when(has, F.col("_before"))).alias("_start"))
    side = stats.select(*[F.col(k).alias(f"_s{k}") for k in keys], "n", "_start")
    joined = placed.where(has).join(side, [F.col(k).eqNullSafe(F.col(f"_s{k}")) for k in keys])
    first = F.col("_before") - F.col("_start")
    picks = []
    for i, p in enumerate(probs):
        position = (F.col("n") - 1).cast("double") * F.lit(p)
        low = F.floor(position)
        high = low + (position > low).cast("int")
        for name, rank in (("a", low), ("b", high)):
            covers = (first <= rank) & (rank < first + F.col("_n"))
            picks.append(F.max(F.when(covers, F.col("_v"))).alias(f"_{name}{i}"))
    read = joined.groupBy(*[F.col(f"_s{k}") for k in keys]).agg(*picks)
    out = stats.join(read, [F.col(k).eqNullSafe(F.col(f"_s{k}")) for k in keys], "left")
    quantiles = []
    for i, p in enumerate(probs):
        position = (F.col("n") - 1).cast("double") * F.lit(p)
        t = position - F.floor(position)
        quantiles.append(F.when(t == 0, F.col(f"_a{i}")).otherwise(
            _lerp(F.col(f"_a{i}"), F.col(f"_b{i}"), t)).alias(f"q_{p}"))
    return out.select(*[F.col(k).alias(c) for k, c in zip(keys, group_cols)], "rows", "n",
                      *quantiles)


def group_quantiles(df: DataFrame, group_cols, value: str, probs) -> DataFrame:
    """Exact linear-interpolated quantiles of ``value`` per group (nulls ignored): one row per
    group with the group columns, ``rows`` (all rows), ``n`` (non-null values) and one column
    ``q_<p>`` per probability (e.g. ``q_0.25``)."""
    group_cols = list(group_cols)
    counts = (df.select(*group_cols, F.col(value).cast("double").alias("_value"))
              .groupBy(*group_cols, "_value").agg(F.count(F.lit(1)).alias("_count")))
    return counted_quantiles(counts, group_cols, "_value", "_count", probs)
