"""Helpers shared by the operators: slim inputs, global positions, connected components."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import running_total

STORED_EACH = 50_000          # rows of a stored file, where more files would be smaller


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def partitions_for(spark: SparkSession, rows: int, rows_each: int) -> int:
    """Partitions that hold at most ``rows_each`` evenly dealt rows, never fewer than the
    session's shuffle partitions."""
    return max(shuffle_partitions(spark), -(-rows // rows_each))


def spark_cores(spark: SparkSession) -> int:
    return spark.sparkContext.defaultParallelism


def stored(df: DataFrame, rows: int) -> DataFrame:
    """``df`` checkpointed, by as many tasks as ``rows`` rows (at least its own) need or the
    cluster has cores. Every shuffle partition would write a file of its own otherwise, and for
    each a local file system without Hadoop's native code starts a process to set its mode, a
    moment's second copy of the executor to whoever adds up its processes' memory."""
    tasks = max(spark_cores(df.sparkSession), -(-rows // STORED_EACH))
    return df.coalesce(tasks).checkpoint()


def returning_memory(batches):
    """``batches`` of a task. What earlier ones took goes back to the system, as Arrow's pool keeps
    it otherwise for as long as the Python worker lives, beside the next steps' tables."""
    pool = pa.default_memory_pool()
    pool.release_unused()
    for b in batches:
        yield b
        del b
        pool.release_unused()


def with_running_total(df: DataFrame, order_cols: list[str], weight: str | None = None,
                       name: str = "before") -> DataFrame:
    """Add ``name``: the sum of ``weight`` (default: 1 a row) over all rows that sort earlier.
    ``df`` should be narrow: it is written once."""
    return running_total(df, order_cols, weight, name)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b): component is the smallest
    node reachable. Alternates large-star and small-star steps (each links a node's neighbours
    to its smallest one) until nothing changes; rounds grow with the logarithm of the longest
    path. Every round is checkpointed; a node's minimum is checkpointed before it is joined
    back, so that Spark can split the rows of a node with very many links.
    """
    a, b = F.col("a"), F.col("b")
    links = (edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
             .distinct().checkpoint())
    state = None
    while True:
        seen = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state or seen[0] == 0:
            break
        state, ends = seen, 2 * seen[0]
        both = links.unionByName(links.select(b.alias("a"), a.alias("b")))
        least = stored(both.groupBy("a").agg(F.min("b").alias("m"))
                       .select("a", F.least("a", "m").alias("m")), ends)
        large = stored(both.join(least, "a").where(b > a)
                       .select(b.alias("a"), F.col("m").alias("b"))
                       .where(a != b).distinct(), ends)
        least = stored(large.groupBy("a").agg(F.min("b").alias("m")), ends)
        links = stored(large.join(least, "a").where(b != F.col("m"))
                       .select(b.alias("a"), F.col("m").alias("b"))
                       .unionByName(least.select("a", F.col("m").alias("b")))
                       .distinct(), ends)
    return (links.select(a.alias("node"), b.alias("component"))
            .unionByName(links.select(b.alias("node"), b.alias("component")).distinct()))
