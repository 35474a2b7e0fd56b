"""Join helpers. Spark picks the join from the sides' sizes (``autoBroadcastJoinThreshold``, AQE);
only sides whose size is bounded by construction carry a hint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def literal_dim(spark: SparkSession, rows, schema) -> DataFrame:
    """A dimension built from fixed values: its size is known by construction, so it is
    always safe to broadcast."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def join_by_year(big: DataFrame, yearly: DataFrame, how: str = "inner") -> DataFrame:
    """Join with a table that holds one row per calendar year. The number of years bounds its
    size whatever the data, so it is broadcast and the fact side is never shuffled."""
    return big.join(F.broadcast(yearly), "year", how)


def broadcast_bytes(spark: SparkSession) -> int:
    """The session's own limit for a broadcast side (-1: never)."""
    text = spark.conf.get("spark.sql.autoBroadcastJoinThreshold").strip().lower().rstrip("b")
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    return int(text[:-1]) * units[text[-1]] if text[-1] in units else int(text)
