"""Stand-in views: their joins are dealt by how many rows there are."""

from pyspark.sql import functions as F

from loadcast.sources import standins as S


def test_line_items_are_joined_in_tasks_of_bounded_rows(spark, tmpdir_path, monkeypatch):
    """A null or repeated key changes nothing, and no row is lost."""
    spark.range(3000).select(
        F.when(F.col("id") % 50 != 0, F.col("id")).alias("l_orderkey"),
        F.lit(1).cast("long").alias("l_partkey"),
        F.when(F.col("id") % 90 != 0, F.col("id") % 70).alias("l_suppkey"),
        F.lit(1).alias("l_linenumber"), F.col("id").cast("double").alias("l_quantity"),
        F.lit(8.0).alias("l_extendedprice"), F.lit(0.05).alias("l_discount"),
        F.lit(0.02).alias("l_tax"), F.lit("1996-03-04").cast("timestamp").alias("l_shipdate"),
    ).write.parquet(f"{tmpdir_path}/lineitem.parquet")
    spark.range(60).select(F.col("id").alias("s_suppkey"), F.lit("s").alias("s_name"),
                           F.lit(0).alias("s_nationkey")) \
        .write.parquet(f"{tmpdir_path}/supplier.parquet")
    spark.range(1).select(F.lit(0).alias("n_nationkey"), F.lit("N").alias("n_name")) \
        .write.parquet(f"{tmpdir_path}/nation.parquet")
    whole = S.energy_area(spark, tmpdir_path)
    monkeypatch.setattr(S, "ROWS_A_TASK", 30)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        dealt = S.energy_area(spark, tmpdir_path)
        per_task = dealt.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert dealt.rdd.getNumPartitions() >= 100 and per_task < 500
        assert sorted(map(str, dealt.collect())) == sorted(map(str, whole.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_rows_of_the_grid_search_are_stored_before_they_are_filtered(spark):
    """Neither the readers nor the null filter compute the features again."""
    from conftest import SF_SMALL
    from loadcast.catalog import _scaled_rows
    rows = _scaled_rows(spark, SF_SMALL)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" in plan and "parquet" not in plan
    assert rows.where("household_consumption is null or x is null").count() == 0
