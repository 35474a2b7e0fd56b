"""Stand-in views over the benchmark tables.

The benchmark tables carry no energy or weather data, so each query in the registry first
derives the inputs our operators expect from them. The derivations use only exact integer or
single-step IEEE arithmetic so that an independent SQL engine derives bit-identical inputs.
The same derivations exist as SQL text in ``loadcast.catalog_sql`` (written separately, on
purpose: it is the oracle).

* ``energy_area``   <- lineitem x supplier x nation (one row per area-company-year)
* ``weather_raw``   <- orders (daily station rows, KNMI units = tenths)
* ``score_request`` <- events (incoming scoring requests)
* ``model_score``   <- lineitem (actual vs predicted per model and fold)

Work grows with the tables: every view is a projection of a full scan (plus joins against the
supplier/nation dimensions), no row is dropped or sampled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TYPE_CYCLE = ["1x25", "1x35", "3x25", "3x35", "3x50", "3x63", "3x80"]
STATION_CYCLE = ["240", "260", "330", "370", "391"]
EVENT_HOUSE_TYPE = {"click": "1x25", "view": "3x25", "signup": "3x35", "purchase": "3x50"}
SCENARIO_CYCLE = ["cold", "NORMAL", "warm", "extreme"]
COMPANY_CYCLE = ["liander", "enexis", "STEDIN", "unknown"]
ROWS_A_TASK = 2_000_000     # of the line items that a task of the supplier join reads
MODEL_CYCLE = ["Linear Regression", "Ridge Regression", "Lasso Regression", "Random Forest"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _arr(values):
    return F.array(*[F.lit(v) for v in values])


def _nz(c):
    """-0.0 -> 0.0 (IEEE: -0.0 + 0.0 = +0.0)."""
    return c + F.lit(0.0)


def _dealt(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt by ``key`` for a join, where the session's shuffle partitions would hold more
    than ``ROWS_A_TASK`` rows each. The rows are counted from the files' footers."""
    parts = -(-df.count() // ROWS_A_TASK)
    few = parts <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df if few else df.repartition(parts, key)


def energy_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _dealt(read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax", "l_shipdate"), "l_suppkey")
    base = sf_dir.rstrip("/")
    sup = spark.read.parquet(f"{base}/supplier.parquet").select("s_suppkey", "s_name", "s_nationkey")
    nat = spark.read.parquet(f"{base}/nation.parquet").select("n_nationkey", "n_name")
    # nation is a fixed 25-row table; the supplier dimension grows with the data, so its join is
    # left to Spark
    dim = sup.join(F.broadcast(nat), sup.s_nationkey == nat.n_nationkey) \
        .select("s_suppkey", "s_name", "n_name")
    df = li.join(dim, li.l_suppkey == dim.s_suppkey)
    year = F.year("l_shipdate").cast("int")
    company = F.col("n_name")
    return df.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        (F.col("l_extendedprice") / F.lit(8.0)).alias("annual_consume"),
        F.when(F.col("l_quantity") != F.lit(13.0), F.col("l_quantity")).alias("num_connections"),
        F.when(F.col("l_partkey") % 53 != 0,
               F.element_at(_arr(TYPE_CYCLE), F.col("l_linenumber"))).alias("type_of_connection"),
        _nz(F.lit(100.0) - F.lit(1000.0) * F.col("l_discount")).alias("perc_of_active_connections"),
        F.when(F.col("l_orderkey") % 41 != 0, _nz(F.lit(1000.0) * F.col("l_tax")))
         .alias("smartmeter_perc"),
        _nz(F.lit(100.0) - F.lit(100.0) * F.col("l_tax")).alias("delivery_perc"),
        F.when(F.col("l_suppkey") % 37 != 36,
               (F.lit(1000) + (F.col("l_suppkey") * 89) % 9000).cast("string")).alias("zipcode_from"),
        F.col("s_name").alias("city"),
        company.alias("company"),
        F.lit("electricity").alias("energy_type"),
        year.alias("year"),
        F.concat(F.lower(F.translate(company, " _", "--")), F.lit("_electricity_"),
                 F.when(F.col("l_suppkey") % 2 == 1, F.lit("0101")).otherwise(F.lit("")),
                 year.cast("string"), F.lit(".csv")).alias("source_file"),
    )


def weather_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weather_raw_from(read_table(spark, sf_dir, "orders"))


def weather_raw_from(orders: DataFrame) -> DataFrame:
    """Works on a batch or a streaming ``orders`` DataFrame."""
    o = orders.select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    tg = (F.col("o_custkey") % 250).cast("double")
    return o.select(
        F.col("o_orderkey").alias("obs_id"),
        F.element_at(_arr(STATION_CYCLE),
                     F.substring("o_orderpriority", 1, 1).cast("int")).alias("STN"),
        F.date_format("o_orderdate", "yyyyMMdd").alias("YYYYMMDD"),
        tg.alias("TG"),
        (tg - F.lit(40.0)).alias("TN"),
        (tg + F.lit(40.0)).alias("TX"),
        F.when(F.col("o_orderkey") % 97 != 0, (F.col("o_orderkey") % 80).cast("double")).alias("RH"),
        (F.col("o_orderkey") % 120).cast("double").alias("DR"),
        (F.col("o_custkey") % 90).cast("double").alias("FG"),
        (F.col("o_orderkey") % 3000).cast("double").alias("Q"),
    )


def score_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_request_from(read_table(spark, sf_dir, "events"))


def score_request_from(e: DataFrame) -> DataFrame:
    """Works on a batch or a streaming ``events`` DataFrame."""
    ht = F.col("event_type")
    house = None
    for k, v in EVENT_HOUSE_TYPE.items():
        house = F.when(ht == k, v) if house is None else house.when(ht == k, v)
    house = house.otherwise(F.when(F.col("event_id") % 2 == 0, F.lit("3X25")).otherwise("bad"))
    uid = F.col("user_id")
    return e.select(
        F.col("event_id").alias("request_id"),
        F.col("ts"),
        F.when(uid % 25 != 0, uid.cast("string")).alias("postal_code"),
        F.when(uid % 3 == 1, F.lit("Amsterdam")).when(uid % 3 == 2, F.lit("rotterdam"))
         .alias("city"),
        house.alias("house_type"),
        F.get_json_object("props", "$.k").cast("int").alias("num_connections"),
        F.col("value").alias("active_connections_pct"),
        (F.col("event_id") % 2 == 0).alias("smart_meter"),
        F.element_at(_arr(COMPANY_CYCLE), (uid % 4 + 1).cast("int")).alias("energy_company"),
        F.element_at(_arr(SCENARIO_CYCLE), (F.col("event_id") % 4 + 1).cast("int"))
         .alias("weather_scenario"),
    )


def model_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    m = (F.col("l_suppkey") % 4).cast("int")
    actual = F.col("l_extendedprice") / F.lit(8.0)
    noise = ((F.col("l_orderkey") + F.col("l_linenumber")) % 21 - 10).cast("double") \
        * (m + 1).cast("double") / F.lit(100.0)
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.element_at(_arr(MODEL_CYCLE), m + 1).alias("model"),
        (F.col("l_partkey") % 3).cast("int").alias("fold"),
        actual.alias("actual"),
        (actual * (F.lit(1.0) + noise)).alias("predicted"),
    )


# ------------------------------------------------------------------------------ files
def energy_csv_files(spark: SparkSession, sf_dir: str, directory: str) -> dict[str, str]:
    """The area rows as CSV files named as the sources expect, in one folder per energy type
    (odd line numbers are electricity, even ones gas). Gas files have another column order and
    no smart meters. Returns the folders by type."""
    area = energy_area(spark, sf_dir)
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    columns = {
        "electricity": [*keys, "city", "zipcode_from", "type_of_connection", "num_connections",
                        "annual_consume", "perc_of_active_connections", "smartmeter_perc",
                        "delivery_perc"],
        "gas": ["annual_consume", "delivery_perc", *keys, "type_of_connection", "zipcode_from",
                "perc_of_active_connections", "city", "num_connections"],
    }
    jvm = spark._jvm
    folders = {}
    for odd, kind in ((1, "electricity"), (0, "gas")):
        name = F.replace("source_file", F.lit("_electricity_"), F.lit(f"_{kind}_"))
        written = f"{directory}/{kind}-by-name"
        (area.where(F.col("l_linenumber") % 2 == odd).select(*columns[kind], name.alias("name"))
         .repartition("name").write.partitionBy("name").option("header", True).csv(written))
        folders[kind] = f"{directory}/{kind}"
        target = jvm.org.apache.hadoop.fs.Path(folders[kind])
        fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(target)
        for entry in fs.listStatus(jvm.org.apache.hadoop.fs.Path(written)):
            file_name = entry.getPath().getName().partition("=")[2]
            if file_name:
                part = next(p.getPath() for p in fs.listStatus(entry.getPath())
                            if p.getPath().getName().startswith("part-"))
                fs.rename(part, jvm.org.apache.hadoop.fs.Path(target, file_name))
    return folders


def station_text_files(spark: SparkSession, sf_dir: str, path: str) -> None:
    """The daily rows as station text: comment lines, space-padded fields, blanks for what was
    not measured."""
    from ..functions import constants as K
    raw = weather_raw(spark, sf_dir)
    fields = [F.lpad(F.coalesce(F.col(v).cast("bigint").cast("string"), F.lit("")), 6, " ")
              for v in K.WEATHER_VARIABLES]
    lines = raw.select(F.concat(F.lit("  "), F.concat_ws(",", "STN", "YYYYMMDD", *fields))
                       .alias("value"))
    head = spark.createDataFrame([("# daily values",), ("# STN,YYYYMMDD,"
                                                        + ",".join(K.WEATHER_VARIABLES),)],
                                 "value string")
    head.unionByName(lines).write.text(path)
