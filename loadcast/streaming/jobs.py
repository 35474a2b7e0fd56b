"""Structured Streaming versions of request scoring (ST1) and station-year weather (ST2).

ST1 is stateless: each micro-batch is validated, defaulted, featurised and scored with the
same functions as the batch path, then written to the scored table and the quarantine table
in ``foreachBatch``. Each batch overwrites its own ``batch_id`` partition, so a batch that is
replayed after a failure replaces its earlier partial output (idempotent sink).

ST2 keeps the readings themselves: every batch appends its readings, one per reading key, to a log
partitioned by batch, station and year. The station-years that a batch touches are aggregated
anew from their log, in which a later batch's reading takes the place of an earlier one: a day
that is delivered twice counts once, and a corrected day takes back what it had added. A batch
writes the changed rows only, as a new version that counts once Spark has written its
``_SUCCESS`` marker; every ``SNAPSHOT_EVERY`` batches a version holds the whole table, and versions
before the last snapshot but one are deleted. Whatever a batch writes it overwrites when it is
replayed, from the log of earlier batches alone. Readers take each row from its newest version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from ..operators import scoring as SC
from ..operators import weather as W
from ..sources import storage

SNAPSHOT_EVERY = 32


def _write_partitioned(df: DataFrame, path: str, batch_id: int) -> None:
    (df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path))


# ----------------------------------------------------------------------------- ST1
def score_request_stream(requests: DataFrame, out_path: str, quarantine_path: str,
                         checkpoint: str, package: dict | None = None,
                         available_now: bool = True):
    """Start the scoring stream over a streaming request DataFrame. Returns the query."""
    def per_batch(batch: DataFrame, batch_id: int) -> None:
        # both sinks read the validated batch: keep it for this batch only (a lost block is
        # recomputed from the micro-batch's source offsets, which are fixed for the batch)
        checked = SC.validate(batch).persist()
        try:
            valid, bad = SC.split_valid(checked)
            inputs = SC.to_model_input(valid)
            if package is None:
                scored, model_used = SC.rule_baseline(inputs), "Rule Baseline"
            else:
                from ..plans.package import score_inputs
                scored, model_used = score_inputs(package, inputs), package["model_name"]
            _write_partitioned(SC.response(scored, model_used), out_path, batch_id)
            _write_partitioned(bad.withColumn("errors", F.array_join("errors", "; ")),
                               quarantine_path, batch_id)
        finally:
            checked.unpersist()

    w = requests.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


# ----------------------------------------------------------------------------- ST2
def _latest(rows: DataFrame, key, order: Column) -> DataFrame:
    """One row per key (null-safe), the one with the highest ``order``."""
    rest = [c for c in rows.columns if c not in key]
    newest = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return newest.select(*key, "_r.*")


def station_year_stream(daily_raw: DataFrame, table_path: str, checkpoint: str,
                        reading_key=None, order_by: str | None = None,
                        available_now: bool = True):
    """Station-year aggregates of a stream of raw daily rows. Rows with an equal
    ``reading_key`` (by default all columns that are not measured) are one reading: of several in
    a batch the one with the highest ``order_by`` counts (without it, the highest values), and a
    later batch replaces an earlier one."""
    key, log = reading_key, f"{table_path.rstrip('/')}/readings"
    if key is None:
        key = [c for c in daily_raw.columns if c not in K.WEATHER_VARIABLES and c != order_by]

    def upsert(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        daily = W.with_date_parts(W.to_units(batch))
        rest = F.struct(*[c for c in daily.columns if c not in key])
        daily = _latest(daily, key, F.struct(order_by, rest) if order_by else rest)
        # one file a station-year, not one for each of them in every task
        daily.repartition("STN", "year").write.mode("overwrite").partitionBy(
            "STN", "year").parquet(f"{log}/batch_id={batch_id}")
        schema = T.StructType([*daily.schema.fields, T.StructField("batch_id", T.LongType())])
        readings = spark.read.schema(schema).option("basePath", log).parquet(log).where(
            F.col("batch_id") <= batch_id)
        new = readings.where(F.col("batch_id") == batch_id).select(
            F.col("STN").alias("_s"), F.col("year").alias("_y")).distinct()
        # null-safe: an unparseable date gives a null year, whose row is replaced too
        touched = readings.join(new, F.col("STN").eqNullSafe(F.col("_s"))
                                & F.col("year").eqNullSafe(F.col("_y")), "left_semi")
        changed = W.station_annual_core(_latest(touched, key, F.col("batch_id")))
        changed = W.with_station_info(changed, "station").withColumn("batch_id",
                                                                     F.lit(batch_id))
        versions = [v for v in committed_versions(spark, table_path) if v < batch_id]
        if batch_id % SNAPSHOT_EVERY or not versions:
            changed.write.mode("overwrite").parquet(_version_path(table_path, batch_id))
            return
        whole = _latest(_read_versions(spark, table_path, versions).unionByName(changed),
                        ["station", "year"], F.col("batch_id"))
        whole.write.mode("overwrite").parquet(_version_path(table_path, batch_id))
        # a reader that started before this version still needs the snapshot it began with
        for v in versions:
            if v < batch_id - SNAPSHOT_EVERY:
                _delete(spark, _version_path(table_path, v))

    w = daily_raw.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def _version_path(table_path: str, batch_id: int) -> str:
    return f"{table_path.rstrip('/')}/v{batch_id:012d}"


def committed_versions(spark: SparkSession, table_path: str) -> list[int]:
    """Batch ids whose version directory is complete (``_SUCCESS`` is written last, at job
    commit). A driver-side listing of one directory per batch since the last snapshot but
    one."""
    out = []
    for name in storage.names(spark, table_path):
        if name.startswith("v") and name[1:].isdigit() and \
                "_SUCCESS" in storage.names(spark, f"{table_path.rstrip('/')}/{name}"):
            out.append(int(name[1:]))
    return sorted(out)


def _read_versions(spark: SparkSession, table_path: str, versions: list[int]) -> DataFrame:
    """The rows of the versions since the newest snapshot."""
    start = max([v for v in versions if v % SNAPSHOT_EVERY == 0], default=0)
    return spark.read.parquet(*[_version_path(table_path, v) for v in versions if v >= start])


def _delete(spark: SparkSession, path: str) -> None:
    storage.delete(spark, path)


def read_station_year_table(spark: SparkSession, table_path: str) -> DataFrame:
    """The station-year table written by the stream: every row from its newest committed
    version."""
    versions = committed_versions(spark, table_path)
    if not versions:
        raise FileNotFoundError(f"no committed version under {table_path}")
    return _latest(_read_versions(spark, table_path, versions), ["station", "year"],
                   F.col("batch_id"))


def national_from_station_table(spark: SparkSession, table_path: str, stations=None) -> DataFrame:
    """A2 over the whole upserted station-year table (an update-mode batch holds only the
    changed rows, so the national roll-up is a batch query over the table)."""
    return W.national_annual(read_station_year_table(spark, table_path).drop("batch_id"),
                             stations)
