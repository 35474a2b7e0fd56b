"""Streams equal their batch counterparts."""

from conftest import SF_SMALL

import __spark_entry__ as E


def _sorted(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_station_year_stream_equals_batch(spark):
    q = E.queries()
    assert _sorted(q["st_station_annual"](spark, SF_SMALL)) == \
        _sorted(q["wx_station_annual"](spark, SF_SMALL))


def test_scoring_stream_equals_batch(spark):
    q = E.queries()
    assert _sorted(q["st_score_requests"](spark, SF_SMALL)) == \
        _sorted(q["score_response"](spark, SF_SMALL))


def test_national_rollup_over_stream_table(spark):
    import uuid
    from loadcast.catalog import _stream_of
    from loadcast.session import scratch_path
    from loadcast.sources import standins as S
    from loadcast.streaming.jobs import national_from_station_table, station_year_stream
    run = uuid.uuid4().hex
    table = scratch_path(spark, f"t_nat/{run}/table")
    station_year_stream(S.weather_raw_from(_stream_of(spark, SF_SMALL, "orders")), table,
                        scratch_path(spark, f"t_nat/{run}/ckpt")).awaitTermination()
    got = _sorted(national_from_station_table(spark, table))
    assert got == _sorted(E.queries()["wx_national"](spark, SF_SMALL))


def test_station_year_table_ignores_uncommitted_version(spark):
    """A version directory without Spark's commit marker (a batch that died half-way) is
    never read; the newest committed version is."""
    import uuid
    from loadcast.catalog import _stream_of
    from loadcast.session import scratch_path
    from loadcast.sources import standins as S
    from loadcast.streaming import jobs as J
    run = uuid.uuid4().hex
    table = scratch_path(spark, f"t_ver/{run}/table")
    J.station_year_stream(S.weather_raw_from(_stream_of(spark, SF_SMALL, "orders")), table,
                          scratch_path(spark, f"t_ver/{run}/ckpt")).awaitTermination()
    committed = J.committed_versions(spark, table)
    assert committed
    before = _sorted(J.read_station_year_table(spark, table))
    # a later batch that wrote data files but never committed
    partial = J._version_path(table, committed[-1] + 1)
    spark.range(3).write.parquet(partial)
    J._delete(spark, partial + "/_SUCCESS")
    assert J.committed_versions(spark, table) == committed
    assert _sorted(J.read_station_year_table(spark, table)) == before


def test_station_year_rows_without_a_year_are_replaced(spark, tmpdir_path):
    """Dates that don't parse give a null year; a later batch replaces that row too."""
    from loadcast.functions import constants as K
    from loadcast.streaming import jobs as J
    schema = "STN string, YYYYMMDD string, " + ", ".join(f"{v} double" for v in
                                                         K.WEATHER_VARIABLES)
    source, table = tmpdir_path + "/in", tmpdir_path + "/table"
    for day, value in (("bad", 10.0), ("worse", 30.0), ("20190101", 50.0)):
        spark.createDataFrame([("240", day, *[value] * 7)], schema).write.mode("append").parquet(
            source)
        stream = spark.readStream.schema(schema).parquet(source)
        J.station_year_stream(stream, table, tmpdir_path + "/ckpt").awaitTermination()
    assert len(J.committed_versions(spark, table)) >= 1
    rows = J.read_station_year_table(spark, table).select("station", "year").collect()
    assert sorted(rows, key=repr) == sorted([("240", 2019), ("240", None)], key=repr)


def _deliver(spark, source, table, checkpoint, rows):
    from loadcast.functions import constants as K
    from loadcast.streaming import jobs as J
    schema = "STN string, YYYYMMDD string, seq long, " + ", ".join(
        f"{v} double" for v in K.WEATHER_VARIABLES)
    spark.createDataFrame([(s, d, q, *[v] * 7) for s, d, q, v in rows], schema).coalesce(1) \
        .write.mode("append").parquet(source)
    J.station_year_stream(spark.readStream.schema(schema).parquet(source), table, checkpoint,
                          order_by="seq").awaitTermination()
    return {(r["station"], r["year"]): r["avg_temp"]
            for r in J.read_station_year_table(spark, table).collect()}


def test_days_delivered_again_and_corrected(spark, tmpdir_path, monkeypatch):
    """Every state of the table is the batch answer over the latest value of each day, also
    across snapshots."""
    import random
    from loadcast.streaming import jobs as J
    monkeypatch.setattr(J, "SNAPSHOT_EVERY", 3)
    rng, latest = random.Random(4), {}
    for k in range(8):
        rows = [(rng.choice(["240", "260"]), f"{rng.choice([2019, 2020])}010{rng.randint(1, 9)}",
                 100 * k + i, float(rng.randint(0, 300))) for i in range(6)]
        rows += [rows[0]]                                        # the same delivery twice
        for s, d, q, v in rows:
            latest[s, d] = v if (s, d) not in latest or q >= latest[s, d, "q"] else latest[s, d]
            latest[s, d, "q"] = max(q, latest.get((s, d, "q"), q))
        got = _deliver(spark, tmpdir_path + "/in", tmpdir_path + "/table",
                       tmpdir_path + "/ckpt", rows)
        want = {}
        for key, v in latest.items():
            if len(key) == 2:
                want.setdefault((key[0], int(key[1][:4])), []).append(v / 10)
        assert got.keys() == want.keys()
        assert all(abs(got[g] - sum(want[g]) / len(want[g])) < 0.0051 for g in got)
    versions = J.committed_versions(spark, tmpdir_path + "/table")
    assert versions == [3, 4, 5, 6, 7]                   # since the last snapshot but one


def test_a_replayed_batch_changes_nothing(spark, tmpdir_path):
    """A batch whose version was lost before the stream's checkpoint knew of it runs again."""
    import os
    from loadcast.streaming import jobs as J
    paths = [tmpdir_path + p for p in ("/in", "/table", "/ckpt")]
    _deliver(spark, *paths, [("240", "20190101", 0, 10.0)])
    before = _deliver(spark, *paths, [("240", "20190101", 1, 30.0), ("240", "20190102", 1, 50.0)])
    for name in ("1", ".1.crc"):
        os.remove(f"{paths[2]}/commits/{name}")
    J._delete(spark, J._version_path(paths[1], 1) + "/_SUCCESS")
    from loadcast.functions import constants as K
    schema = "STN string, YYYYMMDD string, seq long, " + ", ".join(
        f"{v} double" for v in K.WEATHER_VARIABLES)
    J.station_year_stream(spark.readStream.schema(schema).parquet(paths[0]), paths[1], paths[2],
                          order_by="seq").awaitTermination()
    assert {(r["station"], r["year"]): r["avg_temp"] for r in
            J.read_station_year_table(spark, paths[1]).collect()} == before == {("240", 2019): 4.0}
