"""File-name parsing and header-aware CSV union (FIXTURES.md section 3)."""

import os

from pyspark.sql import functions as F

from loadcast.sources import energy as E


def test_file_name_parsing(spark):
    names = [("liander_electricity_2019.csv", "electricity"),
             ("stedin_electricity_01012020.csv", "electricity"),
             ("x_2019.csv", "electricity"),
             ("enexis_gas_2015.csv", "gas"),
             ("coteq_gas_31122018.csv", "gas")]
    df = spark.createDataFrame(names, "source_file string, energy_type string")
    got = {r["source_file"]: (r["company"], r["year"]) for r in E.with_file_fields(df).collect()}
    assert got["liander_electricity_2019.csv"] == ("liander", 2019)
    assert got["stedin_electricity_01012020.csv"] == ("stedin", 2020)
    assert got["x_2019.csv"] == ("x", None)
    assert got["coteq_gas_31122018.csv"] == ("coteq", 2018)


def _write(path, header, rows):
    with open(path, "w") as f:
        f.write(header + "\n")
        for r in rows:
            f.write(",".join(r) + "\n")


def test_header_aware_union(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "Electricity")
    os.makedirs(d)
    _write(os.path.join(d, "liander_electricity_2019.csv"),
           "city,annual_consume,num_connections,type_of_connection",
           [("Amsterdam", "5000", "20", "3x25"), ("Haarlem", "bad", "10", "1x25")])
    _write(os.path.join(d, "stedin_electricity_01012020.csv"),
           "num_connections,annual_consume,city,smartmeter_perc",   # reordered + extra column
           [("30", "9000", "Rotterdam", "55.5")])
    open(os.path.join(d, "a_gas_1013.txt"), "w").write("ignored\n")
    df = E.read_energy(spark, d, "electricity")
    rows = {r["city"]: r for r in df.collect()}
    assert set(rows) == {"Amsterdam", "Haarlem", "Rotterdam"}
    assert rows["Rotterdam"]["annual_consume"] == 9000.0 and rows["Rotterdam"]["num_connections"] == 30.0
    assert rows["Rotterdam"]["type_of_connection"] is None and rows["Rotterdam"]["year"] == 2020
    assert rows["Haarlem"]["annual_consume"] is None          # malformed -> NULL, job survives
    assert rows["Amsterdam"]["company"] == "liander" and rows["Amsterdam"]["year"] == 2019
    files = E.files_of(df)
    s = E.summary(files).first()
    assert s["electricity_files"] == 2 and s["companies"] == ["liander", "stedin"]
    assert s["years_electricity"] == [2019, 2020] and s["min_year"] == 2019
    assert E.by_company(df, "LIAN").count() == 2
    assert E.by_year(df, 2020).count() == 1


def test_station_text_and_cache(spark, tmpdir_path):
    from loadcast.sources import weather as WS
    p = os.path.join(tmpdir_path, "knmi_260.txt")
    with open(p, "w") as f:
        f.write("# BRON: test\n# STN,YYYYMMDD,TG,TN,TX,RH,DR,FG,Q\n\n")
        f.write("  260,20190101,   55,   20,   80,    3,   10,   40,  200\n")
        f.write("  260,20190102,     ,   10,   70,     ,   20,   30,  100\n")
        f.write("  260,20200101,  -15,  -40,   10,    0,    0,   20,   50\n")
    daily = WS.read_station_text(spark, p)
    rows = {r["YYYYMMDD"]: r for r in daily.collect()}
    assert rows["20190101"]["TG"] == 5.5 and rows["20190101"]["Q"] == 200.0
    assert rows["20190102"]["TG"] is None and rows["20190102"]["RH"] is None
    assert rows["20200101"]["year"] == 2020 and rows["20200101"]["TN"] == -4.0
    cache = os.path.join(tmpdir_path, "cache")
    WS.write_cache(daily, cache)
    assert WS.read_cache(spark, cache, stations=["260"], start_year=2020).count() == 1


def test_file_level_company_and_year(spark, tmpdir_path):
    import pytest
    d = os.path.join(tmpdir_path, "Electricity")
    os.makedirs(d)
    _write(os.path.join(d, "liander_electricity_2019.csv"), "city,annual_consume",
           [("Amsterdam", "5000")])
    _write(os.path.join(d, "liander_electricity_01012020.csv"), "annual_consume,city",
           [("7000", "Haarlem")])
    _write(os.path.join(d, "stedin_electricity_2019.csv"), "city,annual_consume",
           [("Rotterdam", "9000")])
    a = E.load_company(spark, d, "LIANDER", "electricity")
    assert sorted(r["city"] for r in a.collect()) == ["Amsterdam", "Haarlem"]
    assert {r["company"] for r in a.collect()} == {"LIANDER"}
    b = E.load_company(spark, d, "liander", "electricity", year=2020)
    assert [r["city"] for r in b.collect()] == ["Haarlem"]
    y = E.load_year(spark, d, 2019, "electricity")
    assert sorted(r["city"] for r in y.collect()) == ["Amsterdam", "Rotterdam"]
    with pytest.raises(ValueError):
        E.load_company(spark, d, "enexis", "electricity")
    with pytest.raises(ValueError):
        E.load_year(spark, d, 2001, "electricity")


def test_nan_is_null_and_quoted_headers_are_names(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "Electricity")
    os.makedirs(d)
    _write(os.path.join(d, "liander_electricity_2019.csv"),
           '"city","annual_consume",num_connections,"note, long"',
           [("Amsterdam", "NaN", "20", "a"), ('"Haar,lem"', "100", "nan", "b")])
    df = E.read_energy(spark, d, "electricity")
    assert {"city", "annual_consume", "num_connections", "note, long"} <= set(df.columns)
    assert df.agg(F.sum("annual_consume"), F.avg("num_connections")).first()[:] == (100.0, 20.0)
    assert {r["city"] for r in df.collect()} == {"Amsterdam", "Haar,lem"}
    from loadcast.sources import weather as WS
    p = os.path.join(tmpdir_path, "knmi.txt")
    with open(p, "w") as f:
        f.write("# x\n  260,20190101, NaN, 20, 80, 3, 10, 40, 200\n"
                "  260,20190102, 30, 10, 70, 1, 20, 30, 100\n")
    assert WS.read_station_text(spark, p).agg(F.avg("TG")).first()[0] == 3.0


def test_ten_thousand_small_files_of_three_headers(spark, tmpdir_path):
    """No list of files reaches the driver: headers are found by tasks, and in groups of files if
    the table of headers is larger than a broadcast may be."""
    d = os.path.join(tmpdir_path, "Electricity")
    os.makedirs(d)
    headers = ["city,annual_consume,num_connections", "num_connections,city,annual_consume",
               "annual_consume,city,smartmeter_perc"]
    for i in range(10_000):
        values = {"city": f"c{i}", "annual_consume": str(i), "num_connections": "2",
                  "smartmeter_perc": "50"}
        header = headers[i % 3]
        _write(os.path.join(d, f"f{i}_electricity_{2009 + i % 12}.csv"), header,
               [[values[c] for c in header.split(",")]])
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for smaller in (limit, "400k"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", smaller)
        try:
            row = E.read_energy(spark, d, "electricity").agg(
                F.count("*"), F.sum("annual_consume"), F.sum("num_connections"),
                F.sum("smartmeter_perc"), F.count_distinct("company"),
                F.count_if(F.concat(F.lit("c"), F.col("annual_consume").cast("int"))
                           == F.col("city"))).first()
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        assert row[:] == (10_000, 9999 * 5000.0, 2.0 * 6667, 50.0 * 3333, 10_000, 10_000)


def test_headers_of_split_files_and_repeated_names(spark, tmpdir_path):
    """A file of many splits has its header in the first one only; a header that stands again
    is not data; blank lines are skipped."""
    d = os.path.join(tmpdir_path, "Electricity")
    os.makedirs(d)
    for k, header in enumerate(["city,annual_consume,note,note", "note,annual_consume,city"]):
        width = header.count(",") + 1
        rows = [[f"v{i}", str(i), "x", "y"][:width] for i in range(20_000)]
        rows[5000:5000] = [header.split(","), [" "]]
        _write(os.path.join(d, f"big{k}_electricity_2010.csv"), header, rows)
    open(os.path.join(d, "empty_electricity_2011.csv"), "w").close()
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50k")
    try:
        assert E.file_headers(E._lines(spark, d)).count() == 2
        df = E.read_energy(spark, d, "electricity").cache()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert df.count() == 40_000 and "note.1" in df.columns
    assert df.agg(F.sum("annual_consume")).first()[0] == 2 * sum(range(20_000))
    assert df.where("company = 'big0' and `note.1` = 'y'").count() == 20_000
    assert df.where("company = 'big1' and city = 'x'").count() == 20_000


def test_a_folder_without_files(spark, tmpdir_path):
    import pytest
    d = os.path.join(tmpdir_path, "Gas")
    os.makedirs(d)
    with pytest.raises(FileNotFoundError):
        E.read_energy(spark, d, "gas")
    with pytest.raises(ValueError):
        E.read_energy(spark, d, "water")


def _daily(spark, rows, variables):
    from loadcast.operators import weather as W
    return W.with_date_parts(spark.createDataFrame(
        rows, "STN string, YYYYMMDD string, " + ", ".join(f"{v} double" for v in variables)))


def test_cache_grows_by_station_year_and_variable(spark, tmpdir_path):
    """Adding stations, days or variables keeps what is there."""
    from loadcast.sources import weather as WS
    c = tmpdir_path + "/cache"
    import pytest
    with pytest.raises(FileNotFoundError):
        WS.read_cache(spark, c)
    WS.write_cache(_daily(spark, [("0240", "20190101", 1.0, 2.0), ("0240", "20200101", 3.0, 4.0),
                                  ("260", "20190101", 5.0, 6.0)], ["TG", "RH"]), c)
    WS.write_cache(_daily(spark, [("330", "20190101", 7.0, 8.0)], ["TG", "RH"]), c)
    WS.write_cache(_daily(spark, [("0240", "20190101", 9.0), ("0240", "20190102", 10.0)],
                          ["Q"]), c)
    WS.write_cache(_daily(spark, [("260", "20190101", 50.0)], ["TG"]), c)
    got = {(r["STN"], r["YYYYMMDD"]): (r["TG"], r["RH"], r["Q"])
           for r in WS.read_cache(spark, c).collect()}
    assert got == {("0240", "20190101"): (1.0, 2.0, 9.0), ("0240", "20190102"): (None, None, 10.0),
                   ("0240", "20200101"): (3.0, 4.0, None), ("260", "20190101"): (50.0, 6.0, None),
                   ("330", "20190101"): (7.0, 8.0, None)}
    assert WS.read_cache(spark, c, ["0240"], 2020).count() == 1


def test_a_request_lists_exactly_its_missing_days(spark, tmpdir_path):
    import datetime as dt
    import random
    from loadcast.sources import weather as WS
    rng, c, held = random.Random(3), tmpdir_path + "/cache", set()
    base = dt.date(2019, 12, 1)
    day = lambda i: base + dt.timedelta(days=i)
    ask = ["240", "260", "330"], day(5).isoformat(), day(70).isoformat(), ["TG", "Q"]

    def gaps():
        out = set()
        for r in WS.missing_days(spark, c, *ask).collect():
            span = range((r["first"] - base).days, (r["last"] - base).days + 1)
            days = {(r["STN"], r["variable"], i) for i in span}
            assert days and not days & out
            out |= days
            for i in (span[0] - 1, span[-1] + 1):               # as long as they can be
                assert not 5 <= i <= 70 or (r["STN"], r["variable"], i) in held
        return out

    every = {(s, v, i) for s in ask[0] for v in ask[3] for i in range(5, 71)}
    assert gaps() == every
    for k in range(4):
        s, v = rng.choice(ask[0][:2]), rng.choice([["TG"], ["TG", "Q"]])
        days = rng.sample(range(80), 30)
        daily = _daily(spark, [(s, day(i).strftime("%Y%m%d"), *[1.0] * len(v)) for i in days], v)
        if k == 2:
            WS.write_cache(daily, c, v, day(0).isoformat(), day(30).isoformat())
            days = range(31)
        else:
            WS.write_cache(daily, c, v)
        held |= {(s, x, i) for x in v for i in days}
        assert gaps() == every - held
