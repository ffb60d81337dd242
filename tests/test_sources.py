"""Delimited files of several layouts, sinks and manifests."""

import datetime as dt
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from tidemark.operators import quality
from tidemark.session import drop_staged, stage, staging_dir
from tidemark.sources import delimited, sinks


def write(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))
    return str(path)


@pytest.mark.parametrize("header,tie,want", [("a;b;c", ";", ";"), ("a,b;c,d", ";", ","), ("a,b;c", ";", ";"), ("a,b;c", ",", ","), ("abc", ",", ",")])
def test_separator(header, tie, want):
    assert delimited.separator_of(header, tie) == want


def test_headers_match_without_accents():
    assert delimited.find_column(["﻿AÑO ", "Mes"], delimited.YEAR_ALIASES) == "﻿AÑO "
    assert delimited.find_column(["Día"], delimited.DAY_ALIASES) == "Día"
    with pytest.raises(ValueError):
        delimited.pick_column(["x"], ["y"])


def test_load_panel(spark, tmp_path):
    text = "﻿timestamp;PM10\n2024-01-01 00:00:00;5\n2024-01-01 01:00:00;x\nbad;7\n2024-01-01 00:00:00;6\n"
    path = write(tmp_path / "one file.csv", text)
    rows = sorted((r.ts, r.y) for r in delimited.load_panel(spark, path, "timestamp", "PM10").collect())
    assert rows == [(dt.datetime(2024, 1, 1, 0), 6.0), (dt.datetime(2024, 1, 1, 1), None)]
    with pytest.raises(ValueError):
        delimited.load_panel(spark, path, "timestamp", "NO2")


def test_covariates_may_be_absent(spark, tmp_path):
    assert delimited.load_covariates(spark, None).count() == 0
    path = write(tmp_path / "w.csv", "timestamp,temp,rain\n2024-01-01,1.5,\n2024-01-01,2.5,0\n")
    row = delimited.load_covariates(spark, path).first()
    assert (row.temp, row.rain) == (2.5, 0.0)


def test_ingest_stations(spark, tmp_path):
    folder = tmp_path / "stations"
    write(folder / "north bay_finalised_merged_NA.csv", "Date and Time,PM10,temp\n2024-01-01 00:00,5,1\n2024-01-01 00:00,6,2\n,7,3\n")
    write(folder / "old_town_merged_NA.csv", "﻿datetime,temp,PM2.5,junk\n2024-01-01 01:00:00,3,-4,zz\n")
    write(folder / "skip_me_merged_NA.csv", "datetime,PM10\n2024-01-01,9\n")
    got = delimited.ingest_stations(spark, str(folder), exclude=["skip me"])
    assert got.columns == ["timestamp", "station", *delimited.POLLUTANTS, *delimited.WEATHER]
    rows = {r.station: r for r in got.collect()}
    assert set(rows) == {"north bay", "old town"}
    assert rows["north bay"].PM10 == 5.0 and rows["north bay"]["PM2.5"] is None  # the first of two rows is kept
    assert rows["old town"]["PM2.5"] == -4.0 and rows["old town"].PM10 is None


def test_drop_folder_mixes_layouts(spark, tmp_path):
    folder = tmp_path / "drop"
    hours = ";".join(f"H{h:02d}" for h in range(1, 25))
    values = ";".join(str(h) for h in range(1, 25))
    write(folder / "wide.csv", f"CODEST;FECHA;PARAMETRO;{hours}\n3000001;31/12/2023;pm10;{values}\n3000002;31/12/2023;pm10;{values}\n")
    write(folder / "data 3000003.csv", f"AÑO;MES;DÍA;{hours}\n2024;1;2;{values}\n")
    write(folder / "long.csv", "Estación;Fecha;Hora;Variable;Valor\n3000001;31/12/2023;24;PM10;99\n3000001;31/12/2023;0;PM10;7\n3000001;bad;1;PM10;1\n")
    write(folder / "other.csv", "a;b\n1;2\n")
    got = delimited.ingest_drop_folder(spark, str(folder), ["3000001", "3000003"])
    rows = {(r.station, r.variable, r.timestamp): r.value for r in got.collect()}
    assert {k[0] for k in rows} == {"3000001", "3000003"}
    assert rows[("3000001", "PM10", dt.datetime(2023, 12, 31, 5))] == 5.0
    assert rows[("3000001", "PM10", dt.datetime(2023, 12, 31, 0))] == 7.0
    assert rows[("3000001", "PM10", dt.datetime(2024, 1, 1, 0))] == 24.0  # wide.csv comes after long.csv
    assert rows[("3000003", "UNKNOWN", dt.datetime(2024, 1, 3, 0))] == 24.0
    assert len(rows) == 25 + 24
    with pytest.raises(ValueError):
        write(tmp_path / "none" / "x.csv", "a;b\n1;2\n")
        delimited.ingest_drop_folder(spark, str(tmp_path / "none"))


def test_the_last_file_wins_across_layouts_and_sizes(spark, tmp_path):
    folder = tmp_path / "order"
    head = "Estación;Fecha;Hora;Variable;Valor\n"
    write(folder / "a.csv", head + "s;2024-01-01;1;PM10;1\ns;2024-01-01;2;PM10;1\n")
    write(folder / "b.csv", head + "s;2024-01-01;1;PM10;2\n" + "s;2024-01-02;5;PM10;0\n" * 500)
    write(folder / "c.csv", "Estación,Fecha,Hora,Variable,Valor,Extra\ns,2024-01-01,2,PM10,3,x\n")
    rows = {r.timestamp.hour: r.value for r in delimited.ingest_drop_folder(spark, str(folder)).collect() if r.timestamp.day == 1}
    assert rows == {1: 2.0, 2: 3.0}


def test_headers_of_any_length(spark, tmp_path):
    names = ["timestamp", "PM10", *[f"extra_column_{i}" for i in range(8000)]]
    path = write(tmp_path / "wide.csv", ",".join(names) + "\n2024-01-01 00:00:00,5" + "," * 8000 + "\n")
    assert len(",".join(names)) > 100 * 1024
    layout = delimited.layouts(spark, path)[0]
    assert layout.columns == names and layout.sep == ","


def test_one_scan_for_any_number_of_layouts(spark, tmp_path):
    """The lines are read once however many headers there are, and a long file is joined with its header in parts."""
    folder = tmp_path / "many"
    for i in range(6):
        extra = ";".join(f"x{j}" for j in range(i))
        write(folder / f"f{i}.csv", f"Fecha;{extra + ';' if i else ''}Hora;Valor;Estación\n" + f"2024-01-0{i + 1};{'z;' * i}5;{i}.5;s\n" * 3)
    got = delimited.ingest_drop_folder(spark, str(folder))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [value#") == 1 and "_part" in plan
    assert {r.timestamp.day: r.value for r in got.collect()} == {i + 1: i + 0.5 for i in range(6)}
    found = {os.path.basename(r.path): (r.layout, r.problem) for r in delimited.drop_folder_files(spark, str(folder)).collect()}
    assert found["f0.csv"] == ("long", None)


def test_parts_of_a_long_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(delimited, "PART_BYTES", 4096)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        text = "timestamp,PM10\n" + "".join(f"2024-01-01 {h:02d}:{m:02d}:00,{h * 60 + m}\n" for h in range(24) for m in range(60))
        write(tmp_path / "long" / "a+b %41.csv", text)
        rows = delimited.load_panel(spark, str(tmp_path / "long"), "timestamp", "PM10").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(r.y for r in rows) == list(range(1440))


def test_quotes_in_lines(spark, tmp_path):
    path = write(tmp_path / "q.csv", 'timestamp,"a,b",PM10\n2024-01-01 00:00:00,"x,""y""",5\n2024-01-02 00:00:00,5" pipe,6\n')
    rows = delimited.read_text_columns(spark, path).orderBy("timestamp").collect()
    assert [(r["a,b"], r.PM10) for r in rows] == [('x,"y"', "5"), ('5" pipe', "6")]
    bad = write(tmp_path / "bad" / "q.csv", 'timestamp,PM10\n2024-01-01 00:00:00,"5\n6"\n')
    with pytest.raises(Exception, match="goes on in the next line"):
        delimited.read_text_columns(spark, bad).collect()


def test_manifest_of_a_large_file(spark, tmp_path):
    """3 GB, which no single value can hold; the file is sparse and read in pieces."""
    with open(tmp_path / "large.bin", "wb") as file:
        file.truncate(3 << 30)
    digest, zeros = hashlib.sha256(), bytes(1 << 24)
    for _ in range(192):
        digest.update(zeros)
    found = {os.path.basename(r.path): (r.size_bytes, r.sha256) for r in sinks.file_manifest(spark, str(tmp_path)).collect()}
    assert found == {"large.bin": (3 << 30, digest.hexdigest())}


def test_daily_file_names(spark):
    df = spark.createDataFrame([("PM25_Old_Town_12_daily.csv",), ("PM10_X_1_daily.csv",), ("NO2_X_1_daily.csv",)], "f string")
    got = [tuple(r.p) if r.p else None for r in df.select(delimited.daily_file_parts(F.col("f")).alias("p")).collect()]
    assert got == [("PM2.5", "Old_Town", "12"), ("PM10", "X", "1"), None]


def test_sinks_and_manifest(spark, tmp_path):
    rows = [("c", "s1", "PM10", dt.datetime(2024, 1, 1), 1.0), ("c", "s1", "PM10", dt.datetime(2024, 1, 1), 0.5), ("c", "s2", "NO2", dt.datetime(2023, 1, 1), 3.0)]
    df = spark.createDataFrame(rows, "city string, station_id string, component string, datetime timestamp, value double")
    out = str(tmp_path / "net")
    ranked = df.withColumn("rank", F.when(F.col("value") == 1.0, 1).otherwise(2))
    sinks.export_network(ranked, out, ["rank"])
    back = spark.read.option("header", True).csv(out)
    assert back.filter("station_id = 's1'").first().value == "0.5"  # the last row, not the largest
    assert back.count() == 2 and "rank" not in back.columns and {"city", "station_id", "component"} <= set(back.columns)
    long = df.select(F.col("datetime").alias("timestamp"), F.col("station_id").alias("station"), F.col("component").alias("variable"), "value")
    sinks.write_year_chunks(long, str(tmp_path / "years"))
    assert sorted(r.year for r in spark.read.parquet(str(tmp_path / "years")).select("year").distinct().collect()) == [2023, 2024]
    sinks.write_station_raw(long, str(tmp_path / "raw"))
    assert spark.read.parquet(str(tmp_path / "raw")).filter("station = 's1'").count() == 2
    manifest = {"/" + r.path.removeprefix("file:").lstrip("/"): (r.size_bytes, r.sha256) for r in sinks.file_manifest(spark, out).collect()}
    for file in (tmp_path / "net").rglob("*.csv"):
        data = file.read_bytes()
        assert manifest[str(file)] == (len(data), hashlib.sha256(data).hexdigest())


def test_run_metadata_and_shards(spark, tmp_path):
    a = spark.createDataFrame([("s1", 1), ("s2", 2)], "series string, v int")
    meta = sinks.write_run({"ledger": a, "metrics": a.limit(1)}, str(tmp_path / "run"), "t0", "t1", {"horizon": 24})
    assert {r.config for r in meta.collect()} == {'{"horizon": 24}'}
    assert {r.table: r.rows for r in meta.collect()} == {"ledger": 2, "metrics": 1}
    a.write.parquet(str(tmp_path / "x"))
    a.write.parquet(str(tmp_path / "y"))
    both = sinks.read_shards(spark, [str(tmp_path / "x"), str(tmp_path / "y")], ["series", "v"])
    assert [r.series for r in both.collect()] == ["s1", "s1", "s2", "s2"]


def test_stage_uses_the_shared_folder(spark):
    staged = stage(spark.range(5), "n")
    assert staging_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert all(f.replace("file://", "").startswith(staging_dir(spark)) for f in staged.inputFiles())


def test_staged_tables_can_be_dropped(spark):
    folder = staging_dir(spark)
    kept = set(os.listdir(folder))
    stage(spark.range(5), "n")
    stage(spark.range(5), "m")
    new = set(os.listdir(folder)) - kept
    assert len(new) == 2 and drop_staged(spark) >= 2 and not new & set(os.listdir(folder))


def test_require_columns(spark):
    with pytest.raises(ValueError):
        quality.require_columns(spark.range(1), ["x"])
