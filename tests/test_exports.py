"""Exports of differing columns in one folder, headers, quoted fields."""

import csv

import pytest
from pyspark.sql import functions as F

from drivescope.operators import staging
from drivescope.sources import columns, nmf, tables

FILES = {
    "a.csv": "Time Stamp,Latitude,Longitude,Serving SC,Serving RSRP,seq,N1 PCI,N1 RSRP\n10:00:00,\"1,5\",2.5,17,\"-80,5\",1,99,-90\n\n10:00:01,1.5,2.5,17,,2\n",
    "b.csv": "﻿seq,N1 RSRP,N1 PCI,Serving RSRP,PCI,Longitude,Latitude,Time\n3,-91,98,-81,18,3.5,4.5,10:00:02\nseq,N1 RSRP,N1 PCI,Serving RSRP,PCI,Longitude,Latitude,Time\n4,,,,18,,,10:00:03,surplus\n",
    "deep/c.csv": "seq,x,y,Band\n5,\"7\",\"8\",\"say \"\"B7\"\"\"\n6,,,none\n",
    "deep/empty.csv": "",
    "deep/blank.csv": "\n\n",
    "deep/header.csv": "seq,Time\n",
}


@pytest.fixture
def folder(tmp_path):
    for name, text in FILES.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(text, encoding="utf-8")
    return str(tmp_path)


def test_each_file_is_read_by_its_own_header(spark, folder):
    got = {r.seq: r for r in tables.read_tabular(spark, folder, ["seq"]).collect()}
    assert set(got) == {"1", "2", "3", "4", "5"}  # line 6 has neither position nor time
    assert (got["1"].lat, got["1"].lon, got["1"].sc, got["1"].level) == (1.5, 2.5, 17, -80.5)
    assert [(n.role, n.pci, n.rsrp) for n in got["1"].neighbors] == [("N1", 99, -90.0)]
    assert got["2"].level is None and got["2"].neighbors == []
    assert (got["3"].lat, got["3"].lon, got["3"].sc, got["3"].level) == (4.5, 3.5, 18, -81.0)
    assert [(n.role, n.pci, n.rsrp) for n in got["3"].neighbors] == [("N1", 98, -91.0)]
    assert got["4"].time == "10:00:03" and got["4"].lat is None
    assert (got["5"].lat, got["5"].lon, got["5"].band) == (8.0, 7.0, 'say "B7"')


def test_tables_and_files_give_the_same_points(spark, tmp_path):
    d = spark.createDataFrame([("1", "1.5", "2,5", "10:00:00", "-80", "7", "-99"), ("2", None, None, "0.5", None, None, "-98")],
                              ["seq", "Latitude", "Longitude", "Time", "RSRP", "A2 PCI", "A2 RSRP"])
    d.coalesce(1).write.option("header", True).csv(str(tmp_path / "x"))
    key = lambda t: sorted(map(str, t.collect()))
    assert key(tables.read_tabular(spark, str(tmp_path / "x"), ["seq"])) == key(columns.tabular_points(d, ["seq"]))


def test_small_and_large_sides_attach_alike(spark):
    many = spark.range(500).select((F.col("id") % 7).alias("k"), F.col("id").alias("seq"))
    few = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    want = sorted((i % 7, i, i % 7 * 10) for i in range(500) if i % 7 < 5)
    for most in (0, 100):
        got = staging.attach_sized(many, few, ["k"], by=["seq"], most=most).select("k", "seq", "v").collect()
        assert sorted(map(tuple, got)) == want


def test_quotes_follow_the_usual_rules(spark):
    lines = ['a,"",b', '"""x"""', 'p,"q,r",""""', ",,", '"a""b",c', '""']
    got = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, t string").select("i", nmf.split_csv(F.col("t")).alias("p")).collect()
    assert {r.i: r.p for r in got} == {i: next(csv.reader([t])) for i, t in enumerate(lines)}


def test_other_cells_are_not_the_serving_one():
    headers = ["N1 PCI", "Active Set PCI", "AS1 SC", "Meas PCI", "Best Active PCI"]
    assert [columns.is_other_cell(columns.header_key(h), ["active", "set", "neighbor"]) for h in headers] == [True, True, True, False, False]
    assert columns.resolve_column(["Neighbor SC", "PCI x", "Serving PCI"], ["servingpci", "pci"], ["neighbor"]) == "Serving PCI"
    assert columns.resolve_column([], ["pci"]) is None


def test_containers_are_read_as_bytes_whatever_their_size(spark, tmp_path):
    payload = b"NMFS\x01\x00#PRODUCT,x\r\n#START,10:00:00.000,,\"16.12.2025\"\r\nGPS,10:00:00.000,,-6.8\x00,34.0\r\n\xff\xfe\rGPS,1,2\r\n\r\n#STOP,10:00:10.000,,\"16.12.2025\"\n"
    (tmp_path / "a.nmfs").write_bytes(payload)
    (tmp_path / "b.nmfs").write_bytes(b"GPS,10:00:00.000,,-6.8,34.0\n")
    (tmp_path / "c.nmfs").write_bytes(b"")
    for most in (1 << 20, 40):
        d = nmf.read_containers(spark, str(tmp_path), most)
        got = {r.log_id[-6:-5]: r for r in nmf.container_metadata(d).collect()}
        assert (got["a"].signature, got["a"].decode_mode, got["a"].metadata_count, got["a"].record_count) == ("NMFS", "metadata_plus_plaintext", 3, 1)
        assert got["a"].has_start and got["a"].has_stop and got["b"].decode_mode == "text_fallback"
        assert sorted(r.line_no for r in d.where("log_id like '%a.nmfs'").collect()) == [1, 2, 3, 4, 6]
