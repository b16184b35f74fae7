import json
import plistlib
import struct

import numpy as np
import pytest

from cohortlake.operators import imaging as I
from cohortlake.operators.nested import p3_found, region_table, shred
from cohortlake.sources import files as S
from cohortlake.streaming import events as E


def outline(n):
    return [{"x": float(i), "y": 1.0} for i in range(n)]


def test_regions_of_many_dialects(spark):
    p = {
        1: {"slices": [{"image_index": 4, "rois": [{"points_px": outline(3), "points_mm": [[1, 2, 3], None]}, None, {"points_px": "1 2;3 4; ", "geometry": {}}]}]},
        2: {"Images": json.dumps([{"ImageIndex": "7", "ROIs": {"Point_px": ["(1, 2)", "(3, 4)"], "Point_mm": {"xs": [1, 2, None], "ys": [1, 2, None], "zs": [0, 0, None]}}}])},
        3: {"result": {"parse": {"slices": {"12": {"rois": [{"vessel_raw": "LAD"}], "deleted_rois": [{"points_px": [[1, 2]]}]}}}}},
        4: {"results": [{"slices": [{"image_index": 1, "rois": [{"geometry": {"points_px": [[1, 2], [3, 4]], "points_mm": None}, "audit": [{"was": {"rois": [{"vessel_raw": "x"}]}}]}]}]}]},
    }
    rows = [(k, json.dumps(v)) for k, v in p.items()] + [(5, json.dumps(json.dumps(p[1]))), (6, "﻿" + json.dumps(p[3])), (7, json.dumps(p[1])[:-3]), (8, None), (9, ""), (10, "[]"), (11, "7"), (12, "[" * 100_000)]
    df = spark.createDataFrame(rows, "record_id long, payload string")
    wide, pts, _ = region_table(df)
    got = {(r.record_id, r.image_index, r.roi_idx, r.n_px, r.n_mm) for r in wide.collect()}
    one = {(4, 0, 3, 1), (4, 2, 2, 0)}
    assert got == {(k, *t) for k in (1, 5) for t in one} | {(2, 7, 0, 2, 2), (3, 12, 0, 0, 0), (6, 12, 0, 0, 0), (4, 1, 0, 2, 0)}
    assert {(r.ordinal, r.x, r.y) for r in pts.where("record_id = 2 and space = 'px'").collect()} == {(0, 1.0, 2.0), (1, 3.0, 4.0)}


def test_shredding_links_every_child(spark):
    df = spark.createDataFrame([(1, '{"a": [1, {"b": null}], "c": "x"}'), (1, "~"), (None, "{}")], "id long, t string")
    n = {r.node: r for r in shred(df, "id", "t").collect()}
    assert len(n) == 6 and all(r.parent is None or r.parent in n for r in n.values())
    assert sorted((r.label or "", r.kind, r.scalar or "") for r in n.values()) == [("", "object", ""), ("", "object", ""), ("", "scalar", "1"), ("a", "array", ""), ("b", "null", ""), ("c", "scalar", "x")]
    assert shred(df.limit(0), "id", "t").count() == 0


def test_found_on_the_given_tables(spark, sf):
    got = p3_found(spark, sf)
    assert got.columns == ["record_id", "image_index", "roi_idx", "n_px", "n_mm"] and got.count() > 50


def test_plists(spark, tmp_path):
    doc = {"Images": [{"ImageIndex": 3, "ROIs": [{"Name": "LAD", "Point_px": ["(1, 2)", "(3, 4)", "(5, 1)"], "Point_mm": []}]}]}
    (tmp_path / "17.xml").write_bytes(plistlib.dumps(doc))
    (tmp_path / "bad.xml").write_text("<plist>")
    df = S.read_plists(spark, str(tmp_path))
    got = {r.pid: (r.payload is None, r.error is None) for r in df.collect()}
    assert got == {"17": (False, True), "bad": (True, False)}
    wide, _, _ = region_table(df, key="pid")
    assert [(r.pid, r.image_index, r.roi_idx, r.n_px, r.n_mm) for r in wide.collect()] == [("17", 3, 0, 3, 0)]


def element(group, number, vr, text):
    b = text.encode() + b" " * (len(text) % 2)
    return struct.pack("<HH", group, number) + vr + struct.pack("<H", len(b)) + b


def image(series, number, instance, z, modality="CT"):
    body = element(8, 0x60, b"CS", modality) + element(0x18, 0x1210, b"SH", "Hr32d\\ 2\\ ") + element(0x20, 0xE, b"UI", series) + element(0x20, 0x11, b"IS", number) + element(0x20, 0x13, b"IS", instance)
    body += element(0x20, 0x32, b"DS", f"1\\2\\{z}") if z is not None else b""
    return b"\0" * 128 + b"DICM" + body + struct.pack("<HH", *S.PIXELS) + b"OW\0\0" + struct.pack("<I", 4) + b"\1\2\3\4"


def test_image_headers_and_series(spark, tmp_path):
    d = tmp_path / "p1"
    d.mkdir()
    for i in range(3):
        (d / f"a{i}.dcm").write_bytes(image("1.2", "5", str(i), i * 3.0))
        (d / f"b{i}.dcm").write_bytes(image("1.1", "4", str(i), None))
    for i in range(5):
        (d / f"c{i}.dcm").write_bytes(image("1.0", "1", str(i), 0, "SR"))
    h = S.read_headers(spark, str(tmp_path))
    picked = S.pick_series(h).collect()
    assert {r.series_uid for r in picked} == {"1.1"} and sorted(r.z for r in picked) == [0.0, 1.0, 2.0]
    assert {r.kernel for r in picked} == {"Hr32d/2"}
    assert S.first_header(h).first().path.endswith("a0.dcm")


def test_spacing_csv_resume_and_header(spark, tmp_path):
    (tmp_path / "ok.json").write_text('{"spacing": [0.5, 0.5, 3.0]}')
    assert S.read_spacing(spark, str(tmp_path / "ok.json")).first().spacing == [0.5, 0.5, 3.0]
    (tmp_path / "bad.json").write_text('{"spacing": [0.5, -1, 3.0]}')
    with pytest.raises(Exception, match="bad spacing"):
        S.read_spacing(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "t.csv").write_text("pid,v\n007,1.5\n8,\n")
    t = S.read_csv(spark, str(tmp_path / "t.csv"), "pid string, v double")
    assert [tuple(r) for r in t.collect()] == [("007", 1.5), ("8", None)]
    S.write_table(t, str(tmp_path / "out"), ["pid"])
    done = spark.read.schema("v double, pid string").parquet(str(tmp_path / "out"))
    assert S.missing_keys(t, done.where("pid = '8'"), ["pid"]).first().pid == "007"
    a, b = (S.run_header(spark, {"t": x}, {"seed": "1"}).first() for x in (t, t.repartition(3)))
    assert a == b and a.t_rows == 2


def test_polygon_pixels():
    px = {tuple(p) for p in I.fill_polygon(np.array([1, 4, 4, 1]), np.array([1, 1, 3, 3])).tolist()}
    assert px == {(r, c) for r in (1, 2, 3) for c in (1, 2, 3, 4)}
    assert len(I.fill_polygon(np.array([1, 2]), np.array([1, 2]))) == 0
    tri = I.fill_polygon(np.array([0, 8, 0]), np.array([0, 0, 8]))
    assert {tuple(p) for p in tri.tolist()} == {(r, c) for r in range(9) for c in range(9 - r)}


def test_mask_report(spark):
    rows = [(1, [(1.0, 1.0), (4.0, 1.0), (4.0, 3.0), (1.0, 3.0)]), (2, [(1.0, 1.0)]), (3, [(-9.0, -9.0), (-8.0, -9.0), (-8.0, -8.0)]), (4, [])]
    df = spark.createDataFrame(rows, "id int, points array<struct<x:double,y:double>>")
    got = {r.id: (r.n_pixels, r.skipped) for r in I.mask_report(df, ["id"]).collect()}
    assert got == {1: (12, None), 2: (0, "too_few_points"), 3: (0, "outside_or_thin"), 4: (0, "too_few_points")}


def test_outlines_with_stray_vertices_are_clipped_first():
    px = I.fill_polygon(np.array([-1e9, 1e9, 1e9, -1e9]), np.array([-1e9, -1e9, 1e9, 1e9]), width=20, height=10)
    assert len(px) == 200 and px.min() == 0 and px[:, 0].max() == 9 and px[:, 1].max() == 19


def test_stream_equals_table(spark, tmp_path, sf):
    src = tmp_path / "events"
    spark.read.parquet(f"{sf}/events.parquet").repartition(3).write.parquet(str(src))
    q = E.windowed(E.read_events(spark, str(src))).writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {tuple(r) for r in E.windowed(spark.read.parquet(str(src))).select("begin", "event_type", "n").collect()}
    assert {tuple(r) for r in spark.table("w").select("begin", "event_type", "n").collect()} == want


def test_sinks_give_rows_back(spark, tmp_path):
    df = spark.createDataFrame([("1", 2.5, [1, 2]), (None, None, None), ("007", 0.0, [])], "pid string, v double, a array<int>")
    S.write_json(df, str(tmp_path / "j"))
    assert sorted(map(str, spark.read.schema(df.schema).json(str(tmp_path / "j")).collect())) == sorted(map(str, df.collect()))
    S.write_csv(df.drop("a"), str(tmp_path / "c"))
    assert sorted(map(str, S.read_csv(spark, str(tmp_path / "c"), "pid string, v double").collect())) == sorted(map(str, df.drop("a").collect()))
    S.write_json(df.limit(0), str(tmp_path / "e"))
    assert spark.read.schema(df.schema).json(str(tmp_path / "e")).count() == 0
    S.write_spacing(spark.createDataFrame([("p1", [0.5, 0.5, 3.0])], "pid string, spacing array<double>"), str(tmp_path / "s"))
    assert S.read_spacing(spark, str(tmp_path / "s" / "pid=p1")).first().spacing == [0.5, 0.5, 3.0]
    with pytest.raises(Exception, match="bad spacing"):
        S.write_spacing(spark.createDataFrame([("p1", [0.5, -1.0])], "pid string, spacing array<double>"), str(tmp_path / "b"))
