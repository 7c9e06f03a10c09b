import json
import struct
import zipfile

import pytest

from roadweave.operators import graph
from roadweave.sources import sinks, tables


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_delimited_files(spark, tmp_path):
    a = write(tmp_path / "2025-08" / "a.csv", "device_id;navigation_dttm;lat;lon\n3070706185;2025-08-13 02:28:54;47.4403809;138.7108925\n2;not-a-date;xx;yy\n;2025-08-13 2:28:55;47.5;138.7\n")
    b = write(tmp_path / "2025-09" / "b.csv", '"device_id"/"navigation_dttm"/"lat"/"lon"\n7/2025-08-13 02:28:54/47.1/138.1\n')
    c = write(tmp_path / "2025-09" / "c.csv", "id,time,latitude,longitude\nx,12.04.2025 8:21,1.5,2.5\ny,12.04.2025 8:22,1.5,2.5,extra,more\n")
    rows = tables.load(spark, [a, b, c]).orderBy("lat").collect()
    assert [(r["device"], r["lat"]) for r in rows] == [("x", 1.5), ("7", 47.1), ("3070706185", 47.4403809), ("nan", 47.5)]
    assert str(rows[0]["time"]) == "2025-04-12 08:21:00" and str(rows[2]["time"]) == "2025-08-13 02:28:54"
    files = tables.list_files(spark, str(tmp_path)).collect()
    assert [r["month"] for r in files] == ["2025-08", "2025-09", "2025-09"]
    assert tables.load(spark, str(tmp_path)).count() == 4 and tables.load(spark, None).count() == 0
    with pytest.raises(ValueError, match="no column for time"):
        tables.load(spark, [write(tmp_path / "d.csv", "id;lat;lon\n1;2;3\n")])
    with pytest.raises(ValueError, match="can't read"):
        tables.load(spark, [write(tmp_path / "e.doc", "x")])


def test_headers():
    assert tables.sniff_delimiter("a;b/c") == ";" and tables.sniff_delimiter("a,b,c;d") == "," and tables.sniff_delimiter("abc") == ";"
    assert tables.detect_columns(['"Lat"', "x", "LON", "IMEI", "id", "Время"]) == {"device": "id", "time": "Время", "lat": '"Lat"', "lon": "LON"}


def test_workbooks(spark, tmp_path):
    at = tmp_path / "book.xlsx"
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(at, "w") as book:
        book.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>device</t></si><si><t>time</t></si><si><t>lat</t></si><si><t>lon</t></si></sst>")
        head = "".join(f'<c r="{c}1" t="s"><v>{k}</v></c>' for k, c in enumerate("ABCD"))
        row = '<c r="A2"><v>5</v></c><c r="B2" t="inlineStr"><is><t>2025-01-02 03:04:05</t></is></c><c r="C2"><v>45.5</v></c><c r="D2"><v>134.25</v></c>'
        book.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData><row>{head}</row><row>{row}</row></sheetData></worksheet>")
    assert [(r["device"], str(r["time"]), r["lat"], r["lon"]) for r in tables.load(spark, [str(at)]).collect()] == [("5", "2025-01-02 03:04:05", 45.5, 134.25)]


def test_tracks_of_other_formats(spark, tmp_path):
    gpx = write(tmp_path / "a.gpx", '<gpx xmlns="http://www.topografix.com/GPX/1/1"><trk><trkseg><trkpt lat="45" lon="134"><time>2025-01-01T00:00:01Z</time></trkpt><trkpt lat="46" lon="135"><time>2025-01-01T00:00:02Z</time></trkpt></trkseg></trk></gpx>')
    assert [(r["device"], str(r["time"]), r["lat"]) for r in tables.load(spark, [gpx]).orderBy("lat").collect()] == [("0_0", "2025-01-01 00:00:01", 45.0), ("0_0", "2025-01-01 00:00:02", 46.0)]
    kml = write(tmp_path / "a.kml", "<kml><Placemark><LineString><coordinates>134,45,0 135,46,0</coordinates></LineString></Placemark></kml>")
    assert [str(r["time"]) for r in tables.load(spark, [kml]).orderBy("lat").collect()] == ["2000-01-01 00:00:00", "2000-01-01 00:00:01"]
    features = [{"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[134, 45], [135, 46]]}, "properties": {"Device": "q"}}, {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}, "properties": {}}]
    geo = write(tmp_path / "a.geojson", json.dumps({"type": "FeatureCollection", "features": features}))
    assert [(r["device"], r["lat"]) for r in tables.load(spark, [geo]).orderBy("lat").collect()] == [("q", 45.0), ("q", 46.0)]
    assert tables.polygon_rings(spark, [geo]) == [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]]
    body = struct.pack("<i4d2i1i4d", 3, 0, 0, 0, 0, 1, 2, 0, 134.0, 45.0, 135.0, 46.0)
    shp = tmp_path / "a.shp"
    shp.write_bytes(b"\0" * 100 + struct.pack(">2i", 1, len(body) // 2) + body)
    assert [(r["device"], r["lon"]) for r in tables.load(spark, [str(shp)]).orderBy("lon").collect()] == [("f0", 134.0), ("f0", 135.0)]


def test_old_workbooks_and_other_projections(spark, tmp_path):
    folder = tmp_path / "mixed" / "2024-01"
    folder.mkdir(parents=True)
    write(folder / "a.csv", "device;time;lat;lon\n1;2025-01-02 03:04:05;45.5;134.25\n")
    write(folder / "b.xls", "x")
    with pytest.warns(UserWarning, match="xlsx"):
        assert tables.load(spark, str(tmp_path / "mixed")).count() == 1
    point = {"type": "Feature", "geometry": {"type": "Point", "coordinates": [134, 45]}, "properties": {}}
    for name, fine in (("urn:ogc:def:crs:OGC:1.3:CRS84", True), ("urn:ogc:def:crs:EPSG::4326", True), ("urn:ogc:def:crs:EPSG::3857", False)):
        geo = write(tmp_path / f"{name[-4:]}.geojson", json.dumps({"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": name}}, "features": [point]}))
        if fine:
            assert tables.load(spark, [geo]).count() == 1
        else:
            with pytest.raises(Exception, match="only degrees"):
                tables.load(spark, [geo]).collect()
    shp = tmp_path / "p.shp"
    shp.write_bytes(b"\0" * 100 + struct.pack(">2i", 1, 10) + struct.pack("<i2d", 1, 134.0, 45.0))
    for text, fine in (('GEOGCS["GCS_WGS_1984"]', True), ('PROJCS["WGS_1984_UTM_Zone_53N"]', False)):
        write(tmp_path / "p.prj", text)
        if fine:
            assert tables.load(spark, [str(shp)]).count() == 1
        else:
            with pytest.raises(ValueError, match="only degrees"):
                tables.load(spark, [str(shp)])


def test_made_up_times(spark):
    rows = spark.createDataFrame([(0, "a", "2025-01-01 00:00:00", 1.0, 1.0), (1, "a", "what", 1.0, 1.0), (2, "b", None, 1.0, 1.0), (3, "a", None, 1.0, 99.0), (4, "a", None, 1.0, 999.0)], "k long, device string, time string, lat double, lon double")
    got = tables.vector_points(rows, "k", 2.5).collect()
    assert sorted((r["device"], str(r["time"])[-8:]) for r in got) == [("a", "00:00:00"), ("a", "00:00:00"), ("a", "00:00:02"), ("b", "00:00:00")]
    assert tables.vector_points(rows.limit(1), "k").first()["time"].year == 2025


def test_written_files(spark, tmp_path):
    line = [{"x": 134.0, "y": 45.0}, {"x": 134.5, "y": 45.5}]
    nodes = spark.createDataFrame([(1, 134.0, 45.0), (2, 134.5, 45.5)], "id long, x double, y double")
    edges = spark.createDataFrame([(0, 1, 2, line, 1.23456, 3), (1, 1, 9, line[:1], 2.0, 1)], graph.EDGE)
    found = graph.features(edges)
    sinks.write_geojson(found, str(tmp_path / "g"))
    whole = json.loads("".join(r["value"] for r in spark.read.text(str(tmp_path / "g")).collect()))
    assert len(whole["features"]) == 1 and whole["features"][0]["properties"]["length"] == 1.235 and whole["features"][0]["geometry"]["coordinates"][1] == [134.5, 45.5]
    sinks.write_geojson_sequence(found, str(tmp_path / "s"))
    assert tables.read_geojson(spark, [str(tmp_path / "s")]).count() == 2
    sinks.write_graphml(nodes, edges, str(tmp_path / "m"))
    text = "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "m")).collect())
    assert text.count("<node ") == 2 and text.count("<edge ") == 1 and text.endswith("</graphml>")
    points = spark.createDataFrame([("a", None, 1.0, 2.0)], tables.POINTS)
    sinks.save_points(points, str(tmp_path / "c"), run=1)
    assert tables.load_points(spark, str(tmp_path / "c")).count() == 1
    for _ in range(2):
        sinks.append_run(spark, str(tmp_path / "runs"), sinks.run_record("1", {"a": 1}, {"edges": 2}))
    assert [json.loads(r["value"])["stats"] for r in spark.read.text(str(tmp_path / "runs")).collect()] == [{"edges": 2}] * 2
    a, e = graph.line_graph(spark.createDataFrame([(0, line), (1, line[::-1])], "edge long, coords array<struct<x: double, y: double>>"))
    assert a.count() == 2 and e.where("u <> v").count() == 2


def test_vector_files(spark, tmp_path):
    import sqlite3

    line = [{"x": 134.0, "y": 45.0}, {"x": 134.5, "y": 45.5}]
    found = graph.features(spark.createDataFrame([(0, 1, 2, line, 1.23456, 3)], graph.EDGE))
    (path,) = sinks.write_vector(found, str(tmp_path / "roads.gpkg"))
    row = sqlite3.connect(path).execute("SELECT id, frequency, geom FROM roads").fetchone()
    assert row[:2] == (0, 3) and struct.unpack("<2d", row[2][17:33]) == (134.0, 45.0)
    parts = sinks.write_vector(found, str(tmp_path / "roads.shp"))
    assert len(parts) == 4 and [(r["lon"], r["lat"]) for r in tables.read_shp(spark, [parts[0]]).orderBy("lon").collect()] == [(134.0, 45.0), (134.5, 45.5)]
    with pytest.raises(ValueError):
        sinks.write_vector(found, "roads.doc")


def test_run_log(tmp_path):
    from roadweave.plans import runlog

    log = runlog.file_logger(str(tmp_path), "test-log")
    log.info(runlog.stage_line("clean", 1.25, rows=3))
    assert runlog.file_logger(str(tmp_path), "test-log").handlers == log.handlers and "clean 1.2 s rows=3" in (tmp_path / "test-log.log").read_text()
    assert runlog.params_line({"a": 1, "b": 2}, {"a": 1, "b": 1}) == "b=2" and runlog.head_line("1", "x", {"spark": "4"}).endswith("spark 4")
