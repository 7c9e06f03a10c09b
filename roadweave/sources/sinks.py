"""What is written: GeoJSON, GraphML, run records, checkpoints."""

import json
import sqlite3
import struct
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def geojson_lines(features: DataFrame) -> DataFrame:
    """(id, feature): a GeoJSON feature per row of ``graph.features``, lengths to 3 places."""
    line = F.transform("coords_lonlat", lambda p: F.array(p["x"], p["y"]))
    properties = F.struct("id", "frequency", F.round("length", 3).alias("length"), "road_class", "reconstructed", "n_devices")
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), line.alias("coordinates")).alias("geometry"), properties.alias("properties"))
    return features.select("id", F.to_json(feature).alias("feature"))


def write_geojson_sequence(features: DataFrame, path: str) -> None:
    """A feature a line, in as many files as partitions: the form for results of any size."""
    geojson_lines(features).select("feature").write.mode("overwrite").text(path)


def write_geojson(features: DataFrame, path: str) -> None:
    """One FeatureCollection in one file: lines are put in order by one task, so for results that fit a file."""
    rows = geojson_lines(features)
    body = rows.select(F.lit(1).alias("part"), "id", F.col("feature").alias("line"))
    first = rows.agg(F.min("id").alias("first"))
    body = body.join(first, F.lit(True)).select("part", "id", F.when(F.col("id") == F.col("first"), F.col("line")).otherwise(F.concat(F.lit(","), "line")).alias("line"))
    spark = features.sparkSession
    frame = spark.createDataFrame([(0, 0, '{"type":"FeatureCollection","features":['), (2, 0, "]}")], "part int, id long, line string")
    body.union(frame).repartition(1).sortWithinPartitions("part", "id").select("line").write.mode("overwrite").text(path)


def positions(nodes: DataFrame) -> DataFrame:
    """(id, x, y): lon and lat where nodes have them, else metres."""
    if {"lon", "lat"} <= set(nodes.columns):
        return nodes.select("id", F.coalesce("lon", "x").alias("x"), F.coalesce("lat", "y").alias("y"))
    return nodes.select("id", "x", "y")


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, a, b, line): part 0 the head, 1 nodes, 2 edges whose ends both have a position, 3 the foot."""
    place = positions(nodes).where("x is not null and y is not null")
    given = edges.columns
    get = lambda c, d: F.col(c) if c in given else F.lit(d)
    own = place.select(F.lit(1).alias("part"), F.col("id").alias("a"), F.lit(0).cast("long").alias("b"), F.format_string('<node id="n%d"><data key="x">%.6f</data><data key="y">%.6f</data></node>', "id", "x", "y").alias("line"))
    known = place.select("id")
    both = edges.join(known.withColumnRenamed("id", "u"), "u", "left_semi").join(known.withColumnRenamed("id", "v"), "v", "left_semi")
    text = F.format_string(
        '<edge source="n%d" target="n%d"><data key="freq">%d</data><data key="len">%.3f</data><data key="rclass">%s</data><data key="recon">%d</data><data key="ndev">%d</data></edge>',
        F.col("u"), F.col("v"), F.col("frequency"), F.col("length"), get("road_class", ""), get("reconstructed", 0), get("n_devices", 0),
    )
    links = both.select(F.lit(2).alias("part"), F.col("u").alias("a"), F.col("edge").alias("b"), text.alias("line"))
    kinds = {"x": ("node", "double"), "y": ("node", "double"), "freq": ("edge", "int"), "len": ("edge", "double"), "rclass": ("edge", "string"), "recon": ("edge", "int"), "ndev": ("edge", "int")}
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">'] + [f'<key id="{k}" for="{of}" attr.name="{k}" attr.type="{kind}"/>' for k, (of, kind) in kinds.items()] + ['<graph id="G" edgedefault="undirected">']
    frame = nodes.sparkSession.createDataFrame([(0, k, 0, x) for k, x in enumerate(head)] + [(3, 0, 0, "</graph>"), (3, 1, 0, "</graphml>")], "part int, a long, b long, line string")
    return frame.union(own).union(links)


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """One file, its lines put in order by one task."""
    graphml_lines(nodes, edges).repartition(1).sortWithinPartitions("part", "a", "b").select("line").write.mode("overwrite").text(path)


def save_points(points: DataFrame, path: str, **meta) -> None:
    points.write.mode("overwrite").parquet(f"{path}/points")
    _meta(points, f"{path}/points.meta", meta)


def save_tracks(tracks: DataFrame, path: str, projection: str = "", **meta) -> None:
    tracks.write.mode("overwrite").parquet(f"{path}/tracks")
    _meta(tracks, f"{path}/tracks.meta", {"projection": projection, **meta})


def _meta(frame: DataFrame, path: str, meta: dict) -> None:
    frame.sparkSession.createDataFrame([(json.dumps(meta, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def run_record(version: str, params: dict, stats: dict) -> str:
    return json.dumps({"time": time.strftime("%Y-%m-%dT%H:%M:%S"), "version": version, "params": params, "stats": stats}, sort_keys=True, default=str)


def append_run(spark, path: str, record: str) -> None:
    """Adds a line to the run manifest, a folder of JSON lines."""
    spark.createDataFrame([(record,)], "value string").coalesce(1).write.mode("append").text(path)


# ---- single files of other formats: built by one task, for results that fit a file


def _polyline_wkb(points: list[tuple[float, float]]) -> bytes:
    return struct.pack("<BII", 1, 2, len(points)) + b"".join(struct.pack("<2d", *p) for p in points)


FIELDS = ("id", "frequency", "length", "road_class", "reconstructed", "n_devices")


def gpkg(rows: list[dict]) -> dict[str, bytes]:
    """A GeoPackage with the layer roads, longitude and latitude."""
    base = sqlite3.connect(":memory:")
    base.executescript("""
        PRAGMA application_id = 1196444487; PRAGMA user_version = 10200;
        CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT);
        INSERT INTO gpkg_spatial_ref_sys VALUES ('WGS 84', 4326, 'EPSG', 4326, 'GEOGCS["WGS 84",DATUM["WGS_1984",SPHEROID["WGS 84",6378137,298.257223563]],PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433]]', NULL),
            ('Undefined cartesian', -1, 'NONE', -1, 'undefined', NULL), ('Undefined geographic', 0, 'NONE', 0, 'undefined', NULL);
        CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT DEFAULT '', last_change TEXT, min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER);
        CREATE TABLE gpkg_geometry_columns (table_name TEXT PRIMARY KEY, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL, z TINYINT NOT NULL, m TINYINT NOT NULL);
        CREATE TABLE roads (fid INTEGER PRIMARY KEY AUTOINCREMENT, geom BLOB, id INTEGER, frequency INTEGER, length REAL, road_class TEXT, reconstructed INTEGER, n_devices INTEGER);
        INSERT INTO gpkg_geometry_columns VALUES ('roads', 'geom', 'LINESTRING', 4326, 0, 0);""")
    every = [p for r in rows for p in r["points"]] or [(0.0, 0.0)]
    x, y = zip(*every)
    base.execute("INSERT INTO gpkg_contents VALUES ('roads', 'features', 'roads', '', '2000-01-01T00:00:00Z', ?, ?, ?, ?, 4326)", (min(x), min(y), max(x), max(y)))
    head = b"GP\0\1" + struct.pack("<i", 4326)
    base.executemany("INSERT INTO roads (geom, id, frequency, length, road_class, reconstructed, n_devices) VALUES (?, ?, ?, ?, ?, ?, ?)", [(head + _polyline_wkb(r["points"]), *(r[f] for f in FIELDS)) for r in rows])
    base.commit()
    return {"gpkg": base.serialize()}


def shapefile(rows: list[dict]) -> dict[str, bytes]:
    """The parts shp, shx, dbf and prj of a shapefile of lines."""
    records, places, at = [], [], 50
    for k, r in enumerate(rows):
        x, y = zip(*r["points"])
        body = struct.pack("<i4d3i", 3, min(x), min(y), max(x), max(y), 1, len(x), 0) + b"".join(struct.pack("<2d", *p) for p in r["points"])
        records.append(struct.pack(">2i", k + 1, len(body) // 2) + body)
        places.append(struct.pack(">2i", at, len(body) // 2))
        at += 4 + len(body) // 2
    every = [p for r in rows for p in r["points"]] or [(0.0, 0.0)]
    x, y = zip(*every)
    head = lambda words: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, words) + struct.pack("<2i8d", 1000, 3, min(x), min(y), max(x), max(y), 0, 0, 0, 0)
    columns = [("id", "N", 18, 0), ("frequency", "N", 10, 0), ("length", "N", 18, 3), ("road_class", "C", 16, 0), ("reconstruc", "N", 4, 0), ("n_devices", "N", 10, 0)]
    width = 1 + sum(c[2] for c in columns)
    dbf = struct.pack("<4BIHH20x", 3, 100, 1, 1, len(rows), 33 + 32 * len(columns), width)
    dbf += b"".join(struct.pack("<11sc4xBB14x", n.encode(), k.encode(), w, d) for n, k, w, d in columns) + b"\r"
    for r in rows:
        cells = [str(r["id"]), str(r["frequency"]), f"{r['length']:.3f}", r["road_class"] or "", str(r["reconstructed"]), str(r["n_devices"])]
        dbf += b" " + b"".join((c.encode().ljust(w) if k == "C" else c.encode().rjust(w))[:w] for c, (_, k, w, _) in zip(cells, columns))
    prj = 'GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]]'
    return {"shp": head(at) + b"".join(records), "shx": head(50 + 4 * len(rows)) + b"".join(places), "dbf": dbf + b"\x1a", "prj": prj.encode()}


FORMATS = {"gpkg": gpkg, "shp": shapefile}


def write_vector(features: DataFrame, path: str) -> list[str]:
    """Writes ``graph.features`` as the format of the path's ending (gpkg, shp) through Hadoop's file systems; the paths of all parts."""
    stem, _, ending = path.rpartition(".")
    if ending not in FORMATS:
        raise ValueError(f"can't write {ending!r}, only {', '.join(FORMATS)}")
    spark = features.sparkSession
    rows = features.select(*FIELDS, F.transform("coords_lonlat", lambda p: F.array(p["x"], p["y"])).alias("points")).orderBy("id").collect()  # one file
    out = []
    for part, content in FORMATS[ending]([r.asDict() | {"points": [tuple(p) for p in r["points"]]} for r in rows]).items():
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{stem}.{part}")
        stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
        stream.write(bytearray(content))
        stream.close()
        out.append(f"{stem}.{part}")
    return out
