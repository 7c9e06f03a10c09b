"""What is read: delimited files, workbooks, GPX, KML, GeoJSON, shapefiles and checkpoints, all as fixes (device, time, lat, lon)."""

import re
import struct
import warnings
import zipfile
from functools import reduce
from io import BytesIO
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINTS = T.StructType([T.StructField("device", T.StringType()), T.StructField("time", T.TimestampType()), T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])

#: Names that columns have in files, the first that is there counts.
ALIASES = {
    "device": ("device_id", "device", "deviceid", "id", "unit", "unit_id", "imei", "object", "object_id", "track_fid", "track_seg_id", "машина", "устройство"),
    "time": ("navigation_dttm", "time", "datetime", "timestamp", "dttm", "date_time", "dt", "время", "дата"),
    "lat": ("lat", "latitude", "y", "широта"),
    "lon": ("lon", "lng", "long", "longitude", "x", "долгота"),
}
#: Delimiters in order of preference; forms of times, and the flexible day-first one.
DELIMITERS = (";", "/", "\t", "|", ",")
TIMES = ("yyyy-M-d H:m:s", "yyyy-M-d H:m", "yyyy-M-d'T'H:m:s", "d.M.yyyy H:m:s", "d.M.yyyy H:m", "d.M.yyyy")
FLEXIBLE = ("d/M/yyyy H:m:s", "d/M/yyyy H:m", "d/M/yyyy", "d-M-yyyy H:m:s", "d-M-yyyy H:m", "yyyy/M/d H:m:s", "yyyy/M/d H:m", "yyyy-M-d", "yyyy-M-d'T'H:m:s.SSS", "yyyy-M-d'T'H:m:ssXXX", "yyyy-M-d'T'H:m:s.SSSXXX")


def normal_name(name: str) -> str:
    return name.strip().strip("\"'").strip().lower()


def detect_columns(names: list[str]) -> dict[str, str]:
    """Role to column name: for each role the first alias that a header has."""
    by_name: dict[str, str] = {}
    for n in names:
        by_name.setdefault(normal_name(n), n)
    return {role: next(by_name[a] for a in own if a in by_name) for role, own in ALIASES.items() if any(a in by_name for a in own)}


def mapping(names: list[str], given: dict[str, str] | None = None) -> dict[str, str]:
    found = given or detect_columns(names)
    missing = [role for role in ALIASES if role not in found]
    if missing:
        raise ValueError(f"no column for {', '.join(missing)} among {', '.join(names)}")
    return found


def sniff_delimiter(line: str) -> str:
    """The most frequent delimiter of a header; of equal ones the first by preference; ; if there is none."""
    return max(DELIMITERS, key=lambda d: (line.count(d), -DELIMITERS.index(d))) if any(d in line for d in DELIMITERS) else ";"


def parse_times(text: Column, form: str | None = None) -> Column:
    """A time in that form, or in the first of all that fits."""
    forms = (form,) if form else (*TIMES, *FLEXIBLE)
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in forms))


def best_form(rows: DataFrame, column: str) -> str | None:
    """The form that most values fit, if 80 % do; else none, for any form. The earlier of equals."""
    shares = rows.agg(*(F.avg(F.when(F.try_to_timestamp(F.trim(column), F.lit(f)).isNotNull(), 1.0).otherwise(0.0)).alias(str(k)) for k, f in enumerate(TIMES))).first()
    share, k = max(((s or 0.0), -k) for k, s in enumerate(shares))
    return TIMES[-k] if share >= 0.8 else None


def normalize(rows: DataFrame, given: dict[str, str] | None = None) -> DataFrame:
    """Raw text rows as fixes: roles by name, numbers and times parsed, rows without a place or time left out. A missing device is 'nan'."""
    roles = mapping(rows.columns, given)
    raw = rows.select(*(F.col(f"`{roles[r]}`").cast("string").alias(r) for r in ALIASES))
    form = best_form(raw, "time")
    number = lambda c: F.trim(F.col(c)).try_cast("double")
    out = raw.select(F.coalesce(F.trim("device"), F.lit("nan")).alias("device"), parse_times(F.trim(F.col("time")), form).alias("time"), number("lat").alias("lat"), number("lon").alias("lon"))
    return out.dropna(subset=["time", "lat", "lon"])


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], POINTS)


def list_files(spark: SparkSession, root: str, endings: tuple[str, ...] = ("csv", "xlsx", "xls")) -> DataFrame:
    """(month, path) of data files under a folder, sorted by path; month is the name of the folder that holds the file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    kept = files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*endings))
    return kept.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("month"), "path").orderBy("path")


def headers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, header): the first line of each file that isn't blank."""
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("k"), "value").where(F.trim("value") != "")
    return lines.groupBy("path").agg(F.min_by("value", F.struct("block", "k")).alias("header"))


def read_csv(spark: SparkSession, paths: list[str], given: dict[str, str] | None = None, encoding: str = "utf-8") -> DataFrame:
    """All files' fixes; files with the same delimiter and header are one scan, without inferring types. Rows with too many fields are dropped."""
    groups: dict[str, list[str]] = {}
    for row in headers(spark, paths).collect():  # a line for each file
        groups.setdefault(row["header"], []).append(row["path"])
    parts = []
    for header, own in sorted(groups.items()):
        sep = sniff_delimiter(header)
        names = [normal_name(n) or f"_{k}" for k, n in enumerate(header.lstrip("﻿").split(sep))]
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names] + [T.StructField("_broken", T.StringType())])
        rows = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("sep", sep).option("encoding", encoding).option("mode", "PERMISSIVE").option("columnPruning", False).option("columnNameOfCorruptRecord", "_broken").csv(sorted(own))
        wide = F.coalesce(F.size(F.split("_broken", re.escape(sep))) > len(names), F.lit(False))
        parts.append(normalize(rows.where(~wide).drop("_broken"), given))
    return reduce(DataFrame.unionByName, parts) if parts else empty(spark)


def load(spark: SparkSession, source, given: dict[str, str] | None = None, encoding: str = "utf-8") -> DataFrame:
    """Fixes from a frame, a folder or a list of files, by their endings; nothing gives no rows. Old workbooks (.xls) of a folder are left out with a warning."""
    if source is None:
        return empty(spark)
    if isinstance(source, DataFrame):
        return normalize(source, given) if set(source.columns) != set(POINTS.names) else source.select(*POINTS.names)
    paths = [source] if isinstance(source, str) else list(source)
    if isinstance(source, str) and "." not in source.rsplit("/", 1)[-1]:
        paths = [r["path"] for r in list_files(spark, source).collect()]  # names, not rows
        old = [p for p in paths if p.lower().endswith(".xls")]
        if old:  # a binary format of its own, which no library here reads
            warnings.warn(f"left out {len(old)} old workbooks, save them as .xlsx: {', '.join(sorted(old)[:5])}", stacklevel=2)
            paths = [p for p in paths if p not in set(old)]
    readers = {"csv": lambda p: read_csv(spark, p, given, encoding), "txt": lambda p: read_csv(spark, p, given, encoding), "xlsx": lambda p: read_xlsx(spark, p, given), "gpx": lambda p: read_gpx(spark, p), "kml": lambda p: read_kml(spark, p), "geojson": lambda p: read_geojson(spark, p), "json": lambda p: read_geojson(spark, p), "shp": lambda p: read_shp(spark, p)}
    by_ending: dict[str, list[str]] = {}
    for p in paths:
        by_ending.setdefault(p.rsplit(".", 1)[-1].lower(), []).append(p)
    unknown = set(by_ending) - set(readers)
    if unknown:
        raise ValueError(f"can't read {', '.join(sorted(unknown))}")
    parts = [readers[e](sorted(p)) for e, p in sorted(by_ending.items())]
    return reduce(DataFrame.unionByName, parts) if parts else empty(spark)


def _files(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(paths).select("path", "content")


def sheet_rows(content: bytes) -> list[list[str]]:
    """The cells of a workbook's first sheet as text."""
    book = zipfile.ZipFile(BytesIO(content))
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{ns}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{ns}si")]
    sheet = min(n for n in book.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))
    rows = []
    for row in ElementTree.fromstring(book.read(sheet)).iter(f"{ns}row"):
        cells: dict[int, str] = {}
        for c in row.iter(f"{ns}c"):
            letters = re.match(r"[A-Z]+", c.get("r", ""))
            at = len(cells) if not letters else sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(letters[0]))) - 1
            value = c.find(f"{ns}v")
            if c.get("t") == "inlineStr":
                cells[at] = "".join(t.text or "" for t in c.iter(f"{ns}t"))
            elif value is not None:
                cells[at] = shared[int(value.text)] if c.get("t") == "s" else value.text or ""
        rows.append([cells.get(k, "") for k in range(max(cells, default=-1) + 1)])
    return rows


def read_xlsx(spark: SparkSession, paths: list[str], given: dict[str, str] | None = None) -> DataFrame:
    """Fixes from the first sheet of each workbook, one task a file: the format can't be split."""

    def run(batches):
        for batch in batches:
            for content in batch.column("content").to_pylist():
                head, *rows = sheet_rows(content) or [[]]
                roles = mapping(head, given)
                at = {r: head.index(n) for r, n in roles.items()}
                get = lambda row, r: row[at[r]] if at[r] < len(row) else None
                yield pa.RecordBatch.from_arrays([pa.array([get(x, r) for x in rows], pa.string()) for r in ALIASES], list(ALIASES))

    return normalize(_files(spark, paths).mapInArrow(run, "device string, time string, lat string, lon string"), {r: r for r in ALIASES})


def synthesize_times(rows: DataFrame, order: str, step_s: float = 1.0, part: str | None = None) -> DataFrame:
    """With time: 2000-01-01 and step_s (whole seconds) for each row of a run of one device in that order; ``part`` keeps the runs of parts apart."""
    own = [part] if part else []
    by = Window.partitionBy(*own).orderBy(order)
    new = (~F.col("device").eqNullSafe(F.lag("device").over(by)) | (F.row_number().over(by) == 1)).cast("int")
    run = rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.row_number().over(Window.partitionBy(*own, "_run").orderBy(order)) - 1
    return run.withColumn("time", F.timestamp_micros(F.lit(946684800000000).cast("long") + place.cast("long") * int(step_s) * 1_000_000)).drop("_new", "_run")


def vector_points(rows: DataFrame, order: str, step_s: float = 1.0) -> DataFrame:
    """Rows (device, lat, lon, time as text or null) as fixes: places out of range go; if any time can't be read, all times are made up."""
    kept = rows.where(F.col("lat").between(-90.0, 90.0) & F.col("lon").between(-180.0, 180.0))
    read = kept.withColumn("_read", parse_times(F.trim(F.col("time").cast("string"))))
    missing = read.where("_read is null").limit(1).count() > 0
    if not missing:
        return read.select("device", F.col("_read").alias("time"), "lat", "lon")
    return synthesize_times(kept.drop("time"), order, step_s, "_file" if "_file" in kept.columns else None).select(*POINTS.names)


VERTICES = "_file string, _k long, device string, time string, lat double, lon double"


def _vertices(spark: SparkSession, paths: list[str], parse) -> DataFrame:
    """Fixes of files that ``parse(bytes)`` reads as (device, time, lat, lon), one task a file."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                rows = [(path, k, *r) for k, r in enumerate(parse(content))]
                columns = list(zip(*rows)) if rows else [[]] * 6
                kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["_file", "_k", "device", "time", "lat", "lon"])

    return vector_points(_files(spark, paths).mapInArrow(run, VERTICES), "_k")


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def gpx_points(content: bytes):
    """Track points; the device is the number of the track and of its part."""
    for t, track in enumerate(e for e in ElementTree.fromstring(content).iter() if _local(e.tag) == "trk"):
        for s, part in enumerate(e for e in track if _local(e.tag) == "trkseg"):
            for p in part:
                if _local(p.tag) == "trkpt":
                    when = next((e.text for e in p if _local(e.tag) == "time"), None)
                    yield f"{t}_{s}", (when or "").rstrip("Z") or None, float(p.get("lat")), float(p.get("lon"))


def kml_points(content: bytes):
    """Vertices of points and lines; the device is f and the number of the line."""
    lines = [e for e in ElementTree.fromstring(content).iter() if _local(e.tag) in ("LineString", "Point")]
    for k, line in enumerate(lines):
        for text in next((e.text or "" for e in line if _local(e.tag) == "coordinates"), "").split():
            lon, lat, *_ = map(float, text.split(","))
            yield f"f{k}", None, lat, lon


def shp_points(content: bytes):
    """Vertices of points and lines of a shapefile in degrees; polygons are left out."""
    at, k = 100, 0
    while at + 8 <= len(content):
        size = struct.unpack(">i", content[at + 4 : at + 8])[0] * 2
        body = content[at + 8 : at + 8 + size]
        at += 8 + size
        kind = struct.unpack("<i", body[:4])[0] if len(body) >= 4 else 0
        if kind in (1, 11, 21):
            lon, lat = struct.unpack("<2d", body[4:20])
            yield f"f{k}", None, lat, lon
        elif kind in (3, 13, 23):
            parts, points = struct.unpack("<2i", body[36:44])
            for i in range(points):
                lon, lat = struct.unpack_from("<2d", body, 44 + 4 * parts + 16 * i)
                yield f"f{k}", None, lat, lon
        k += 1


def read_gpx(spark: SparkSession, paths: list[str]) -> DataFrame:
    return _vertices(spark, paths, gpx_points)


def read_kml(spark: SparkSession, paths: list[str]) -> DataFrame:
    return _vertices(spark, paths, kml_points)


def read_shp(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Fixes of shapefiles in degrees; a projection file beside one that says otherwise is an error."""
    sc = spark.sparkContext
    beside = [sc._jvm.org.apache.hadoop.fs.Path(p[: -len(".shp")] + ".prj") for p in paths]
    beside = [p.toString() for p in beside if p.getFileSystem(sc._jsc.hadoopConfiguration()).exists(p)]
    for row in spark.read.text(beside, wholetext=True).select("value", "_metadata.file_path").collect() if beside else ():  # a line for each file
        if not row["value"].lstrip().upper().startswith(("GEOGCS", "GEOGCRS")) or "WGS" not in row["value"].upper():
            raise ValueError(f"{row['file_path']}: only degrees of WGS 84 are read")
    return _vertices(spark, paths, shp_points)


GEOMETRY = "type string, coordinates string"


def geojson_geometries(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(_file, _k, device, time, kind, coordinates as JSON) of each feature, of collections or one a line."""
    raw = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("_file"), "value")
    feature = "struct<geometry: struct<type: string, coordinates: string>, properties: map<string, string>>"
    whole = F.from_json("value", f"struct<features: array<{feature}>>")["features"]
    lines = F.transform(F.filter(F.split("value", "\n"), lambda x: F.trim(x) != ""), lambda x: F.from_json(x, feature))
    crs = F.get_json_object("value", "$.crs.properties.name")
    degrees = crs.isNull() | crs.rlike("(4326|CRS84)$")
    rows = raw.select("_file", F.posexplode(F.when(degrees, F.coalesce(whole, lines)).otherwise(F.raise_error(F.concat("_file", F.lit(": only degrees of WGS 84 are read, not "), crs)))).alias("_k", "f")).where("f.geometry is not null")
    named = F.map_from_entries(F.transform(F.map_entries("f.properties"), lambda e: F.struct(F.lower(e["key"]), e["value"])))
    pick = lambda names: F.coalesce(*(F.try_element_at(named, F.lit(n)) for n in names))
    return rows.select("_file", "_k", F.coalesce(pick(ALIASES["device"]), F.concat(F.lit("f"), F.col("_k").cast("string"))).alias("device"), pick(ALIASES["time"]).alias("time"), F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"))


def read_geojson(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Fixes of points and of lines' vertices; polygons are left out."""
    rows = geojson_geometries(spark, paths)
    line = F.from_json("coordinates", "array<array<double>>")
    points = F.when(F.col("kind") == "Point", F.array(F.from_json("coordinates", "array<double>"))).when(F.col("kind").isin("LineString", "MultiPoint"), line).when(F.col("kind") == "MultiLineString", F.flatten(F.from_json("coordinates", "array<array<array<double>>>")))
    out = rows.select("_file", "device", "time", F.col("_k").alias("_f"), F.posexplode(points).alias("_p", "c"))
    return vector_points(out.select("_file", (F.col("_f").cast("long") * (1 << 32) + F.col("_p")).alias("_k"), "device", "time", F.col("c")[1].alias("lat"), F.col("c")[0].alias("lon")), "_k")


def polygon_rings(spark: SparkSession, paths: list[str]) -> list[list[tuple[float, float]]]:
    """All rings of the polygons of a small area file, for ``clean.clip``."""
    rows = geojson_geometries(spark, paths)
    rings = F.when(F.col("kind") == "Polygon", F.from_json("coordinates", "array<array<array<double>>>")).when(F.col("kind") == "MultiPolygon", F.flatten(F.from_json("coordinates", "array<array<array<array<double>>>>")))
    found = rows.select(F.explode(rings).alias("r")).collect()  # a drawn outline
    return [[(p[0], p[1]) for p in (r["r"][:-1] if r["r"][0] == r["r"][-1] else r["r"])] for r in found]


def load_points(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/points")


def load_tracks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/tracks")
