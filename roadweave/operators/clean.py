"""Cleaning, thinning, segmentation and resampling of fixes (device, time, lat, lon), as window plans per device.

A device's fixes are ordered by (time, lat, lon), so repeated times have one order everywhere. Undefined speeds are null and drop nothing.
"""

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadweave.functions.geo import EARTH_RADIUS, haversine_m, in_rings

INFINITE = 1.7976931348623157e308


def by_time():
    return Window.partitionBy("device").orderBy("time", "lat", "lon")


def seconds(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1e6)


def drop_invalid(points: DataFrame) -> DataFrame:
    """Fixes with a time and coordinates in range; NaN isn't."""
    return points.where(F.col("lat").between(-90.0, 90.0) & F.col("lon").between(-180.0, 180.0) & F.col("time").isNotNull())


def deduplicate(points: DataFrame) -> DataFrame:
    return points.dropDuplicates(["device", "time", "lat", "lon"])


def steps(points: DataFrame, zero: float | None = INFINITE) -> DataFrame:
    """With step_m, dt_s and speed_mps from the fix before. Speed at dt <= 0: ``zero`` after a move, else null."""
    before = points.withColumn("step_m", haversine_m(F.lag("lat").over(by_time()), F.lag("lon").over(by_time()), F.col("lat"), F.col("lon"))).withColumn("dt_s", seconds(F.col("time"), F.lag("time").over(by_time())))
    standing = F.when(F.col("step_m") > 0, F.lit(zero).cast("double"))
    return before.withColumn("speed_mps", F.when(F.col("dt_s") > 0, F.try_divide("step_m", F.col("dt_s"))).when(F.col("dt_s") <= 0, standing))


def speed_filter(points: DataFrame, v_max_kmh: float = 70.0, a_max: float | None = 4.0) -> DataFrame:
    """Drops a fix that is faster than v_max_kmh from the one before, or changes speed by more than a_max m/s². All is judged on the input."""
    found = steps(points)
    drop = F.col("speed_mps") > v_max_kmh / 3.6
    columns = points.columns
    if a_max is not None:
        earlier = F.lag("speed_mps").over(by_time())
        both = F.col("speed_mps").isNotNull() & F.col("_earlier").isNotNull() & (F.col("dt_s") > 0)
        endless = (F.col("speed_mps") == INFINITE) & (F.col("_earlier") == INFINITE)
        change = F.when(both & ~endless, F.abs(F.try_divide(F.col("speed_mps") - F.col("_earlier"), F.col("dt_s"))))
        found = found.withColumn("_earlier", earlier).withColumn("_n", F.count("*").over(Window.partitionBy("device")))
        drop = drop | ((F.col("_n") > 2) & (change > a_max))
    return found.where(~F.coalesce(drop, F.lit(False))).select(*columns)


def spoof_filter(points: DataFrame, max_speed_kmh: float = 120.0, jump_m: float = 200.0, jump_dt_s: float = 60.0) -> DataFrame:
    """Drops fixes reached too fast, reached by a long jump in a short time, or away and back: far from both neighbours, which are near each other."""
    found = steps(points, 0.0).withColumn("_next", F.lead("step_m").over(by_time()))
    across = haversine_m(F.lag("lat").over(by_time()), F.lag("lon").over(by_time()), F.lead("lat").over(by_time()), F.lead("lon").over(by_time()))
    found = found.withColumn("_across", across)
    fast = F.col("speed_mps") > max_speed_kmh / 3.6
    jump = (F.col("step_m") > jump_m) & (F.col("dt_s") > 0) & (F.col("dt_s") < jump_dt_s)
    spike = (F.col("step_m") > jump_m) & (F.col("_next") > jump_m) & (F.col("_across") < jump_m)
    return found.where(~(F.coalesce(fast, F.lit(False)) | F.coalesce(jump, F.lit(False)) | F.coalesce(spike, F.lit(False)))).select(*points.columns)


def thin_consecutive(points: DataFrame, min_dist: float = 10.0) -> DataFrame:
    """Drops fixes nearer than min_dist to the fix before."""
    if min_dist <= 0:
        return points
    return steps(points).where(F.col("step_m").isNull() | (F.col("step_m") >= min_dist)).select(*points.columns)


def thin_greedy(points: DataFrame, min_dist: float = 10.0) -> DataFrame:
    """Keeps a device's first fix, then each that is min_dist or more from the last one kept. Columns: device, time, lat, lon.

    Devices' fixes pass in order, sorted where they are dealt; all that is remembered is the last fix kept.
    """
    if min_dist <= 0:
        return points
    rows = points.select("device", "time", "lat", "lon")

    def run(batches):
        device, last, begun = None, (0.0, 0.0, 0.0), False
        for batch in batches:
            keep = []
            for own, lat, lon in zip(*(batch.column(c).to_pylist() for c in ("device", "lat", "lon"))):
                here = None if lat is None or lon is None else (math.radians(lat), math.cos(math.radians(lat)), math.radians(lon))
                if not begun or own != device:
                    device, begun, far = own, True, True
                elif here is None or last is None:
                    far = False  # no distance is known
                else:
                    h = math.sin((here[0] - last[0]) / 2) ** 2 + here[1] * last[1] * math.sin((here[2] - last[2]) / 2) ** 2
                    far = 2 * EARTH_RADIUS * math.asin(math.sqrt(min(1.0, max(0.0, h)))) >= min_dist
                keep.append(far)
                if far:
                    last = here
            yield batch.filter(pa.array(keep, pa.bool_()))

    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "device").sortWithinPartitions("device", "time", "lat", "lon").mapInArrow(run, rows.schema)


def segments(points: DataFrame, gap_dt_s: float = 300.0, gap_ds_m: float = 500.0) -> DataFrame:
    """With segment (from 0), track_id and seq (from 0): a new one where the gap in time or space is larger."""
    found = steps(points)
    gap = F.coalesce((F.col("dt_s") > gap_dt_s) | (F.col("step_m") > gap_ds_m), F.lit(False)).cast("int")
    found = found.withColumn("segment", F.sum(gap).over(by_time().rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    within = Window.partitionBy("device", "segment").orderBy("time", "lat", "lon")
    return found.withColumn("track_id", F.concat_ws("#", F.col("device"), F.col("segment").cast("string"))).withColumn("seq", (F.row_number().over(within) - 1).cast("int")).select(*points.columns, "segment", "track_id", "seq")


def long_enough(tracks: DataFrame, least: int = 2) -> DataFrame:
    return tracks.withColumn("_n", F.count("*").over(Window.partitionBy("track_id"))).where(F.col("_n") >= least).drop("_n")


def clip(points: DataFrame, rings: list[list[tuple[float, float]]]) -> DataFrame:
    """Fixes inside a polygon of rings of (lon, lat), holes included as rings; no ring clips nothing."""
    return points.where(in_rings(F.col("lon"), F.col("lat"), rings)) if rings else points


def clean(points: DataFrame, v_max_kmh: float = 70.0, a_max: float | None = 4.0, reb: bool = False) -> tuple[DataFrame, DataFrame]:
    """The cleaned fixes, and one row of counts: input, invalid_removed, duplicates_removed, speed_removed, reb_removed, output."""
    valid = drop_invalid(points)
    unique = deduplicate(valid)
    slow = speed_filter(unique, v_max_kmh, a_max)
    out = spoof_filter(slow) if reb else slow
    counts = [f.agg(F.count("*").alias("n")).select(F.lit(k).alias("k"), "n") for k, f in enumerate((points, valid, unique, slow, out))]
    every = counts[0]
    for c in counts[1:]:
        every = every.union(c)
    n = [F.max(F.when(F.col("k") == k, F.col("n"))) for k in range(5)]
    stats = every.agg(n[0].alias("input"), (n[0] - n[1]).alias("invalid_removed"), (n[1] - n[2]).alias("duplicates_removed"), (n[2] - n[3]).alias("speed_removed"), (n[3] - n[4]).alias("reb_removed"), n[4].alias("output"))
    return out, stats


def arc_length(tracks: DataFrame) -> DataFrame:
    """With at_m, the way along each track (x, y by seq) so far, and seg_m from the point before."""
    by = Window.partitionBy("track_id").orderBy("seq")
    found = tracks.withColumn("seg_m", F.coalesce(F.hypot(F.col("x") - F.lag("x").over(by), F.col("y") - F.lag("y").over(by)), F.lit(0.0)))
    return found.withColumn("at_m", F.sum("seg_m").over(by.rowsBetween(Window.unboundedPreceding, 0)))


def resample(tracks: DataFrame, step: float) -> DataFrame:
    """Equidistant points (track_id, seq, x, y): total / step steps, rounded half to even, one at least. A track without length is one point.

    Each segment makes the points that lie on it, so a long track isn't gathered anywhere.
    """
    if step <= 0:
        raise ValueError("step must be positive")
    by = Window.partitionBy("track_id").orderBy("seq")
    found = arc_length(tracks).withColumn("_total", F.max("at_m").over(Window.partitionBy("track_id")))
    found = found.withColumn("_x0", F.lag("x").over(by)).withColumn("_y0", F.lag("y").over(by)).withColumn("_a0", F.lag("at_m").over(by)).withColumn("_first", F.row_number().over(by) == 1)
    steps_ = F.greatest(F.lit(1.0), F.rint(F.col("_total") / step))
    first = found.where("_first").select("track_id", F.lit(0).cast("long").alias("seq"), "x", "y")
    lo = F.floor(F.try_divide(F.col("_a0") * F.col("_n"), F.col("_total"))).cast("long") + 1
    hi = F.when(F.col("at_m") >= F.col("_total"), F.col("_n").cast("long")).otherwise(F.floor(F.try_divide(F.col("at_m") * F.col("_n"), F.col("_total"))).cast("long"))
    rest = found.where("not _first and _total > 0 and seg_m > 0").withColumn("_n", steps_).withColumn("_lo", lo).withColumn("_hi", hi).where("_hi >= _lo")
    rest = rest.withColumn("seq", F.explode(F.sequence("_lo", "_hi")))
    share = F.least(F.lit(1.0), F.try_divide(F.col("seq") * F.col("_total") / F.col("_n") - F.col("_a0"), F.col("seg_m")))
    rest = rest.select("track_id", "seq", (F.col("_x0") + share * (F.col("x") - F.col("_x0"))).alias("x"), (F.col("_y0") + share * (F.col("y") - F.col("_y0"))).alias("y"))
    return first.union(rest)


def pack(tracks: DataFrame) -> DataFrame:
    """(track_id, coords) with the points by seq; ``unpack`` undoes it."""
    inner = F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return tracks.groupBy("track_id").agg(inner.alias("coords"))


def unpack(packed: DataFrame) -> DataFrame:
    return packed.select("track_id", F.posexplode("coords").alias("seq", "p")).select("track_id", F.col("seq").cast("long").alias("seq"), "p.x", "p.y")


def extent(points: DataFrame) -> DataFrame:
    """One row: circular mean of lon, mean of lat, smallest arc of lon that covers all, whether it crosses 180°, bounds of lat."""
    # the arc needs the largest gap between neighbours on the circle; rounded longitudes keep the ordered set small at any size
    turns = points.select(F.pmod(F.round("lon", 4), F.lit(360.0)).alias("a")).distinct()
    part = turns.groupBy(F.floor(F.col("a")).alias("deg")).agg(F.min("a").alias("lo"), F.max("a").alias("hi"), F.array_sort(F.collect_set("a")).alias("own"))
    inner = F.aggregate(F.zip_with(F.slice("own", 1, F.greatest(F.size("own") - 1, F.lit(0))), F.slice("own", 2, F.greatest(F.size("own") - 1, F.lit(0))), lambda x, y: y - x), F.lit(0.0), lambda m, x: F.greatest(m, x))
    part = part.withColumn("inner", inner)
    order = Window.orderBy("deg")  # at most 360 rows
    part = part.withColumn("gap", F.coalesce(F.col("lo") - F.lag("hi").over(order), F.lit(0.0)))
    arc = part.agg(F.greatest(F.max("inner"), F.max("gap"), 360.0 - F.max("hi") + F.min("lo")).alias("gap")).select((360.0 - F.col("gap")).alias("arc"))
    mean = points.agg(
        F.degrees(F.atan2(F.avg(F.sin(F.radians("lon"))), F.avg(F.cos(F.radians("lon"))))).alias("center_lon"), F.avg("lat").alias("center_lat"),
        F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max"), F.min("lon").alias("lon_min"), F.max("lon").alias("lon_max"),
    )
    # both sides are one row
    return mean.join(arc, F.lit(True)).withColumn("antimeridian", (F.col("lon_max") - F.col("lon_min") > 180.0) & (F.col("arc") < 180.0))
