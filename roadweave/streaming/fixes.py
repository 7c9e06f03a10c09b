"""The same cleaning on streams of fixes (device, time, lat, lon). The batch form has no late data; here a watermark bounds what is remembered."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave.functions.geo import haversine_m
from roadweave.operators.clean import drop_invalid


def deduplicated(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    return drop_invalid(stream).withWatermark("time", late).dropDuplicatesWithinWatermark(["device", "time", "lat", "lon"])


def sessions(stream: DataFrame, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(device, start, end, points) of runs without a gap in time."""
    own = stream.withWatermark("time", late).groupBy("device", F.session_window("time", gap).alias("s")).agg(F.count("*").alias("points"))
    return own.select("device", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "points")


def cell_counts(stream: DataFrame, cell_deg: float = 0.001, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, row, col, points, devices) by hour and cell of degrees; devices approximately."""
    placed = stream.withColumn("row", F.floor(F.col("lat") / cell_deg)).withColumn("col", F.floor(F.col("lon") / cell_deg))
    own = placed.withWatermark("time", late).groupBy(F.window("time", window).alias("w"), "row", "col").agg(F.count("*").alias("points"), F.approx_count_distinct("device").alias("devices"))
    return own.select(F.col("w.start").alias("start"), "row", "col", "points", "devices")


def thinned(stream: DataFrame, min_dist: float = 10.0) -> DataFrame:
    """Fixes that are min_dist or more from the last one kept of their device, in order of arrival within a batch by time."""
    import numpy as np

    from roadweave.functions.geo import EARTH_RADIUS

    def far(a, b) -> bool:
        la, lb = np.radians([a[0], b[0]])
        h = np.sin((lb - la) / 2) ** 2 + np.cos(la) * np.cos(lb) * np.sin(np.radians(b[1] - a[1]) / 2) ** 2
        return 2 * EARTH_RADIUS * np.arcsin(np.sqrt(min(1.0, max(0.0, h)))) >= min_dist

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["time", "lat", "lon"])
        kept = []
        for r in rows.itertuples(index=False):
            if last is None or far(last, (r.lat, r.lon)):
                last = (r.lat, r.lon)
                kept.append((key[0], r.time, r.lat, r.lon))
        if last is not None:
            state.update(last)
        yield pd.DataFrame(kept, columns=["device", "time", "lat", "lon"])

    from pyspark.sql.streaming.state import GroupStateTimeout

    return stream.groupBy("device").applyInPandasWithState(step, "device string, time timestamp, lat double, lon double", "lat double, lon double", "append", GroupStateTimeout.NoTimeout)


def jumps(stream_batch: DataFrame, known: DataFrame, jump_m: float) -> DataFrame:
    """For foreachBatch: fixes of a batch farther than jump_m from the device's last known place (device, lat0, lon0)."""
    both = stream_batch.join(known, "device")
    return both.where(haversine_m(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon")) > jump_m)
