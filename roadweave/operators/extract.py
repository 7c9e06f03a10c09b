"""From tracks to a road graph, tile by tile: grouped functions around the array kernels, frames before and after."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave.functions import polyline
from roadweave.kernels import skeleton as lines
from roadweave.kernels import slide as ridge
from roadweave.operators import density, graph

POINT = "tile int, track_id string, seq long, x double, y double"
PIXELS = "tile int, edge long, u long, v long, ur long, uc long, vr long, vc long, pixels array<struct<x: double, y: double>>"


#: Points of a sliding task, where the tile has no more cells: every task gets the whole field of its tile.
TASK_POINTS = 20_000


def dense(cells: pd.DataFrame, height: int, width: int, dtype=float) -> np.ndarray:
    out = np.zeros((height, width), dtype)
    if len(cells):
        out[cells["row"].to_numpy(), cells["col"].to_numpy()] = cells["v"].to_numpy() if "v" in cells else True
    return out


def refine(tracks: DataFrame, cell: float, sigma: float, sharpness: float, weights=ridge.WEIGHTS, rounds=ridge.ROUNDS, most: int = 400_000) -> DataFrame:
    """Tracks (tile, track_id, seq, x, y) moved onto the ridges of their tile's density, smoothed by sigma cells.

    Each track moves for itself, so a tile is dealt out by track to tasks of about as many points as it has cells, TASK_POINTS at
    least and ``most`` at most, each with the tile's field.
    """
    meta = density.grid(tracks, cell)
    share = F.least(F.lit(most), F.greatest(F.lit(TASK_POINTS), F.first("width") * F.first("height")))
    parts = tracks.select("tile").join(F.broadcast(meta), "tile").groupBy("tile").agg(F.ceil(F.count("*") / share).cast("int").alias("parts")).checkpoint()
    smoothed = density.smooth(density.density(tracks, meta), meta, sigma, sharpness)
    # rounded, so that a sum's order doesn't decide where steep slopes carry a track
    smoothed = smoothed.withColumn("v", F.round("v", 9))
    field = smoothed.join(F.broadcast(meta), "tile").join(F.broadcast(parts), "tile").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    field = field.select(*(F.col(c).alias(c) for c in field.columns))  # columns of its own, as both sides come from the tracks

    def run(points: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        if not len(points) or not len(cells):
            return points[["tile", "track_id", "seq", "x", "y"]]
        m = cells.iloc[0]
        points = points.sort_values(["track_id", "seq"], kind="stable")
        names, first = np.unique(points["track_id"].to_numpy().astype(str), return_index=True)
        parts = np.split(points[["x", "y"]].to_numpy(), first[1:])
        moved = ridge.slide(parts, dense(cells, int(m["height"]), int(m["width"])), m["ox"], m["oy"], cell, weights, rounds)
        out = points[["tile", "track_id", "seq"]].copy()
        out[["x", "y"]] = np.concatenate(moved)
        return out

    dealt = tracks.select("tile", "track_id", F.col("seq").cast("long").alias("seq"), "x", "y").join(F.broadcast(parts), "tile")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("track_id"), F.col("parts")).cast("int")).drop("parts")
    return dealt.groupBy("tile", "part").cogroup(field.groupBy("tile", "part")).applyInPandas(run, POINT)


def skeletons(mask: DataFrame, meta: DataFrame) -> DataFrame:
    """(tile, edge, u, v, places of u and v, pixels): the pixel graph of each tile's thinned mask. Ids count within the tile."""

    def run(cells: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(cells["row"].min()), int(cells["col"].min())
        local = cells.assign(row=cells["row"] - r0, col=cells["col"] - c0)
        thin = lines.zhang_suen(dense(local, int(local["row"].max()) + 1, int(local["col"].max()) + 1, bool))
        nodes, edges = lines.pixel_graph(thin)
        tile = int(cells["tile"].iloc[0])
        rows = [(tile, k, u, v, nodes[u][0] + r0, nodes[u][1] + c0, nodes[v][0] + r0, nodes[v][1] + c0, [{"x": float(c + c0), "y": float(r + r0)} for r, c in path]) for k, (u, v, path) in enumerate(edges)]
        return pd.DataFrame(rows, columns=["tile", "edge", "u", "v", "ur", "uc", "vr", "vc", "pixels"])

    return mask.select("tile", "row", "col").groupBy("tile").applyInPandas(run, PIXELS)


def world_graph(pixels: DataFrame, tracks: DataFrame, meta: DataFrame, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges (with tile) in metres: frequencies from the tracks, lines simplified within the tolerance.

    A point counts for a pixel nearer than two cells; an edge's inner pixels count, both ends of one of two pixels.
    """
    name = F.col("tile").cast("long") * F.lit(1 << 40) + F.col("edge")
    inner = F.when(F.size("pixels") >= 3, F.slice("pixels", 2, F.greatest(F.size("pixels") - 2, F.lit(0)))).otherwise(F.col("pixels"))
    spots = pixels.select("tile", name.alias("edge"), F.posexplode(inner).alias("k", "p"))
    # tiles lie apart from each other for the join, as each has a grid of its own
    apart = F.col("tile") * 1e7
    spots = spots.select("edge", "k", (F.col("p.x") + apart).alias("x"), F.col("p.y").alias("y"))
    points = tracks.join(F.broadcast(meta), "tile").select("track_id", ((F.col("x") - F.col("ox")) / F.col("cell") + apart).alias("x"), ((F.col("y") - F.col("oy")) / F.col("cell")).alias("y"))
    seen = graph.frequencies(spots, points)
    placed = pixels.join(meta, "tile")
    to_world = lambda p: polyline.point(F.col("ox") + (p["x"] + 0.5) * F.col("cell"), F.col("oy") + (p["y"] + 0.5) * F.col("cell"))
    drawn = placed.withColumn("name", name).withColumn("coords", polyline.simplify(tolerance)(F.transform("pixels", to_world)))
    edges = drawn.join(seen.withColumnRenamed("edge", "name"), "name", "left").select("tile", "edge", "u", "v", "coords", polyline.length(F.col("coords")).alias("length"), F.coalesce("frequency", F.lit(0)).alias("frequency"))
    ends = F.explode(F.array(F.struct(F.col("u").alias("id"), F.col("ur").alias("r"), F.col("uc").alias("c")), F.struct(F.col("v").alias("id"), F.col("vr").alias("r"), F.col("vc").alias("c"))))
    nodes = placed.select("tile", "ox", "oy", "cell", ends.alias("n")).select("tile", "n.id", (F.col("ox") + (F.col("n.c") + 0.5) * F.col("cell")).alias("x"), (F.col("oy") + (F.col("n.r") + 0.5) * F.col("cell")).alias("y")).distinct()
    return nodes, edges
