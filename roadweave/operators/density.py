"""Sparse rasters: a grid is one row (ox, oy, cell, width, height), its values rows (row, col, v) for cells that aren't 0.

All operators take ``tile`` columns along if the frame has one: each tile is a raster of its own.
"""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MARGIN = 3
MAX_CELLS = 120_000_000


def keys(frame: DataFrame) -> list[str]:
    return [c for c in ("tile",) if c in frame.columns]


def grid(points: DataFrame, cell: float, margin: int = MARGIN, most: int = MAX_CELLS) -> DataFrame:
    """The grid over x and y: from ``margin`` cells below the least to ``margin`` and one above. Fails beyond ``most`` cells."""
    if cell <= 0:
        raise ValueError("cell must be positive")
    bounds = points.groupBy(*keys(points)).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).where("x0 is not null")
    size = lambda a, b: (F.ceil((F.col(b) - F.col(a)) / cell) + 2 * margin + 1).cast("long")
    out = bounds.select(*keys(points), (F.col("x0") - margin * cell).alias("ox"), (F.col("y0") - margin * cell).alias("oy"), F.lit(float(cell)).alias("cell"), size("x0", "x1").alias("width"), size("y0", "y1").alias("height"))
    few = F.col("width") * F.col("height") <= most
    return out.withColumn("width", F.when(few, F.col("width")).otherwise(F.raise_error(F.concat(F.lit("a raster of "), (F.col("width") * F.col("height")).cast("string"), F.lit(" cells; take larger cells or tiles"))).cast("long")))


def on_grid(points: DataFrame, meta: DataFrame) -> DataFrame:
    """Points with row and col; those outside are left out. ``meta``, a row for each tile, goes to all tasks, so points aren't shuffled."""
    both = points.join(F.broadcast(meta), keys(points)) if keys(points) else points.join(meta, F.lit(True))  # one row of meta
    placed = both.withColumn("row", F.floor((F.col("y") - F.col("oy")) / F.col("cell")).cast("long")).withColumn("col", F.floor((F.col("x") - F.col("ox")) / F.col("cell")).cast("long"))
    return placed.where("row >= 0 and row < height and col >= 0 and col < width").select(*points.columns, "row", "col")


def density(points: DataFrame, meta: DataFrame, mode: str = "tracks") -> DataFrame:
    """v: distinct tracks with a point in the cell, or points."""
    if mode not in ("tracks", "points"):
        raise ValueError(f"mode {mode!r}")
    placed = on_grid(points, meta)
    if mode == "tracks":  # distinct first: a busy cell is counted in parts
        placed = placed.select(*keys(points), "row", "col", "track_id").distinct()
    return placed.groupBy(*keys(points), "row", "col").agg(F.count("*").cast("double").alias("v"))


def sharpened(sigma: float, sharpness: float = 1.5) -> list[float]:
    """Weights from -ceil(3.5 sigma) on: a straight rise within sigma of the centre, exp(-(i / sigma)²) beyond; their sum is 1."""
    if sigma <= 0:
        return [1.0]
    foot = math.exp(-0.5)
    half = [foot + sharpness * sigma * (1 - i / sigma) if i < sigma else math.exp(-((i / sigma) ** 2)) for i in range(math.ceil(3.5 * sigma) + 1)]
    every = half[:0:-1] + half
    return [w / sum(every) for w in every]


def gaussian(sigma: float) -> list[float]:
    radius = int(4 * sigma + 0.5)
    every = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-radius, radius + 1)]
    return [w / sum(every) for w in every]


def convolve(cells: DataFrame, meta: DataFrame, weights: list[float]) -> DataFrame:
    """Rows, then columns, with what lies outside the grid as 0. Each pass hands a cell's value to the cells around it and adds up."""
    half = len(weights) // 2
    spread = F.array(*(F.struct(F.lit(k - half).cast("long").alias("d"), F.lit(w).alias("w")) for k, w in enumerate(weights)))
    own = keys(cells)
    shape = meta.select(*own, "width", "height")
    for along, size in (("row", "height"), ("col", "width")):
        across = "col" if along == "row" else "row"
        given = cells.join(shape, own) if own else cells.join(shape, F.lit(True))
        given = given.withColumn("s", F.explode(spread)).withColumn(along, F.col(along) + F.col("s.d")).where((F.col(along) >= 0) & (F.col(along) < F.col(size)))
        cells = given.groupBy(*own, along, across).agg(F.sum(F.col("v") * F.col("s.w")).alias("v"))
    return cells.select(*own, "row", "col", "v")


def smooth(cells: DataFrame, meta: DataFrame, sigma: float, sharpness: float = 1.5) -> DataFrame:
    return convolve(cells, meta, sharpened(sigma, sharpness))


def kde(points: DataFrame, meta: DataFrame, cell: float, radius_m: float = 50.0) -> DataFrame:
    """Counts of points under a Gaussian of ``radius_m``, half a cell at least."""
    return convolve(density(points, meta, "points"), meta, gaussian(max(0.5, radius_m / cell)))


def gradient(cells: DataFrame, meta: DataFrame) -> DataFrame:
    """gx and gy per cell: half the difference of the neighbours, at the border the whole difference to the one. Cells where both are 0 are left out."""
    own = keys(cells)
    shape = meta.select(*own, "width", "height")
    given = cells.join(shape, own) if own else cells.join(shape, F.lit(True))
    parts = []
    for name, along, size in (("gx", "col", "width"), ("gy", "row", "height")):
        last = F.col(size) - 1
        # to the cell below and above, and at a border to itself: (cell, share of v)
        to = lambda at, w: F.struct(at.cast("long").alias("at"), w.cast("double").alias("w"))
        p, border = F.col(along), lambda at: F.when((at == 0) | (at == last), 1.0).otherwise(0.5)
        gifts = F.array(to(p - 1, border(p - 1)), to(p + 1, -border(p + 1)), to(p, F.when(p == 0, -1.0).when(p == last, 1.0).otherwise(0.0)))
        own_part = given.where(F.col(size) > 1).withColumn("g", F.explode(gifts)).where((F.col("g.at") >= 0) & (F.col("g.at") <= last) & (F.col("g.w") != 0))
        parts.append(own_part.withColumn(along, F.col("g.at")).select(*own, "row", "col", F.lit(name).alias("which"), (F.col("v") * F.col("g.w")).alias("d")))
    both = parts[0].union(parts[1]).groupBy(*own, "row", "col").agg(F.coalesce(F.sum(F.when(F.col("which") == "gx", F.col("d"))), F.lit(0.0)).alias("gx"), F.coalesce(F.sum(F.when(F.col("which") == "gy", F.col("d"))), F.lit(0.0)).alias("gy"))
    return both.where("gx <> 0 or gy <> 0")


def otsu(cells: DataFrame, bins: int = 256) -> DataFrame:
    """One row (per tile): threshold, the centre of the histogram bin of positive values that parts them with the largest variance between."""
    own = keys(cells)
    positive = cells.where(F.col("v") > 0)
    top = positive.groupBy(*own).agg(F.max("v").alias("vmax"))
    both = positive.join(top, own) if own else positive.join(top, F.lit(True))
    counts = both.withColumn("b", F.least(F.lit(bins - 1), F.floor(F.col("v") / F.col("vmax") * bins).cast("int"))).groupBy(*own, "vmax", "b").agg(F.count("*").alias("n"))
    # dense bins: ``bins`` rows for each raster
    dense = top.select(*own, "vmax", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("b")).join(counts.drop("vmax"), [*own, "b"], "left").withColumn("n", F.coalesce(F.col("n"), F.lit(0)).cast("double"))
    dense = dense.withColumn("c", (F.col("b") + 0.5) * F.col("vmax") / bins)
    upto = Window.partitionBy(*own, "vmax").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*own, "vmax")
    dense = dense.withColumn("w0", F.sum("n").over(upto)).withColumn("s0", F.sum(F.col("n") * F.col("c")).over(upto)).withColumn("w", F.sum("n").over(whole)).withColumn("s", F.sum(F.col("n") * F.col("c")).over(whole))
    w1 = F.col("w") - F.col("w0")
    apart = F.try_divide("s0", "w0") - F.try_divide(F.col("s") - F.col("s0"), w1)
    between = F.coalesce(F.when((F.col("w0") > 0) & (w1 > 0), F.col("w0") * w1 * apart * apart), F.lit(0.0))
    return dense.withColumn("between", F.round(between, 6)).groupBy(*own).agg(F.max_by("c", F.struct("between", -F.col("b"))).alias("threshold"))


def percentile(cells: DataFrame, pct: float) -> DataFrame:
    """One row (per tile): that percentile of positive values, linear between neighbours."""
    return cells.where(F.col("v") > 0).groupBy(*keys(cells)).agg(F.percentile("v", F.lit(pct / 100.0)).alias("threshold"))


def threshold(cells: DataFrame, mode: str = "otsu", value: float = 0.0, pct: float = 80.0) -> DataFrame:
    if mode == "manual":
        return cells.groupBy(*keys(cells)).agg(F.lit(float(value)).alias("threshold"))
    if mode not in ("otsu", "percentile"):
        raise ValueError(f"threshold mode {mode!r}")
    return otsu(cells) if mode == "otsu" else percentile(cells, pct)


def mask(cells: DataFrame, limit: DataFrame) -> DataFrame:
    """Cells above the threshold."""
    own = keys(cells)
    both = cells.join(limit, own) if own else cells.join(limit, F.lit(True))
    return both.where(F.col("v") > F.col("threshold")).select(*own, "row", "col")


def dilate(cells: DataFrame, meta: DataFrame, radius: float) -> DataFrame:
    """The mask widened by the diamond of that radius, rounded."""
    r, own = round(radius), keys(cells)
    if r <= 0:
        return cells
    shape = meta.select(*own, "width", "height")
    offsets = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-r, r + 1) for b in range(-r, r + 1) if abs(a) + abs(b) <= r))
    given = cells.join(shape, own) if own else cells.join(shape, F.lit(True))
    wide = given.withColumn("o", F.explode(offsets)).select(*own, (F.col("row") + F.col("o.a")).alias("row"), (F.col("col") + F.col("o.b")).alias("col"), "width", "height")
    return wide.where("row >= 0 and row < height and col >= 0 and col < width").select(*own, "row", "col").distinct()


def holes(cells: DataFrame, meta: DataFrame, area: float) -> DataFrame:
    """The mask with background components (4 neighbours) of fewer than ``area`` cells filled.

    Only background beside the mask can be a small hole: runs of background along each row are the nodes of the graph, so a large empty
    raster costs as many nodes as the mask has runs.
    """
    from roadweave.operators.components import connected_components

    own = keys(cells)
    by_row = Window.partitionBy(*own, "row").orderBy("col")
    shape = meta.select(*own, "width", "height")
    marked = cells.withColumn("before", F.coalesce(F.lag("col").over(by_row) + 1, F.lit(0)))
    gaps = marked.where("col > before").select(*own, "row", F.col("before").alias("lo"), (F.col("col") - 1).alias("hi"))
    last = cells.groupBy(*own, "row").agg((F.max("col") + 1).alias("lo"))
    last = (last.join(shape, own) if own else last.join(shape, F.lit(True))).where("lo < width").select(*own, "row", "lo", (F.col("width") - 1).alias("hi"))
    empty = meta.select(*own, "width", F.explode(F.sequence(F.lit(0).cast("long"), F.col("height") - 1)).alias("row"))
    empty = empty.join(cells.select(*own, "row").distinct(), [*own, "row"], "left_anti").select(*own, "row", F.lit(0).cast("long").alias("lo"), (F.col("width") - 1).alias("hi"))
    runs = gaps.union(last).union(empty).withColumn("id", F.concat_ws(":", *own, F.col("row").cast("string"), F.col("lo").cast("string")))
    below = runs.select(*own, (F.col("row") - 1).alias("row"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.col("id").alias("id2"))
    touching = runs.join(below, [*own, "row"]).where("lo <= hi2 and lo2 <= hi").select(F.col("id").alias("u"), F.col("id2").alias("v"))
    label = connected_components(touching)
    named = runs.join(label, runs["id"] == label["node"], "left").withColumn("component", F.coalesce("component", "id"))
    small = named.groupBy(*own, "component").agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("n")).where(F.col("n") < area)
    filled = named.join(small, [*own, "component"]).select(*own, "row", F.explode(F.sequence("lo", "hi")).alias("col"))
    return cells.select(*own, "row", "col").union(filled)


def histogram(values: DataFrame, column: str = "v", bins: int = 12, scale: str = "linear") -> DataFrame:
    """bin, lo, hi, n for all bins. Linear: equal parts of the range, a constant has a range of 1. Log: equal parts of log(v + 1) from 0."""
    v = F.col(column).cast("double")
    finite = values.select(v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs(F.col("v")) < float("inf")))
    bounds = finite.agg(F.min("v").alias("a"), F.max("v").alias("z")).where("a is not null")
    if scale == "log":
        top = F.when(F.col("z") + 1 <= 1.0, 2.0).otherwise(F.col("z") + 1)
        placed = finite.join(bounds, F.lit(True)).withColumn("b", F.least(F.lit(bins - 1), F.floor(F.log10(F.col("v") + 1) / F.log10(top) * bins).cast("int")))
        edge = lambda k: F.pow(F.lit(10.0), k / F.lit(float(bins)) * F.log10(top)) - 1
    else:
        top = F.when(F.col("z") <= F.col("a"), F.col("a") + 1.0).otherwise(F.col("z"))
        placed = finite.join(bounds, F.lit(True)).withColumn("b", F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("a")) / (top - F.col("a")) * bins).cast("int")))
        edge = lambda k: F.col("a") + k * (top - F.col("a")) / bins
    counts = placed.where("b >= 0").groupBy("b").agg(F.count("*").alias("n"))
    dense = bounds.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).join(counts, "b", "left")
    return dense.select(F.col("b").alias("bin"), edge(F.col("b")).alias("lo"), edge(F.col("b") + 1).alias("hi"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def summary(values: DataFrame, column: str = "v") -> DataFrame:
    """count, min, median, mean, max of finite values; zeros if there are none."""
    v = F.col(column).cast("double")
    finite = values.select(v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs(F.col("v")) < float("inf")))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return finite.agg(F.count("*").alias("count"), zero(F.min("v")).alias("min"), zero(F.median("v")).alias("median"), zero(F.avg("v")).alias("mean"), zero(F.max("v")).alias("max"))


def bilinear(fields: DataFrame, points: DataFrame, value: Column | str = "v") -> DataFrame:
    """Points (id, px, py in cells) with the value between the four cells around; 0 outside."""
    corner = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)))
    at = points.withColumn("o", F.explode(corner)).withColumn("row", F.floor("py").cast("long") + F.col("o.b")).withColumn("col", F.floor("px").cast("long") + F.col("o.a"))
    weight = (1 - F.abs(F.col("px") - F.col("col"))) * (1 - F.abs(F.col("py") - F.col("row")))
    v = F.col(value) if isinstance(value, str) else value
    return at.join(fields, ["row", "col"], "left").groupBy("id").agg(F.sum(F.coalesce(v, F.lit(0.0)) * weight).alias("value"))
