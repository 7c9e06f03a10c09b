"""Joins by distance: points are dealt to square buckets as wide as the radius, so each meets only the nine around it."""

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadweave.functions.geo import segments_cross

AROUND = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
#: Share of a tile by which bounds may pass its far side: a third of a width, three times, can be a rounding short of the width.
HAIR = 1e-9


def radius_join(left: DataFrame, right: DataFrame, radius: float, strict: bool = False) -> DataFrame:
    """All pairs of left (l_id, x, y) and right (r_id, x, y) within the radius, with d. The right side goes to nine buckets: give the smaller one."""
    bucket = lambda c: F.floor(F.col(c) / radius).cast("long")
    a = left.withColumn("bx", bucket("x")).withColumn("by", bucket("y"))
    offsets = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in AROUND))
    b = right.select(*[F.col(c).alias(f"r_{c}" if c in ("x", "y") else c) for c in right.columns]).withColumn("o", F.explode(offsets))
    b = b.withColumn("bx", F.floor(F.col("r_x") / radius).cast("long") + F.col("o.i")).withColumn("by", F.floor(F.col("r_y") / radius).cast("long") + F.col("o.j")).drop("o")
    pairs = a.join(b, ["bx", "by"]).withColumn("d", F.hypot(F.col("x") - F.col("r_x"), F.col("y") - F.col("r_y")))
    return pairs.where(F.col("d") < radius if strict else F.col("d") <= radius).drop("bx", "by")


def close_pairs(points: DataFrame, radius: float) -> DataFrame:
    """(a, b, d) for all pairs of points (id, x, y) within the radius, a < b."""
    left, right = points.withColumnRenamed("id", "a"), points.withColumnRenamed("id", "b")
    return radius_join(left, right, radius).where("a < b").select("a", "b", "d")


def nearest(points: DataFrame, targets: DataFrame, radius: float, more: tuple[str, ...] = ()) -> DataFrame:
    """For each point (p_id, x, y) the nearest target (t_id, x, y) nearer than the radius, ties to the smaller t_id; ``more`` columns of the point come along."""
    pairs = radius_join(points, targets, radius, strict=True)
    return pairs.groupBy("p_id").agg(F.min_by(F.struct("t_id", "d"), F.struct("d", "t_id")).alias("n"), *(F.any_value(c).alias(c) for c in more)).select("p_id", "n.t_id", "n.d", *more)


def k_nearest(points: DataFrame, k: int, radius: float) -> DataFrame:
    """(a, b, d, rank) of each point's k nearest others within the radius."""
    pairs = radius_join(points.withColumnRenamed("id", "a"), points.withColumnRenamed("id", "b"), radius).where("a <> b")
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))).where(F.col("rank") <= k).select("a", "b", "d", "rank")


def segments_of(edges: DataFrame) -> DataFrame:
    """(edge, k, x1, y1, x2, y2) for each step of each edge's coords."""
    n = F.size("coords")
    steps = edges.where(n >= 2).select("edge", "u", "v", "coords", F.explode(F.sequence(F.lit(1), n - 1)).alias("k"))
    a, b = F.element_at("coords", F.col("k")), F.element_at("coords", F.col("k") + 1)
    return steps.select("edge", "u", "v", (F.col("k") - 1).alias("k"), a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"))


def crossings(edges: DataFrame, most_cells: int = 10_000) -> DataFrame:
    """(edge_a, k_a, t_a, edge_b, k_b, t_b, x, y): proper crossings of segments of edges that share no node, each once.

    Cells are as wide as the median segment, 1 at least. Segments over more cells than ``most_cells`` are left out, as they'd be everywhere.
    """
    own = segments_of(edges)
    median = own.agg(F.percentile_approx(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")), 0.5, 10_000)).first()[0]
    cell = max(float(median or 1.0), 1.0)
    span = lambda a, b: F.sequence(F.floor(F.least(a, b) / cell).cast("long"), F.floor(F.greatest(a, b) / cell).cast("long"))
    covered = own.withColumn("cx", span(F.col("x1"), F.col("x2"))).withColumn("cy", span(F.col("y1"), F.col("y2"))).where(F.size("cx").cast("long") * F.size("cy") <= most_cells)
    covered = covered.withColumn("cx", F.explode("cx")).withColumn("cy", F.explode("cy"))
    a = covered.select("cx", "cy", *(F.col(c).alias(f"a_{c}") for c in own.columns))
    b = covered.select("cx", "cy", *(F.col(c).alias(f"b_{c}") for c in own.columns))
    apart = ~((F.col("a_u") == F.col("b_u")) | (F.col("a_u") == F.col("b_v")) | (F.col("a_v") == F.col("b_u")) | (F.col("a_v") == F.col("b_v")))
    hit, t, u = segments_cross(*(F.col(c) for c in ("a_x1", "a_y1", "a_x2", "a_y2", "b_x1", "b_y1", "b_x2", "b_y2")))
    pairs = a.join(b, ["cx", "cy"]).where(F.col("a_edge") < F.col("b_edge")).where(apart).withColumn("t_a", t).withColumn("t_b", u).where(hit)
    pairs = pairs.dropDuplicates(["a_edge", "a_k", "b_edge", "b_k"])
    x = F.col("a_x1") + F.col("t_a") * (F.col("a_x2") - F.col("a_x1"))
    y = F.col("a_y1") + F.col("t_a") * (F.col("a_y2") - F.col("a_y1"))
    return pairs.select(F.col("a_edge").alias("edge_a"), F.col("a_k").alias("k_a"), "t_a", F.col("b_edge").alias("edge_b"), F.col("b_k").alias("k_b"), "t_b", x.alias("x"), y.alias("y"))


def plan_tiles(x0: float, y0: float, x1: float, y1: float, size: float, overlap: float) -> list[dict]:
    """Square tiles over the bounds: tile (row by row), i, j, core cx0..cy1 and, wider by the overlap, rx0..ry1."""
    nx, ny = max(1, math.ceil((x1 - x0) / size - HAIR)), max(1, math.ceil((y1 - y0) / size - HAIR))
    out = []
    for j in range(ny):
        for i in range(nx):
            core = (x0 + i * size, y0 + j * size, x0 + (i + 1) * size, y0 + (j + 1) * size)
            out.append({"tile": j * nx + i, "i": i, "j": j, **dict(zip(("cx0", "cy0", "cx1", "cy1"), core)), "rx0": core[0] - overlap, "ry0": core[1] - overlap, "rx1": core[2] + overlap, "ry1": core[3] + overlap})
    return out


def choose_tiling(n: int, x0: float, y0: float, x1: float, y1: float, cell: float, mode: str = "auto", grid: tuple[int, int] | None = None, most: int = 400_000, overlap_cells: int = 15, least: float = 0.0) -> list[dict]:
    """off: one tile, the bounds. forced: as many squares along the longer side as the larger of ``grid``. auto: ceil(sqrt(n / most)) along it,
    fewer where their sides would be under ``least``: a tile reads its overlaps too, so ever smaller tiles hold no fewer points but more copies of them."""
    k = 1 if mode == "off" else max(grid or (1, 1)) if mode == "forced" else max(1, -int(-((n / most) ** 0.5) // 1))
    if mode == "auto" and least > 0:
        k = max(1, min(k, int(max(x1 - x0, y1 - y0) / least)))
    if k == 1:
        return [{"tile": 0, "i": 0, "j": 0, "cx0": x0, "cy0": y0, "cx1": x1, "cy1": y1, "rx0": x0, "ry0": y0, "rx1": x1, "ry1": y1}]
    return plan_tiles(x0, y0, x1, y1, max((x1 - x0) / k, (y1 - y0) / k, cell), overlap_cells * cell)


def assign_tiles(tracks: DataFrame, x0: float, y0: float, size: float, nx: int, ny: int, overlap: float, least: int = 2) -> DataFrame:
    """Each point (track_id, seq, x, y) in all tiles whose wider square holds it, as runs: (tile, track_id, run, seq, x, y). Runs under ``least`` points go.

    Tiles follow from the coordinates, so nothing is joined; a track that leaves a tile and returns has two runs there.
    """
    lo = lambda v, o, n: F.greatest(F.lit(0), F.ceil((v - overlap - o) / size - 1 - HAIR).cast("int"))
    hi = lambda v, o, n: F.least(F.lit(n - 1), F.floor((v + overlap - o) / size).cast("int"))
    i = F.when(lo(F.col("x"), x0, nx) <= hi(F.col("x"), x0, nx), F.sequence(lo(F.col("x"), x0, nx), hi(F.col("x"), x0, nx)))
    j = F.when(lo(F.col("y"), y0, ny) <= hi(F.col("y"), y0, ny), F.sequence(lo(F.col("y"), y0, ny), hi(F.col("y"), y0, ny)))
    # dealt by track before a point is copied to its tiles: all windows below find their rows together, none shuffles the copies
    inside = tracks.repartition("track_id").withColumn("i", F.explode(i)).withColumn("j", F.explode(j)).withColumn("tile", F.col("j") * nx + F.col("i"))
    by = Window.partitionBy("tile", "track_id").orderBy("seq")
    island = inside.withColumn("island", F.col("seq") - F.row_number().over(by))
    own = Window.partitionBy("tile", "track_id", "island")
    runs = island.withColumn("n", F.count("*").over(own)).where(F.col("n") >= least)
    return runs.withColumn("run", (F.dense_rank().over(Window.partitionBy("tile", "track_id").orderBy("island")) - 1).cast("int")).select("tile", "track_id", "run", "seq", "x", "y")
