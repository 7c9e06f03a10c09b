"""From raw fixes to a road graph: cleaning, tracks, tiles, extraction, joining, post-processing."""

import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave.functions import geo
from roadweave.operators import clean, density, extract, graph, spatial
from roadweave.operators.components import checkpoint_dir
from roadweave.plans.params import Params
from roadweave.sources import sinks, tables

LOG = logging.getLogger("roadweave")
#: Least side of a tile in overlaps, unless a grid is forced: at 3 a point stands in fewer than 3 tiles on average.
LEAST_TILE = 3


class Cancelled(Exception):
    """The caller asked to stop."""


@dataclass
class Roads:
    """What a run gives: frames of nodes and edges (null after an early stop), points or tracks, and counts."""

    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    points: DataFrame | None = None
    tracks: DataFrame | None = None
    stats: dict = field(default_factory=dict)


def post_process(nodes: DataFrame, edges: DataFrame, p: Params) -> tuple[DataFrame, DataFrame]:
    """The operators on the whole graph, in their fixed order. Each that is on ends in a checkpoint."""
    keep = lambda frame: frame.select(*graph.COLUMNS).checkpoint()
    checkpoint_dir(nodes.sparkSession)
    edges = keep(graph.merge_chains(edges))
    if p.spur_min_m > 0:
        edges = keep(graph.merge_chains(graph.remove_short_spurs(edges, p.spur_min_m)))
    if p.loop_min_m > 0:
        edges = keep(graph.remove_small_loops(edges, p.loop_min_m))
    nodes = graph.prune_orphans(nodes, edges).checkpoint()
    if p.connect_gap_m > 0:
        edges = keep(graph.connect_dead_ends(nodes, edges, p.connect_gap_m))
        nodes, edges = graph.snap_to_edges(nodes, edges, p.connect_gap_m)
        nodes, edges = nodes.checkpoint(), keep(edges)
    if p.bridge_facing_m > 0:
        edges = keep(graph.bridge_facing(nodes, edges, p.bridge_facing_m))
    if p.stitch_max_m > 0:
        edges = keep(graph.stitch_components(nodes, edges, p.stitch_max_m))
    if p.break_crossings:
        nodes, edges = graph.break_at_crossings(nodes, edges)
        nodes, edges = nodes.checkpoint(), keep(edges)
    if p.junction_m > 0:
        nodes, edges = graph.merge_close_nodes(nodes, edges, p.junction_m)
        nodes, edges = nodes.checkpoint(), keep(edges)
    if p.keep_largest:
        nodes, edges = graph.largest_component(nodes, edges)
    if p.min_component_m > 0:
        nodes, edges = graph.remove_small_components(nodes, edges, p.min_component_m)
    return nodes, graph.annotate(graph.smooth_edges(edges, p.smooth_iters))


def extract_graph(tracks: DataFrame, p: Params) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Nodes and edges by tile from tracks (tile, track_id, seq, x, y), each tile's threshold, and how many rare and short edges were left out."""
    if p.method == "kde":
        meta = density.grid(tracks, p.cell_tau)
        surface, coverage = density.kde(tracks, meta, p.cell_tau, p.kde_radius), tracks
    else:
        coverage = extract.refine(tracks, p.cell_tau, p.sigma1, p.sharpness, p.weights, (p.slide_min_loops, p.slide_max_loops), p.max_points_per_tile).checkpoint()
        meta = density.grid(tracks, p.cell_tau)
        surface = density.smooth(density.density(coverage, meta), meta, p.sigma2, p.sharpness)
    meta = meta.checkpoint()
    # rounded, so that a sum's order doesn't move a cell over the threshold
    surface = surface.withColumn("v", F.round("v", 9)).checkpoint()
    limit = density.threshold(surface, p.eps_mode, p.eps_value, p.eps_percentile).checkpoint()
    mask = density.mask(surface, limit)
    gap = p.gap_buffer_m if p.method == "kde" else p.slide_close_gaps_m
    if gap > 0:
        mask = density.dilate(mask, meta, gap / p.cell_tau)
    if p.fill_holes_m > 0:
        mask = density.holes(mask.checkpoint(), meta, (p.fill_holes_m / p.cell_tau) ** 2)
    pixels = extract.skeletons(mask, meta).checkpoint()
    nodes, edges = extract.world_graph(pixels, coverage, meta, p.dp_tolerance)
    edges = edges.checkpoint()
    kept = graph.filter_edges(edges, p.edge_f_min, p.edge_l_min, p.protect_long_m)
    return nodes, kept, limit, edges.count() - kept.count()


def build_roads(points: DataFrame | None, params: Params = Params(), progress: Callable[[float, str], None] | None = None, cancelled: Callable[[], bool] | None = None, spark=None) -> Roads:
    """The road graph of fixes (device, time, lat, lon).

    ``cache_dir`` with ``stop_after`` or ``start_stage`` (points, tracks) keeps a stage's result and goes on from it.
    """
    p, spark, out = params, spark or points.sparkSession, Roads()
    checkpoint_dir(spark)

    def stage(share: float, what: str) -> None:
        if cancelled and cancelled():
            raise Cancelled(what)
        LOG.info("%3.0f %% %s", 100 * share, what)
        if progress:
            progress(share, what)

    if p.start_stage != "tracks":
        if p.start_stage == "points":
            fixes = tables.load_points(spark, p.cache_dir)
        else:
            stage(0.0, "clean")
            inside = clean.clip(points, [list(r) for r in p.aoi_polygon]) if p.aoi_polygon else points
            fixes, counts = clean.clean(inside, p.v_max_kmh, p.a_max, p.reb_enabled)
            out.stats |= counts.first().asDict()
            out.stats["aoi_removed"] = points.count() - out.stats["input"] if p.aoi_polygon else 0
            thin = clean.thin_greedy if p.thin_mode == "greedy" else clean.thin_consecutive
            fixes = thin(fixes, p.min_point_dist)
            if p.cache_dir:
                sinks.save_points(fixes, p.cache_dir)
                fixes = tables.load_points(spark, p.cache_dir)
            else:
                fixes = fixes.checkpoint()
            out.stats["near_dup_removed"] = out.stats["output"] - fixes.count()
        out.points = fixes
        if p.stop_after == "points":
            return out
        stage(0.2, "tracks")
        extent = clean.extent(fixes).first()
        if extent["center_lon"] is None:
            raise ValueError("no fix is left")
        out.stats["center_lon"] = center = round(extent["center_lon"], 6)
        parted = clean.long_enough(clean.segments(fixes, p.gap_dt_s, p.gap_ds_m), 1 if p.method == "kde" else 2)
        if abs(extent["center_lat"]) >= geo.POLAR_LAT:
            x, y = geo.azimuthal(F.col("lat"), F.col("lon"), extent["center_lat"], center)
            flat = parted.withColumn("x", x).withColumn("y", y)
        else:
            flat = geo.project(parted, center)
        tracks = flat.select("track_id", "seq", "x", "y")
        if p.method == "slide":
            tracks = clean.long_enough(clean.resample(tracks, p.resample_k), 2)
        if p.cache_dir:
            sinks.save_tracks(tracks, p.cache_dir, f"tmerc {center}")
            tracks = tables.load_tracks(spark, p.cache_dir)
        else:
            tracks = tracks.checkpoint()
    else:
        tracks, center = tables.load_tracks(spark, p.cache_dir), 0.0
    out.tracks = tracks
    if p.stop_after == "tracks":
        return out
    stage(0.4, "tiles")
    n, x0, x1, y0, y1 = tracks.agg(F.count("*"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    out.stats["tracks"] = tracks.select("track_id").distinct().count()
    if not n:
        raise ValueError("no track is left")
    tiles = spatial.choose_tiling(n, x0, y0, x1, y1, p.cell_tau, p.split_mode, p.tile_grid, p.max_points_per_tile, p.overlap_cells, LEAST_TILE * p.overlap_cells * p.cell_tau)
    if len(tiles) == 1:
        tiled = tracks.withColumn("tile", F.lit(0))
    else:
        nx, ny = max(t["i"] for t in tiles) + 1, max(t["j"] for t in tiles) + 1
        size = tiles[0]["cx1"] - tiles[0]["cx0"]
        runs = spatial.assign_tiles(tracks, x0, y0, size, nx, ny, p.overlap_cells * p.cell_tau, 1 if p.method == "kde" else 2)
        tiled = runs.withColumn("track_id", F.concat_ws("/", "track_id", F.col("run").cast("string"))).drop("run").checkpoint()
    stage(0.5, "extract")
    nodes, edges, limit, out.stats["edges_removed"] = extract_graph(tiled, p)
    merged = graph.merge_tiles(nodes, edges, p.node_merge_dist or 1.5 * p.cell_tau)
    if len(tiles) > 1:
        merged = graph.merge_close_nodes(merged[0].checkpoint(), merged[1].checkpoint(), 3 * p.cell_tau * p.sigma2)
    stage(0.8, "post-process")
    nodes, edges = post_process(merged[0].checkpoint(), merged[1].checkpoint(), p)
    if p.compute_devices and p.start_stage != "tracks":
        flat = geo.project(out.points, center).select("device", "x", "y")
        edges = graph.count_devices(edges.checkpoint(), flat, 3 * p.cell_tau)
    out.nodes, out.edges = nodes.checkpoint(), edges.checkpoint()
    low, middle, high = limit.agg(F.min("threshold"), F.median("threshold"), F.max("threshold")).first()
    out.stats |= {"tiles": len(tiles), "points": n, "threshold_min": low, "threshold": middle, "threshold_max": high, "nodes": out.nodes.count(), "edges": out.edges.count()}
    stage(1.0, "done")
    return out


def with_lonlat(roads: Roads) -> tuple[DataFrame, DataFrame]:
    """Nodes with lon and lat, edges with coords_lonlat."""
    center = roads.stats["center_lon"]
    nodes = geo.unproject(roads.nodes, center)
    points = geo.unproject(roads.edges.select("edge", F.posexplode("coords").alias("k", "p")).select("edge", "k", "p.x", "p.y"), center)
    lines = points.groupBy("edge").agg(F.array_sort(F.collect_list(F.struct("k", F.col("lon").alias("x"), F.col("lat").alias("y")))).alias("own"))
    drawn = lines.select("edge", F.transform("own", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("coords_lonlat"))
    return nodes, roads.edges.join(drawn, "edge")


class RoadInference:
    """``RoadInference(params).fit(points)``: a run with its parameters."""

    def __init__(self, params: Params | None = None, **changes):
        self.params = params or Params(**changes)

    def fit(self, points: DataFrame, **callbacks) -> Roads:
        return build_roads(points, self.params, **callbacks)
