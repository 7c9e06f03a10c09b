"""Road graphs as two frames: nodes (id, x, y) and edges (edge, u, v, coords, length, frequency). Several edges between two nodes and loops are fine.

What depends on an order goes by the smallest id, so results don't depend on how rows lie.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadweave.functions import polyline
from roadweave.functions.geo import project_on_segment, road_class
from roadweave.operators.components import checkpoint_dir, connected_components
from roadweave.operators.spatial import close_pairs, crossings, k_nearest, nearest, radius_join

EDGE = "edge long, u long, v long, coords array<struct<x: double, y: double>>, length double, frequency int"
#: Parts in which new edges and nodes are numbered.
NUMBER_BUCKETS = 4096
#: Pixels of all tiles that go to every task; more are dealt out by place, with the points.
FEW_PIXELS = 50_000
COLUMNS = ("edge", "u", "v", "coords", "length", "frequency")


def ends(edges: DataFrame) -> DataFrame:
    """(node, edge) for both ends of each edge; a loop has two."""
    return edges.select(F.explode(F.array("u", "v")).alias("node"), "edge")


def degrees(edges: DataFrame) -> DataFrame:
    return ends(edges).groupBy("node").agg(F.count("*").alias("degree"))


def neighbours(edges: DataFrame) -> DataFrame:
    """(node, neighbours) without repeats, ascending."""
    both = edges.select(F.col("u").alias("node"), F.col("v").alias("m")).union(edges.select("v", "u")).distinct()
    return both.groupBy("node").agg(F.array_sort(F.collect_list("m")).alias("neighbours"))


def prune_orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(ends(edges).select(F.col("node").alias("id")).distinct(), "id", "left_semi")


def filter_edges(edges: DataFrame, f_min: int = 2, l_min: float = 30.0, protect_long_m: float | None = None) -> DataFrame:
    """Without edges both rare and short. Those of ``protect_long_m`` or more stay anyway."""
    weak = (F.col("frequency") < f_min) & (F.col("length") < l_min)
    return edges.where(~(weak & (F.col("length") < protect_long_m) if protect_long_m is not None else weak))


def remove_small_loops(edges: DataFrame, min_len: float) -> DataFrame:
    return edges.where(~((F.col("u") == F.col("v")) & (F.col("length") < min_len)))


def remove_short_spurs(edges: DataFrame, min_len: float, rounds: int = 1000) -> DataFrame:
    """Without edges shorter than min_len that end in a node of degree 1, again and again until none is left. Loops stay."""
    if min_len <= 0:
        return edges
    checkpoint_dir(edges.sparkSession)
    edges = edges.checkpoint()
    for _ in range(rounds):
        dead = degrees(edges).where("degree = 1").select("node")
        spurs = ends(edges.where((F.col("u") != F.col("v")) & (F.col("length") < min_len))).join(dead, "node", "left_semi").select("edge").distinct()
        left = edges.join(spurs, "edge", "left_anti").select(*edges.columns).checkpoint()
        if left.count() == edges.count():
            return left
        edges = left
    raise RuntimeError(f"spurs are left after {rounds} rounds")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) of each node: the smallest node it reaches."""
    found = connected_components(edges)
    return nodes.join(found, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("component"))


def component_lengths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, length): the sum over edges, 0 without any."""
    own = components(nodes, edges)
    total = edges.join(own, F.col("u") == F.col("id")).groupBy("component").agg(F.sum("length").alias("length"))
    return own.select("component").distinct().join(total, "component", "left").select("component", F.coalesce("length", F.lit(0.0)).alias("length"))


def induced(nodes: DataFrame, edges: DataFrame, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The part of the graph on nodes of ``keep`` (id)."""
    own = nodes.join(keep, "id", "left_semi")
    kept = edges.join(keep.withColumnRenamed("id", "u"), "u", "left_semi").join(keep.withColumnRenamed("id", "v"), "v", "left_semi")
    return own, kept.select(*edges.columns)


def largest_component(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The component with the largest length; of equal ones that with the smallest node."""
    own = components(nodes, edges)
    total = edges.join(own, F.col("u") == F.col("id")).groupBy("component").agg(F.sum("length").alias("length"))
    best = total.agg(F.max_by("component", F.struct("length", -F.col("component"))).alias("component"))
    return induced(nodes, edges, own.join(best, "component", "left_semi").select("id"))


def remove_small_components(nodes: DataFrame, edges: DataFrame, min_length_m: float) -> tuple[DataFrame, DataFrame]:
    own = components(nodes, edges)
    total = edges.join(own, F.col("u") == F.col("id")).groupBy("component").agg(F.sum("length").alias("length")).where(F.col("length") >= min_length_m)
    return induced(nodes, edges, own.join(total, "component", "left_semi").select("id"))


def merge_parallel(edges: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """Edges between the same two nodes whose length is within the tolerance of one kept before (by edge) add their frequency to it."""
    item = F.struct("edge", "u", "v", "coords", "length", "frequency")
    pairs = edges.groupBy(F.least("u", "v").alias("_a"), F.greatest("u", "v").alias("_b")).agg(F.array_sort(F.collect_list(item)).alias("own"))

    def fold(kept: Column, x: Column) -> Column:
        at = F.array_position(F.transform(kept, lambda k: F.abs(k["length"] - x["length"]) <= tolerance), True)
        more = F.transform(kept, lambda k, i: F.when(i + 1 == at, k.withField("frequency", k["frequency"] + x["frequency"])).otherwise(k))
        return F.when(at > 0, more).otherwise(F.concat(kept, F.array(x)))

    return pairs.select(F.explode(F.aggregate("own", F.slice("own", 1, 0), fold)).alias("e")).select("e.*")


def merge_close_nodes(nodes: DataFrame, edges: DataFrame, dist: float, tolerance: float = 5.0) -> tuple[DataFrame, DataFrame]:
    """Nodes within ``dist``, also by way of others, become one at their mean. Loops shorter than twice that go, parallel edges merge, lines stay."""
    group = connected_components(close_pairs(nodes, dist), "a", "b")
    own = nodes.join(group, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("to"), "x", "y")
    merged = own.groupBy(F.col("to").alias("id")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    name = own.select("id", "to")
    moved = edges.join(name.select(F.col("id").alias("u"), F.col("to").alias("_u")), "u").join(name.select(F.col("id").alias("v"), F.col("to").alias("_v")), "v")
    moved = moved.select("edge", F.col("_u").alias("u"), F.col("_v").alias("v"), "coords", "length", "frequency")
    return merged, merge_parallel(remove_small_loops(moved, 2 * dist), tolerance)


def merge_tiles(nodes: DataFrame, edges: DataFrame, dist: float) -> tuple[DataFrame, DataFrame]:
    """Graphs of several tiles (column tile, ids within) as one, their close nodes merged."""
    shift = F.col("tile").cast("long") * F.lit(1 << 40)
    own = nodes.select((shift + F.col("id")).alias("id"), "x", "y")
    both = edges.select((shift + F.col("edge")).alias("edge"), (shift + F.col("u")).alias("u"), (shift + F.col("v")).alias("v"), "coords", "length", "frequency")
    return merge_close_nodes(own, both, dist)


def through(edges: DataFrame) -> DataFrame:
    """(node, edge, other): nodes with exactly two ends, of two different edges."""
    both = ends(edges).groupBy("node").agg(F.count("*").alias("n"), F.min("edge").alias("edge"), F.max("edge").alias("other"))
    return both.where("n = 2 and edge <> other").select("node", "edge", "other")


def chains(edges: DataFrame) -> DataFrame:
    """(edge, chain): edges that meet in nodes of degree 2 share a chain, named by its smallest edge."""
    found = connected_components(through(edges), "edge", "other")
    return edges.select("edge").join(found, F.col("edge") == F.col("node"), "left").select("edge", F.coalesce("component", "edge").alias("chain"))


def _one_line(pdf: pd.DataFrame) -> pd.DataFrame:
    rows = {int(r.edge): r for r in pdf.itertuples()}
    at: dict[int, list[int]] = {}
    for r in rows.values():
        at.setdefault(int(r.u), []).append(int(r.edge))
        at.setdefault(int(r.v), []).append(int(r.edge))
    tips = sorted(n for n, own in at.items() if len(own) == 1)
    start = tips[0] if tips else min(min(r.u, r.v) for r in rows.values() if r.edge == min(rows))
    node, left, points = int(start), set(rows), []
    while True:
        following = sorted(e for e in at.get(node, ()) if e in left)
        if not following:
            break
        r = rows[following[0]]
        left.discard(following[0])
        line = [(p["x"], p["y"]) for p in r.coords]
        if int(r.u) != node:
            line.reverse()
        points += line[1:] if points else line
        node = int(r.v) if int(r.u) == node else int(r.u)
    return pd.DataFrame([(min(rows), int(start), node, [{"x": x, "y": y} for x, y in points], float(pdf["length"].sum()), int(pdf["frequency"].max()))], columns=list(COLUMNS))


def merge_chains(edges: DataFrame) -> DataFrame:
    """Each chain as one edge: lengths add up, the largest frequency counts, lines are joined from the smaller end. A closed chain is a loop."""
    own = edges.join(chains(edges), "edge")
    alone = Window.partitionBy("chain")
    own = own.withColumn("_n", F.count("*").over(alone))
    single = own.where("_n = 1").select(*COLUMNS)
    return single.unionByName(own.where("_n > 1").select("chain", *COLUMNS).groupBy("chain").applyInPandas(lambda pdf: _one_line(pdf), EDGE))


def chain_totals(edges: DataFrame) -> DataFrame:
    """(chain, edges, length, frequency) of each chain."""
    return edges.join(chains(edges), "edge").groupBy("chain").agg(F.count("*").alias("edges"), F.sum("length").alias("length"), F.max("frequency").alias("frequency"))


def dead_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(degrees(edges).where("degree = 1").select(F.col("node").alias("id")), "id", "left_semi")


def adjacency(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("u").alias("a"), F.col("v").alias("b")).union(edges.select("v", "u")).distinct()


def counted(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """With consecutive numbers from 1: by a hash of the columns ``by``, in NUMBER_BUCKETS parts that are ordered each for itself, then by the columns."""
    checkpoint_dir(rows.sparkSession)
    own = rows.withColumn("_b", F.pmod(F.xxhash64(*by), F.lit(NUMBER_BUCKETS))).checkpoint()
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # over NUMBER_BUCKETS rows at most
    sizes = own.groupBy("_b").agg(F.count("*").alias("_n")).select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_b").orderBy(*by)) + F.col("_before")
    return own.join(F.broadcast(sizes), "_b").withColumn(name, nth.cast("long")).drop("_b", "_before")


def numbered(new: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """New edges with numbers after the largest."""
    top = edges.agg(F.coalesce(F.max("edge"), F.lit(-1)).alias("_top"))
    return counted(new, by, "_k").join(F.broadcast(top), F.lit(True)).withColumn("edge", (F.col("_top") + F.col("_k")).cast("long")).drop("_k", "_top")


def straight(pairs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b) as edges of frequency 0."""
    a = nodes.select(F.col("id").alias("u"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = nodes.select(F.col("id").alias("v"), F.col("x").alias("bx"), F.col("y").alias("by"))
    found = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).join(a, "u").join(b, "v")
    line = F.array(polyline.point(F.col("ax"), F.col("ay")), polyline.point(F.col("bx"), F.col("by")))
    made = found.withColumn("coords", line).withColumn("length", F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))).withColumn("frequency", F.lit(0))
    return numbered(made, edges, ["u", "v"]).select(*COLUMNS)


def end_bridges(nodes: DataFrame, edges: DataFrame, radius: float) -> DataFrame:
    """(a, b), a < b: each dead end with the nearest node that isn't its neighbour, ties to the smaller id.

    All ends choose at once; where the order of a sequential run would send the second of a pair on to its second nearest, it doesn't here.
    """
    tips = dead_ends(nodes, edges)
    pairs = radius_join(tips.withColumnRenamed("id", "a"), nodes.withColumnRenamed("id", "b"), radius).where("a <> b").select("a", "b", "d")
    free = pairs.join(adjacency(edges), ["a", "b"], "left_anti")
    best = free.groupBy("a").agg(F.min_by("b", F.struct("d", "b")).alias("b"))
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def connect_dead_ends(nodes: DataFrame, edges: DataFrame, radius: float) -> DataFrame:
    return edges.select(*COLUMNS).unionByName(straight(end_bridges(nodes, edges, radius), nodes, edges)) if radius > 0 else edges


def tip_directions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, x, y, dx, dy): dead ends and the unit vector in which their road would go on."""
    tips = dead_ends(nodes, edges)
    own = tips.join(ends(edges).withColumnRenamed("node", "id"), "id").join(edges.select("edge", "coords"), "edge").where(F.size("coords") >= 2)
    a, b = F.element_at("coords", 1), F.element_at("coords", -1)
    to_tip = F.when(F.hypot(a["x"] - F.col("x"), a["y"] - F.col("y")) < F.hypot(b["x"] - F.col("x"), b["y"] - F.col("y")), F.reverse("coords")).otherwise(F.col("coords"))
    dx, dy = polyline.end_direction(F.col("line"))
    return own.withColumn("line", to_tip).select("id", "x", "y", dx.alias("dx"), dy.alias("dy")).where("dx is not null")


def facing_pairs(nodes: DataFrame, edges: DataFrame, max_dist: float, max_angle_deg: float = 35.0) -> DataFrame:
    """(a, b), a < b: each dead end with the nearest one it faces and that faces it, within the angle, not yet its neighbour."""
    tips = tip_directions(nodes, edges)
    left = tips.select(F.col("id").alias("a"), "x", "y", F.col("dx").alias("adx"), F.col("dy").alias("ady"))
    right = tips.select(F.col("id").alias("b"), "x", "y", F.col("dx").alias("bdx"), F.col("dy").alias("bdy"))
    pairs = radius_join(left, right, max_dist).where("a <> b and d >= 1e-9")
    hx, hy = (F.col("r_x") - F.col("x")) / F.col("d"), (F.col("r_y") - F.col("y")) / F.col("d")
    least = math.cos(math.radians(max_angle_deg))
    pairs = pairs.where((F.col("adx") * hx + F.col("ady") * hy >= least) & (-(F.col("bdx") * hx + F.col("bdy") * hy) >= least))
    free = pairs.select("a", "b", "d").join(adjacency(edges), ["a", "b"], "left_anti")
    best = free.groupBy("a").agg(F.min_by("b", F.struct("d", "b")).alias("b"))
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def bridge_facing(nodes: DataFrame, edges: DataFrame, max_dist: float, max_angle_deg: float = 35.0) -> DataFrame:
    return edges.select(*COLUMNS).unionByName(straight(facing_pairs(nodes, edges, max_dist, max_angle_deg), nodes, edges)) if max_dist > 0 else edges


def stitches(nodes: DataFrame, edges: DataFrame, max_dist: float, k: int = 7, rounds: int = 40) -> DataFrame:
    """(a, b): a cheapest forest that joins components by pairs of each other's k nearest nodes. Boruvka: each round every component takes its shortest pair."""
    checkpoint_dir(nodes.sparkSession)
    near = k_nearest(nodes, k, max_dist).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "d").distinct().checkpoint()
    own = components(nodes, edges).checkpoint()
    chosen = near.limit(0)
    for _ in range(rounds):
        left = own.select(F.col("id").alias("a"), F.col("component").alias("ca"))
        right = own.select(F.col("id").alias("b"), F.col("component").alias("cb"))
        apart = near.join(left, "a").join(right, "b").where("ca <> cb").checkpoint()
        pair = F.struct("d", "a", "b")
        each = apart.select(F.explode(F.array("ca", "cb")).alias("c"), pair.alias("p")).groupBy("c").agg(F.min("p").alias("p"))
        picked = each.select("p.a", "p.b", "p.d").distinct().checkpoint()
        if picked.isEmpty():
            break
        chosen = chosen.unionByName(picked.select(*chosen.columns)).checkpoint()
        links = picked.join(left, "a").join(right, "b").select(F.col("ca").alias("u"), F.col("cb").alias("v"))
        to = connected_components(links).withColumnRenamed("component", "to")
        own = own.join(to, F.col("component") == F.col("node"), "left").select("id", F.coalesce("to", "component").alias("component")).checkpoint()
    else:
        raise RuntimeError(f"components are left apart after {rounds} rounds")
    return chosen.select("a", "b")


def stitch_components(nodes: DataFrame, edges: DataFrame, max_dist: float) -> DataFrame:
    return edges.select(*COLUMNS).unionByName(straight(stitches(nodes, edges, max_dist), nodes, edges)) if max_dist > 0 else edges


def cut_edges(edges: DataFrame, cuts: DataFrame) -> DataFrame:
    """Edges cut at (edge, k, t, node, x, y): at share t of segment k, in a node. Pieces keep the frequency; edges without a cut stay as they are."""
    by_edge = cuts.groupBy("edge").agg(F.array_sort(F.collect_list(F.struct((F.col("k") + F.col("t")).alias("at"), "node", "x", "y"))).alias("cuts"))
    both = edges.join(by_edge, "edge", "left").select(*COLUMNS, "cuts")
    whole = both.where("cuts is null").select(*COLUMNS)
    n = F.size("cuts")
    pieces = both.where("cuts is not null").withColumn("piece", F.explode(F.sequence(F.lit(0), n)))
    before, after = F.try_element_at("cuts", F.when(F.col("piece") > 0, F.col("piece"))), F.try_element_at("cuts", F.col("piece") + 1)
    lo, hi = F.coalesce(before["at"], F.lit(-1.0)), F.coalesce(after["at"], F.lit(1e300))
    inner = F.filter("coords", lambda p, i: (i > lo) & (i < hi))
    head = F.when(before.isNotNull(), F.array(polyline.point(before["x"], before["y"]))).otherwise(F.slice("coords", 1, 0))
    tail = F.when(after.isNotNull(), F.array(polyline.point(after["x"], after["y"]))).otherwise(F.slice("coords", 1, 0))
    made = pieces.select("edge", "piece", F.coalesce(before["node"], "u").alias("u"), F.coalesce(after["node"], "v").alias("v"), F.concat(head, inner, tail).alias("coords"), "frequency")
    first = made.where("piece = 0").withColumn("length", polyline.length(F.col("coords"))).select(*COLUMNS)
    rest = made.where("piece > 0").withColumn("length", polyline.length(F.col("coords"))).withColumnRenamed("edge", "_edge")
    return whole.unionByName(first).unionByName(numbered(rest, edges, ["_edge", "piece"]).select(*COLUMNS))


def break_at_crossings(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges that cross without a node get one there."""
    top = nodes.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("_top"))
    found = counted(crossings(edges), ["edge_a", "k_a", "edge_b", "k_b"], "_k").join(F.broadcast(top), F.lit(True)).withColumn("node", F.col("_top") + F.col("_k"))
    checkpoint_dir(nodes.sparkSession)
    found = found.checkpoint()
    cuts = found.select(F.col("edge_a").alias("edge"), F.col("k_a").alias("k"), F.col("t_a").alias("t"), "node", "x", "y").union(found.select("edge_b", "k_b", "t_b", "node", "x", "y"))
    return nodes.unionByName(found.select(F.col("node").alias("id"), "x", "y")), cut_edges(edges, cuts)


def edge_snaps(nodes: DataFrame, edges: DataFrame, radius: float) -> DataFrame:
    """(id, edge, k, t, d, x, y): each dead end's nearest place, within the radius, on an edge it isn't an end of."""
    from roadweave.operators.spatial import segments_of

    bucket = lambda c, by=0.0: F.floor((c + by) / radius).cast("long")
    tips = dead_ends(nodes, edges).withColumn("bx", bucket(F.col("x"))).withColumn("by", bucket(F.col("y")))
    own = segments_of(edges)
    span = lambda a, b: F.sequence(bucket(F.least(a, b), -radius), bucket(F.greatest(a, b), radius))
    wide = own.withColumn("bx", F.explode(span(F.col("x1"), F.col("x2")))).withColumn("by", F.explode(span(F.col("y1"), F.col("y2"))))
    pairs = tips.join(wide, ["bx", "by"]).where("id <> u and id <> v")
    t, d = project_on_segment(*(F.col(c) for c in ("x", "y", "x1", "y1", "x2", "y2")))
    pairs = pairs.withColumn("t", t).withColumn("d", d).where(F.col("d") <= radius)
    best = pairs.groupBy("id").agg(F.min(F.struct("d", "edge", "k", "t", (F.col("x1") + F.col("t") * (F.col("x2") - F.col("x1"))).alias("x"), (F.col("y1") + F.col("t") * (F.col("y2") - F.col("y1"))).alias("y"))).alias("b"))
    return best.select("id", "b.edge", "b.k", "b.t", "b.d", "b.x", "b.y")


def snap_to_edges(nodes: DataFrame, edges: DataFrame, radius: float) -> tuple[DataFrame, DataFrame]:
    """Dead ends beside a road join it: the road gets a node at the nearest place and an edge goes there."""
    if radius <= 0:
        return nodes, edges
    checkpoint_dir(nodes.sparkSession)
    top = nodes.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("_top"))
    snaps = counted(edge_snaps(nodes, edges, radius), ["id"], "_k").join(F.broadcast(top), F.lit(True)).withColumn("node", F.col("_top") + F.col("_k")).checkpoint()
    wider = nodes.unionByName(snaps.select(F.col("node").alias("id"), "x", "y"))
    cut = cut_edges(edges, snaps.select("edge", "k", "t", "node", "x", "y")).checkpoint()
    return wider, cut.unionByName(straight(snaps.select(F.col("id").alias("a"), F.col("node").alias("b")), wider, cut))


def smooth_edges(edges: DataFrame, iterations: int) -> DataFrame:
    if iterations <= 0:
        return edges
    return edges.withColumn("coords", polyline.chaikin(F.col("coords"), iterations)).withColumn("length", polyline.length(F.col("coords")))


def class_thresholds(edges: DataFrame) -> DataFrame:
    """One row: the quartiles of positive frequencies (null without any)."""
    positive = edges.where("frequency > 0")
    return positive.agg(*(F.percentile("frequency", F.lit(q)).alias(name) for q, name in ((0.25, "low"), (0.5, "middle"), (0.75, "high"))))


def annotate(edges: DataFrame) -> DataFrame:
    """With road_class and reconstructed (1 if no track was seen)."""
    f = F.col("frequency")
    named = road_class(f, *(F.coalesce(F.col(c), F.lit(0.0)) for c in ("low", "middle", "high")))
    return edges.join(class_thresholds(edges), F.lit(True)).withColumn("road_class", named).withColumn("reconstructed", (f <= 0).cast("int")).drop("low", "middle", "high")


def count_devices(edges: DataFrame, points: DataFrame, max_dist_m: float) -> DataFrame:
    """Edges with n_devices: devices with a point (device, x, y) whose nearest vertex, nearer than the bound, is the edge's."""
    vertices = edges.select("edge", F.posexplode("coords").alias("k", "p")).select(F.struct("edge", "k").alias("t_id"), "p.x", "p.y")
    own = points.withColumn("p_id", F.monotonically_increasing_id())
    checkpoint_dir(points.sparkSession)
    own = own.checkpoint()
    near = nearest(own.select("p_id", "x", "y"), vertices, max_dist_m).join(own.select("p_id", "device"), "p_id")
    seen = near.select(F.col("t_id.edge").alias("edge"), "device").distinct().groupBy("edge").agg(F.count("*").cast("int").alias("n_devices"))
    return edges.join(seen, "edge", "left").withColumn("n_devices", F.coalesce("n_devices", F.lit(0)))


def frequencies(pixels: DataFrame, points: DataFrame, half_ratio: float = 0.5, max_dist: float = 2.0) -> DataFrame:
    """(edge, frequency): tracks that come near at least that share of an edge's pixels, one at least.

    ``pixels`` (edge, k, x, y): the edge's inner pixels in cells; ``points`` (track_id, x, y) in cells too. A point counts for its nearest pixel.
    """
    targets = pixels.select(F.struct("edge", "k").alias("t_id"), "x", "y")
    if pixels.count() <= FEW_PIXELS:
        targets = F.broadcast(targets)
    own = points.withColumn("p_id", F.monotonically_increasing_id())
    near = nearest(own, targets, max_dist, ("track_id",))
    hits = near.select(F.col("t_id.edge").alias("edge"), F.col("t_id.k").alias("k"), "track_id").distinct().groupBy("edge", "track_id").agg(F.count("*").alias("hits"))
    size = pixels.groupBy("edge").agg(F.count("*").alias("n"))
    enough = hits.join(size, "edge").where(F.col("hits") >= F.greatest(F.lit(1.0), F.col("n") * half_ratio))
    seen = enough.groupBy("edge").agg(F.count("*").cast("int").alias("frequency"))
    return size.join(seen, "edge", "left").select("edge", F.coalesce("frequency", F.lit(0)).alias("frequency"))


def features(edges: DataFrame) -> DataFrame:
    """What the sinks write: id, frequency, length, road_class, reconstructed, n_devices, coords_lonlat; edges with fewer than two points are left out."""
    given = edges.columns
    default = {"road_class": F.lit(""), "reconstructed": F.lit(0), "n_devices": F.lit(0), "coords_lonlat": F.col("coords")}
    columns = [F.col(c) if c in given else d.alias(c) for c, d in default.items()]
    return edges.select(F.col("edge").alias("id"), "frequency", "length", *columns).where(F.size("coords_lonlat") >= 2)


def line_graph(lines: DataFrame, places: int = 7) -> tuple[DataFrame, DataFrame]:
    """Lines (edge, coords in degrees) as a graph: ends rounded to 7 places are nodes, named by hash of the place; frequencies are 0."""
    a, b = F.element_at("coords", 1), F.element_at("coords", -1)
    r = lambda p, c: F.round(p[c], places)
    name = lambda p: F.abs(F.xxhash64(r(p, "x") + 0.0, r(p, "y") + 0.0))
    edges = lines.where(F.size("coords") >= 2).select("edge", name(a).alias("u"), name(b).alias("v"), "coords", polyline.length(F.col("coords")).alias("length"), F.lit(0).alias("frequency"))
    both = lines.where(F.size("coords") >= 2).select(F.explode(F.array(F.struct(name(a).alias("id"), r(a, "x").alias("x"), r(a, "y").alias("y")), F.struct(name(b).alias("id"), r(b, "x").alias("x"), r(b, "y").alias("y")))).alias("n"))
    return both.select("n.*").distinct(), edges


def total_km(edges: DataFrame) -> DataFrame:
    return edges.agg((F.coalesce(F.sum("length"), F.lit(0.0)) / 1000.0).alias("km"))


def as_rows(xy: np.ndarray) -> list[dict]:
    return [{"x": float(a), "y": float(b)} for a, b in xy]
