"""Small inputs with known results, and plain versions where there are none."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadweave.functions import geo, polyline
from roadweave.kernels import skeleton, slide
from roadweave.operators import clean, density, extract, graph, spatial
from roadweave.operators.components import connected_components

START = dt.datetime(2025, 1, 1)


def fixes(spark, rows):
    """(device, seconds, lat, lon)"""
    return spark.createDataFrame([(d, None if t is None else START + dt.timedelta(seconds=t), float(a), float(o)) for d, t, a, o in rows], "device string, time timestamp, lat double, lon double")


def one(frame):
    return frame.first()[0]


def test_cleaning(spark):
    assert clean.deduplicate(fixes(spark, [("a", 0, 45, 130)] * 2 + [("a", 1, 45.1, 130.1)])).count() == 2
    assert clean.drop_invalid(fixes(spark, [("a", 0, 45, 130), ("a", 0, 200, 130), ("a", 0, 45, 999), ("a", None, 45, 130), ("a", 0, float("nan"), 130)])).count() == 1
    for second in (1, 0):
        assert clean.speed_filter(fixes(spark, [("a", 0, 45, 130), ("a", second, 45.1, 130)]), 70, None).count() == 1
    assert clean.speed_filter(fixes(spark, [("a", 0, 45, 130), ("a", 1, 45.0001, 130)])).count() == 2
    out, stats = clean.clean(fixes(spark, [("a", 0, 45, 130)] * 2 + [("a", 0, 200, 130)]))
    assert stats.first().asDict() == {"input": 3, "invalid_removed": 1, "duplicates_removed": 1, "speed_removed": 0, "reb_removed": 0, "output": 1}


def test_spoofed_fixes(spark):
    assert clean.spoof_filter(fixes(spark, [("a", 0, 45, 130), ("a", 1, 45.1, 130)])).count() == 1
    left = clean.spoof_filter(fixes(spark, [("a", 0, 45, 130), ("a", 1800, 45.02, 130), ("a", 3600, 45.0001, 130)]))
    assert [r["lat"] for r in left.orderBy("time").collect()] == [45, 45.0001]
    assert clean.spoof_filter(fixes(spark, [("a", k, 45 + k * 1e-4, 130) for k in range(5)])).count() == 5


def test_segments_and_thinning(spark):
    gaps = clean.segments(fixes(spark, [("a", 0, 45, 130), ("a", 10, 45, 130.001), ("a", 7200, 45, 130.002)]))
    assert [r["track_id"] for r in gaps.orderBy("time").collect()] == ["a#0", "a#0", "a#1"]
    assert clean.segments(fixes(spark, [("a", 0, 45, 130), ("a", 10, 45.02, 130)])).select("track_id").distinct().count() == 2
    slow = fixes(spark, [("a", k, 45 + k * 1e-5, 130) for k in range(40)])
    assert 0 < clean.thin_consecutive(slow).count() < 40
    kept = [r["lat"] for r in clean.thin_greedy(slow).orderBy("time").collect()]
    assert len(kept) == 5 and min(np.diff(kept)) * 111195 >= 9
    assert clean.thin_greedy(slow, 0).count() == clean.thin_consecutive(slow, 0).count() == 40


def test_distances_and_projection(spark):
    d = spark.range(1).select(geo.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)))
    assert abs(one(d) - 111195) < 250
    points = spark.createDataFrame([(45.0, 134.0), (45.01, 134.02), (-60.0, 140.0), (70.0, 128.0), (0.0, 134.0)], "lat double, lon double")
    flat = geo.project(points, 134.0)
    first = flat.first()
    assert abs(first["x"]) < 1e-6 and abs(first["y"] - 4984944.378) < 0.01  # the meridian from the equator to 45 degrees
    back = geo.unproject(flat.withColumnRenamed("lat", "lat0").withColumnRenamed("lon", "lon0"), 134.0)
    assert one(back.select(F.max(F.abs(F.col("lat") - F.col("lat0")) + F.abs(F.col("lon") - F.col("lon0"))))) < 1e-9
    x, y = geo.azimuthal(F.lit(89.0), F.lit(0.0), 90.0, 0.0)
    assert abs(math.hypot(*spark.range(1).select(x, y).first()) - 111195) < 20


def test_rings(spark):
    square, hole = [(0, 0), (10, 0), (10, 10), (0, 10)], [(4, 4), (6, 4), (6, 6), (4, 6)]
    rows = spark.createDataFrame([(5.0, 5.0), (15.0, 5.0), (-1.0, 5.0), (9.9, 9.9)], "lon double, lat double")
    assert [r[0] for r in rows.select(geo.in_rings(F.col("lon"), F.col("lat"), [square])).collect()] == [True, False, False, True]
    assert [r[0] for r in rows.select(geo.in_rings(F.col("lon"), F.col("lat"), [square, hole])).collect()] == [False, False, False, True]


def tracks(spark, lines):
    return spark.createDataFrame([(name, k, float(x), float(y)) for name, line in lines.items() for k, (x, y) in enumerate(line)], "track_id string, seq int, x double, y double")


def test_resampling(spark):
    own = tracks(spark, {"line": [(0, 0), (100, 0)], "corner": [(0, 0), (0, 100), (100, 100)], "still": [(1, 1), (1, 1)], "half": [(0, 0), (25, 0)]})
    n = {r["track_id"]: r["count"] for r in clean.resample(own, 10).groupBy("track_id").count().collect()}
    assert n == {"line": 11, "corner": 21, "still": 1, "half": 3}
    corner = clean.resample(own.where("track_id = 'corner'"), 25).orderBy("seq").collect()
    assert [(r["x"], r["y"]) for r in corner] == [(0, 0), (0, 25), (0, 50), (0, 75), (0, 100), (25, 100), (50, 100), (75, 100), (100, 100)]
    packed = clean.pack(clean.resample(own, 10))
    assert packed.where(~polyline.equidistant(F.col("coords"), 1e-6)).count() == 0
    assert clean.unpack(packed).count() == 36
    with pytest.raises(ValueError):
        clean.resample(own, 0)


def test_lines(spark):
    bend = [{"x": float(x), "y": float(y)} for x, y in [(0, 0), (5, 0.5), (10, 0), (10, 10)]]
    row = spark.createDataFrame([(bend,), (bend[:2],), (bend[:1],), (None,)], f"c {polyline.POINTS}")
    assert [r[0] for r in row.select(F.size(polyline.chaikin(F.col("c"), 1))).collect()] == [8, 2, 1, -1] or [r[0] for r in row.select(F.size(polyline.chaikin(F.col("c"), 1))).collect()] == [8, 2, 1, None]
    kept = [r[0] for r in row.select(polyline.simplify(1.0)("c")).collect()]
    assert [(p["x"], p["y"]) for p in kept[0]] == [(0, 0), (10, 0), (10, 10)] and kept[3] is None
    got = row.limit(1).select(polyline.length(F.col("c")).alias("l"), polyline.oriented(F.col("c"), F.lit(10.0), F.lit(9.0))[0]["y"].alias("y"), F.size(polyline.joined(F.col("c"), F.reverse("c"))).alias("n")).first()
    assert abs(got["l"] - (2 * math.hypot(5, 0.5) + 10)) < 1e-9 and got["y"] == 10 and got["n"] == 7


def test_extent(spark):
    e = clean.extent(fixes(spark, [("a", 0, 10, 179), ("a", 1, 20, -179)])).first()
    assert abs(abs(e["center_lon"]) - 180) < 1e-9 and e["center_lat"] == 15 and abs(e["arc"] - 2) < 1e-6 and e["antimeridian"]
    assert clean.extent(fixes(spark, [])).first()["center_lon"] is None


def test_grid_and_density(spark):
    own = tracks(spark, {"a": [(0, 0), (10, 0)], "b": [(0, 0), (10, 0)], "c": [(100, 50)]})
    g = density.grid(own, 10.0, 2).first()
    assert (g["ox"], g["oy"], g["width"], g["height"]) == (-20, -20, 15, 10)
    meta = density.grid(own, 1.0)
    assert one(density.density(own, meta).agg(F.max("v"))) == 2
    same = tracks(spark, {"a": [(0, 0)] * 3})
    assert one(density.density(same, density.grid(same, 1.0)).select("v")) == 1 and one(density.density(same, density.grid(same, 1.0), "points").select("v")) == 3
    with pytest.raises(Exception, match="take larger cells"):
        density.grid(own, 1e-5).collect()


def cells(spark, array):
    return spark.createDataFrame([(int(r), int(c), float(array[r, c])) for r, c in zip(*np.nonzero(array))], "row long, col long, v double")


def shape(spark, h, w):
    return spark.createDataFrame([(0.0, 0.0, 1.0, w, h)], "ox double, oy double, cell double, width long, height long")


def back(frame, h, w, column="v"):
    out = np.zeros((h, w))
    for r in frame.collect():
        out[r["row"], r["col"]] = r[column] if column in r else 1
    return out


def test_rasters_against_numpy(spark):
    rng = np.random.default_rng(3)
    array = rng.integers(0, 4, (9, 12)) * (rng.random((9, 12)) < 0.4)
    frame, meta, weights = cells(spark, array), shape(spark, 9, 12), density.sharpened(1.0, 1.5)
    assert abs(sum(weights) - 1) < 1e-12 and len(weights) == 9 and density.sharpened(0) == [1.0]
    want = np.apply_along_axis(np.convolve, 1, np.apply_along_axis(np.convolve, 0, array, weights, "same"), weights, "same")
    assert np.allclose(back(density.smooth(frame, meta, 1.0), 9, 12), want)
    gy, gx = np.gradient(array.astype(float))
    slopes = density.gradient(frame, meta).cache()
    assert np.allclose(back(slopes, 9, 12, "gx"), gx) and np.allclose(back(slopes, 9, 12, "gy"), gy)
    mask = array > 1
    wide = np.zeros_like(mask)
    for r, c in zip(*np.nonzero(mask)):
        for i in range(9):
            for j in range(12):
                wide[i, j] |= abs(i - r) + abs(j - c) <= 2
    assert (back(density.dilate(frame.where("v > 1").select("row", "col"), meta, 2), 9, 12) == wide).all()


def test_holes_are_filled(spark):
    rng = np.random.default_rng(8)
    for _ in range(3):
        mask = rng.random((12, 15)) < 0.65
        want, seen = mask.copy(), mask.copy()
        for start in zip(*np.nonzero(~mask)):
            if seen[start]:
                continue
            part, todo = [], [start]
            seen[start] = True
            while todo:
                r, c = todo.pop()
                part.append((r, c))
                for q in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                    if 0 <= q[0] < 12 and 0 <= q[1] < 15 and not seen[q]:
                        seen[q] = True
                        todo.append(q)
            if len(part) < 4:
                for p in part:
                    want[p] = True
        got = density.holes(cells(spark, mask).select("row", "col"), shape(spark, 12, 15), 4)
        assert (back(got, 12, 15) == want).all()


def test_thresholds(spark):
    ridge = np.zeros((5, 5))
    ridge[2, 1:4] = 10.0
    assert density.mask(cells(spark, ridge), density.otsu(cells(spark, ridge))).count() == 3
    four = cells(spark, np.array([[1.0, 2.0, 10.0, 50.0]]))
    assert one(density.percentile(four, 50)) == 6.0 and density.mask(four, density.percentile(four, 50)).count() == 2
    assert one(density.threshold(four, "manual", 3.5)) == 3.5
    with pytest.raises(ValueError):
        density.threshold(four, "other")


def test_histograms(spark):
    values = spark.createDataFrame([(float(x),) for x in [0, 1, 2, 3, 10]] + [(None,), (float("nan"),)], "v double")
    counts, edges = np.histogram([0, 1, 2, 3, 10], bins=5)
    rows = density.histogram(values, bins=5).orderBy("bin").collect()
    assert [r["n"] for r in rows] == counts.tolist() and np.allclose([r["lo"] for r in rows], edges[:-1])
    assert sum(r["n"] for r in density.histogram(values, scale="log").collect()) == 5
    assert density.summary(values).first().asDict() == {"count": 5, "min": 0.0, "median": 2.0, "mean": 3.2, "max": 10.0}
    assert density.summary(values.limit(0)).first()["max"] == 0.0 and density.histogram(values.limit(0)).count() == 0


def test_thinning_of_masks():
    bar = np.zeros((13, 15), bool)
    bar[5:8, 3:12] = True
    thin = skeleton.zhang_suen(bar)
    assert 5 <= thin.sum() < bar.sum() and not (thin[1:, 1:] & thin[:-1, 1:] & thin[1:, :-1] & thin[:-1, :-1]).any()
    line = np.zeros((5, 9), bool)
    line[2, 1:8] = True
    nodes, edges = skeleton.pixel_graph(line)
    assert len(nodes) == 2 and len(edges) == 1 and len(edges[0][2]) == 7
    plus = np.zeros((11, 11), bool)
    plus[5, 1:10] = plus[1:10, 5] = True
    nodes, edges = skeleton.pixel_graph(plus)
    ends = [n for u, v, _ in edges for n in (u, v)]
    assert len(nodes) >= 5 and len(edges) >= 4 and max(map(ends.count, ends)) >= 3
    ring = np.zeros((7, 7), bool)
    ring[1, 2:5] = ring[5, 2:5] = ring[2:5, 1] = ring[2:5, 5] = True
    nodes, edges = skeleton.pixel_graph(ring)
    assert len(nodes) == 1 and len(edges) == 1 and edges[0][0] == edges[0][1] and edges[0][2][0] == edges[0][2][-1]
    assert skeleton.pixel_graph(np.eye(1, dtype=bool)) == ([], [])


def test_each_link_of_pixels_is_in_one_edge():
    rng = np.random.default_rng(5)
    closed = np.zeros((9, 11), bool)
    closed[1, 2:9] = closed[7, 2:9] = closed[2:7, 1] = closed[2:7, 9] = True
    for k in range(60):
        mask = rng.random((9, 11)) < (0.15, 0.3, 0.5)[k % 3] if k else closed
        nodes, edges = skeleton.pixel_graph(np.pad(mask | closed if k % 2 else mask, ((0, 0), (0, 3))))
        pixels = set(zip(*(x.tolist() for x in np.nonzero(mask | closed if k % 2 else mask))))
        links = {frozenset((p, q)) for p in pixels for r, c in skeleton.RING if (q := (p[0] + r, p[1] + c)) in pixels}
        found = [frozenset(link) for _, _, path in edges for link in zip(path, path[1:])]
        assert len(found) == len(set(found)) and set(found) == links
        many = {p: sum(p in link for link in links) for p in pixels}
        for u, v, path in edges:
            assert path[0] == nodes[u] and path[-1] == nodes[v] and all(many[p] == 2 for p in path[1:-1])
            assert many[nodes[u]] != 2 or (u == v and min(path) == path[0])


def test_lines_are_simplified_as_by_recursion():
    def kept(xy, a, b, epsilon):
        if b - a < 2:
            return set()
        (x0, y0), (x1, y1) = xy[a], xy[b]
        size = math.hypot(x1 - x0, y1 - y0)
        off = [abs((x1 - x0) * (y - y0) - (y1 - y0) * (x - x0)) / size if size > 1e-12 else math.hypot(x - x0, y - y0) for x, y in xy[a + 1 : b]]
        k = a + 1 + off.index(max(off))
        return {k} | kept(xy, a, k, epsilon) | kept(xy, k, b, epsilon) if max(off) > epsilon else set()

    rng = np.random.default_rng(6)
    for k in range(200):
        xy = rng.integers(0, 5, (rng.integers(2, 40), 2)).astype(float)
        assert set(np.flatnonzero(polyline.simplify_points(xy, 0.9)).tolist()) == {0, len(xy) - 1} | kept(xy.tolist(), 0, len(xy) - 1, 0.9)


def test_tracks_slide_to_the_ridge():
    rows = np.arange(40)[:, None]
    ridge = np.repeat(np.exp(-((rows - 20) ** 2) / 50.0), 60, axis=1)
    line = np.stack([np.arange(5.0, 55.0, 2.0), np.full(25, 14.0)], axis=1)
    short = np.array([[1.0, 1.0], [2.0, 2.0]])
    moved = slide.slide([line, short, line[::2] + [0, 1]], ridge, 0.0, 0.0, 1.0, rounds=(50, 400))
    assert 15 < moved[0][:, 1].mean() < 21 and (moved[1] == short).all() and moved[2].shape == line[::2].shape
    alone = slide.slide([line], ridge, 0.0, 0.0, 1.0, rounds=(50, 400))
    assert np.allclose(alone[0], moved[0])


def net(spark, places, links):
    """Places {id: (x, y)} and links (u, v, frequency) or with a line."""
    nodes = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in places.items()], "id long, x double, y double")
    rows = []
    for k, (u, v, f, *line) in enumerate(links):
        xy = np.array(line[0] if line else [places[u], places[v]], float)
        rows.append((k, u, v, graph.as_rows(xy), float(np.hypot(*np.diff(xy, axis=0).T).sum()), f))
    return nodes, spark.createDataFrame(rows, graph.EDGE)


def test_components(spark):
    rng = np.random.default_rng(6)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + k, 1001 + k) for k in range(60)] + [(7, 7), (None, 3)]
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in pairs:
        if a is not None:
            up[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {x: find(x) for x in up}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_chains_spurs_and_loops(spark):
    _, edges = net(spark, {0: (0, 0), 1: (1, 0), 2: (2, 0), 3: (3, 0)}, [(0, 1, 3), (2, 1, 5), (2, 3, 4)])
    merged = graph.merge_chains(edges).collect()
    assert [(r["u"], r["v"], r["length"], r["frequency"], len(r["coords"])) for r in merged] == [(0, 3, 3.0, 5, 4)]
    _, road = net(spark, {0: (0, 0), 1: (50, 0), 2: (100, 0), 3: (50, 0.5)}, [(0, 1, 1), (1, 2, 1), (1, 3, 1)])
    assert graph.remove_short_spurs(road, 1.5).count() == 2 and graph.remove_short_spurs(road, 0.4).count() == 3
    _, loop = net(spark, {0: (0, 0)}, [(0, 0, 1, [(0, 0), (1, 0), (0, 0)])])
    assert graph.remove_small_loops(loop, 5).count() == 0 and graph.merge_chains(loop).count() == 1
    _, circle = net(spark, {0: (0, 0), 1: (1, 0), 2: (0, 1)}, [(0, 1, 1), (1, 2, 2), (2, 0, 1)])
    r = graph.merge_chains(circle).collect()
    assert len(r) == 1 and r[0]["u"] == r[0]["v"] and r[0]["frequency"] == 2


def test_bridges(spark):
    nodes, edges = net(spark, {0: (0, 0), 1: (10, 0), 2: (12, 0), 3: (22, 0)}, [(0, 1, 1), (2, 3, 1)])
    assert [(r["a"], r["b"]) for r in graph.end_bridges(nodes, edges, 5).collect()] == [(1, 2)] and graph.end_bridges(nodes, edges, 1).count() == 0
    assert graph.connect_dead_ends(nodes, edges, 5).count() == 3
    assert [(r["a"], r["b"]) for r in graph.facing_pairs(nodes, edges, 50).collect()] == [(1, 2)]
    nodes, edges = net(spark, {0: (0, 0), 1: (10, 0), 2: (12, 0), 3: (12, 10)}, [(0, 1, 1), (2, 3, 1)])
    assert graph.facing_pairs(nodes, edges, 5).count() == 0 and graph.bridge_facing(nodes, edges, 5).count() == 2


def test_stitches(spark):
    nodes, edges = net(spark, {0: (0, 0), 1: (10, 0), 2: (110, 0), 3: (120, 0), 4: (110, 30), 5: (120, 30)}, [(0, 1, 1), (2, 3, 1), (4, 5, 1)])
    assert sorted(map(tuple, graph.stitches(nodes, edges, 150).collect())) == [(1, 2), (2, 4)]
    assert graph.stitches(nodes, edges, 20).count() == 0
    assert graph.components(nodes, graph.stitch_components(nodes, edges, 150)).select("component").distinct().count() == 1


def test_snaps(spark):
    nodes, edges = net(spark, {0: (0, 0), 1: (100, 0), 2: (50, 5), 3: (50, 60)}, [(0, 1, 4), (2, 3, 1)])
    wider, cut = graph.snap_to_edges(nodes, edges, 6)
    assert cut.count() == 4 and wider.count() == 5 and graph.components(wider, cut).select("component").distinct().count() == 1
    assert sorted(r["frequency"] for r in cut.collect()) == [0, 1, 4, 4] and abs(one(cut.agg(F.sum("length"))) - 160) < 1e-9


def test_crossings(spark):
    nodes, edges = net(spark, {0: (0, -5), 1: (10, 5), 2: (0, 5), 3: (10, -5)}, [(0, 1, 1), (2, 3, 1)])
    wider, cut = graph.break_at_crossings(nodes, edges)
    assert wider.count() == 5 and cut.count() == 4 and [(r["x"], r["y"]) for r in wider.where("id > 3").collect()] == [(5, 0)]
    for other in ({2: (0, 1), 3: (10, 11)}, {2: (5, 0), 3: (5, 9)}):
        nodes, edges = net(spark, {0: (0, 0), 1: (10, 10) if other[2] == (0, 1) else (10, 0), **other}, [(0, 1, 1), (2, 3, 1)])
        assert graph.break_at_crossings(nodes, edges)[1].count() == 2
    # two cuts in one edge, one of them between its points
    nodes, edges = net(spark, {0: (0, 0), 1: (30, 0), 2: (5, -5), 3: (5, 5), 4: (25, -5), 5: (25, 5)}, [(0, 1, 2, [(0, 0), (15, 0), (30, 0)]), (2, 3, 1), (4, 5, 1)])
    cut = graph.break_at_crossings(nodes, edges)[1].collect()
    assert len(cut) == 7 and sorted(round(r["length"], 6) for r in cut if r["frequency"] == 2) == [5, 5, 20]


def test_merging_nodes(spark):
    nodes, edges = net(spark, {0: (0, 0), 1: (0.6, 0), 2: (50, 0)}, [(0, 1, 1), (1, 2, 3)])
    n, e = graph.merge_close_nodes(nodes, edges, 1.0)
    assert n.count() == 2 and e.count() == 1
    nodes, edges = net(spark, {0: (0, 0), 1: (10, 0)}, [(0, 1, 1), (1, 0, 3)])
    assert [r["frequency"] for r in graph.merge_parallel(edges).collect()] == [4]
    tiles = nodes.withColumn("tile", F.lit(0)).union(nodes.selectExpr("id", "x + 9.9 AS x", "y", "1 AS tile"))
    n, e = graph.merge_tiles(tiles, edges.limit(1).withColumn("tile", F.lit(0)).union(edges.limit(1).withColumn("tile", F.lit(1))), 1.0)
    assert n.count() == 3 and e.count() == 2


def test_parts_and_weights(spark):
    nodes, edges = net(spark, {0: (0, 0), 1: (10, 0), 2: (50, 50), 3: (55, 50), 9: (99, 99)}, [(0, 1, 0), (2, 3, 7)])
    assert [r["length"] for r in graph.largest_component(nodes, edges)[1].collect()] == [10.0]
    assert graph.remove_small_components(nodes, edges, 7)[0].count() == 2 and graph.prune_orphans(nodes, edges).count() == 4
    assert {r["id"]: r["component"] for r in graph.components(nodes, edges).collect()} == {0: 0, 1: 0, 2: 2, 3: 2, 9: 9}
    assert graph.filter_edges(edges, 2, 30).count() == 1 and graph.filter_edges(edges, 2, 30, 10.0).count() == 2
    _, four = net(spark, {0: (0, 0), 1: (1, 0)}, [(0, 1, f) for f in (1, 5, 10, 100)])
    quart = graph.class_thresholds(four).first()
    assert (quart["low"], quart["middle"], quart["high"]) == (4.0, 7.5, 32.5)
    assert [r["road_class"] for r in graph.annotate(four).orderBy("frequency").collect()] == ["winter", "ordinary", "improved", "main"]
    assert [r["reconstructed"] for r in graph.annotate(edges).orderBy("frequency").collect()] == [1, 0]
    points = spark.createDataFrame([("a", 0.0, 1.0), ("a", 9.0, 0.0), ("b", 10.0, 1.0), ("c", 30.0, 30.0)], "device string, x double, y double")
    assert {r["edge"]: r["n_devices"] for r in graph.count_devices(edges, points, 3.0).collect()} == {0: 2, 1: 0}


def test_tiles(spark):
    plan = spatial.plan_tiles(0, 0, 250, 100, 100, 10)
    assert len(plan) == 3 and plan[2]["cx0"] == 200 and plan[0]["rx1"] == 110
    assert len(spatial.choose_tiling(10, 0, 0, 9, 9, 1.0)) == 1 and len(spatial.choose_tiling(4_000_000, 0, 0, 100, 100, 1.0)) == 16
    own = tracks(spark, {"t": [(50, 50), (95, 50), (150, 50), (120, 50), (96, 50), (50, 50), (400, 50)]})
    runs = spatial.assign_tiles(own, 0, 0, 100, 2, 1, 10).groupBy("tile", "run").count().collect()
    assert {(r["tile"], r["run"]): r["count"] for r in runs} == {(0, 0): 2, (0, 1): 2, (1, 0): 4}


def test_tiles_reach_the_far_side(spark):
    # three thirds of this width are a rounding short of it
    x0, x1 = 0.01, 999.99
    assert -(x1 - x0) // ((x1 - x0) / 3) == -4
    plan = spatial.choose_tiling(0, x0, 0.05, x1, 999.9, 5.0, "forced", (3, 2), overlap_cells=0)
    assert [(t["tile"], t["i"], t["j"]) for t in plan] == [(3 * j + i, i, j) for j in range(3) for i in range(3)]
    rng = np.random.default_rng(3)
    for low, high, k in zip(rng.integers(0, 99, 500) / 100, rng.integers(100, 99_999, 500) / 100, rng.integers(2, 40, 500)):
        assert len(spatial.choose_tiling(0, low, 0.0, high, 0.0, 0.001, "forced", (int(k), 1))) == k
    size = float(np.nextafter((x1 - x0) / 3, 0))
    own = tracks(spark, {"t": [(x1 - 1, 5), (x1, 5)]})
    assert spatial.assign_tiles(own, x0, 0.0, size, 3, 1, 0.0).groupBy("tile").count().collect() == [(2, 2)]


def test_dense_tiles_hold_few_copies(spark):
    # 58 million points in 1 km by 1 km: 13 by 13 tiles of 77 m with 150 m around would hold each point 20 times
    plan = spatial.choose_tiling(58_000_000, 0, 0, 1000, 1000, 10.0, overlap_cells=15, least=450.0)
    assert len(plan) == 4 and plan[0]["cx1"] == 500
    assert len(spatial.choose_tiling(58_000_000, 0, 0, 1000, 1000, 10.0, "forced", (13, 13), least=450.0)) == 169
    own = tracks(spark, {"t": [(50, 50), (95, 50), (150, 50)]}).checkpoint()
    plan = spatial.assign_tiles(own, 0, 0, 100, 2, 1, 10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(track_id" in plan


def test_a_tile_moves_in_parts(spark):
    rng = np.random.default_rng(4)
    own = {str(k): [(float(x), 50 + float(y)) for x, y in zip(range(0, 200, 10), rng.normal(0, 4, 20))] for k in range(30)}
    tiled = tracks(spark, own).withColumn("tile", F.lit(0))
    seen = [extract.refine(tiled, 10.0, 2.0, 1.5, rounds=(10, 40), most=most) for most in (400_000, 100)]
    assert "part" in seen[1]._jdf.queryExecution().analyzed().toString()
    a, b = ({(r["track_id"], r["seq"]): (r["x"], r["y"]) for r in f.collect()} for f in seen)
    assert len(a) == 600 and a.keys() == b.keys() and max(abs(x - y) for k in a for x, y in zip(a[k], b[k])) < 1e-9


def test_nearest_is_exact(spark):
    rng = np.random.default_rng(9)
    a, b = rng.random((200, 2)) * 100, rng.random((60, 2)) * 100
    left = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(a)], "p_id long, x double, y double")
    right = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(b)], "t_id long, x double, y double")
    got = {r["p_id"]: r["t_id"] for r in spatial.nearest(left, right, 8.0).collect()}
    d = np.hypot(*(a[:, None] - b[None]).transpose(2, 0, 1))
    assert got == {k: int(row.argmin()) for k, row in enumerate(d) if row.min() < 8}
