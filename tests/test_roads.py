"""End to end: a cross of streets, driven by sixteen devices."""

import datetime as dt

import numpy as np
import pytest

from roadweave import queries
from roadweave.operators import extract
from roadweave.plans.inference import Cancelled, RoadInference, build_roads, with_lonlat
from roadweave.plans.params import PRESETS, Params, preset

START = dt.datetime(2025, 1, 1)


def cross(seed=0):
    rng, rows = np.random.default_rng(seed), []
    for k in range(16):
        along = np.arange(-100.0, 101.0, 5.0)
        off = rng.normal(0, 0.8) + rng.normal(0, 0.2, len(along))
        x, y = (along, off) if k < 8 else (off, along)
        rows += [(f"d{k}", START + dt.timedelta(seconds=2 * i), 45 + float(b) / 111320, 134 + float(a / (111320 * np.cos(np.radians(45))))) for i, (a, b) in enumerate(zip(x, y))]
    return rows


@pytest.fixture(scope="module")
def fixes(spark):
    return spark.createDataFrame(cross(), "device string, time timestamp, lat double, lon double").cache()


FAST = dict(slide_min_loops=10, slide_max_loops=60, min_point_dist=0.0, edge_l_min=10.0)


def most_ends(edges):
    ends = [n for e in edges.select("u", "v").collect() for n in (e["u"], e["v"])]
    return max(ends.count(n) for n in set(ends))


def test_slide_finds_the_crossing(fixes):
    seen = []
    roads = RoadInference(**FAST).fit(fixes, progress=lambda share, what: seen.append(share))
    assert roads.stats["edges"] >= 4 and most_ends(roads.edges) >= 3
    assert roads.stats["input"] == roads.stats["output"] == 16 * 41 and seen[-1] == 1.0
    assert roads.stats["aoi_removed"] == roads.stats["near_dup_removed"] == 0 and roads.stats["tracks"] == 16 and roads.stats["edges_removed"] >= 0
    assert roads.edges.agg({"n_devices": "max"}).first()[0] >= 4
    nodes, edges = with_lonlat(roads)
    n = nodes.first()
    assert abs(n["lat"] - 45) < 0.01 and abs(n["lon"] - 134) < 0.01
    assert edges.where("size(coords_lonlat) <> size(coords)").count() == 0


def test_four_tiles_find_it_too(fixes):
    roads = RoadInference(split_mode="forced", tile_grid=(2, 2), overlap_cells=4, **FAST).fit(fixes)
    assert roads.stats["tiles"] == 4 and roads.stats["edges"] >= 4


def test_kde(fixes):
    roads = RoadInference(method="kde", kde_radius=8.0, gap_buffer_m=5.0, min_point_dist=0.0, edge_l_min=10.0, eps_mode="percentile", eps_percentile=60.0, smooth_iters=1, spur_min_m=8.0, keep_largest=True).fit(fixes)
    assert roads.stats["edges"] >= 3


def test_stages_resume(fixes, tmp_path):
    p = dict(FAST, cache_dir=str(tmp_path))
    assert build_roads(fixes, Params(stop_after="points", **p)).edges is None
    assert build_roads(None, Params(start_stage="points", stop_after="tracks", **p), spark=fixes.sparkSession).tracks.count() > 100
    assert build_roads(None, Params(start_stage="tracks", **p), spark=fixes.sparkSession).stats["edges"] >= 4


def test_counts_of_what_went(fixes):
    half = [[133.9, 44.9], [134.0, 44.9], [134.0, 45.1], [133.9, 45.1]]
    roads = build_roads(fixes, Params(stop_after="points", aoi_polygon=[half], min_point_dist=12.0))
    assert 0 < roads.stats["aoi_removed"] < fixes.count()
    assert roads.stats["aoi_removed"] + roads.stats["input"] == fixes.count()
    assert roads.stats["near_dup_removed"] == roads.stats["output"] - roads.points.count() > 0


def test_cancel_and_nothing_left(fixes):
    with pytest.raises(Cancelled):
        build_roads(fixes, Params(), cancelled=lambda: True)
    with pytest.raises(ValueError):
        build_roads(fixes.limit(0), Params())


def test_presets():
    assert set(PRESETS) == {"mixed", "highway", "spurs", "dense_tracks", "urban_logistics", "osm_traces", "sparse_slide", "sparse_slide_accurate", "sparse_ais", "fgis_kde"}
    assert preset("spurs").eps_mode == "otsu" and preset("highway").protect_long_m is None and preset("sparse_ais").gap_dt_s == 1800
    assert preset("unknown") == preset("mixed") and preset("mixed").protect_long_m == 200.0
    with pytest.raises(ValueError):
        Params(method="other")


def test_the_registered_run_does_all_rounds_on_all_points(fixes, monkeypatch):
    """With the plan's own rounds, step, cell and smoothing."""
    seen = []

    class Stop(Exception):
        pass

    def caught(points, p):
        seen.append(p)
        raise Stop

    monkeypatch.setattr(queries, "build_roads", caught)
    with pytest.raises(Stop):
        queries.infer_roads_slide(fixes.sparkSession, "/root/testdata/sf0.001")
    for name in ("slide_min_loops", "slide_max_loops", "resample_k", "cell_tau", "sigma1", "sigma2", "sharpness", "weights"):
        assert getattr(seen[0], name) == getattr(Params(), name), name


def test_sliding_is_dealt_to_many_tasks(fixes, monkeypatch):
    """A tile's tracks stand in more than one group once they have more points than a task takes, and move alike."""
    tracks = build_roads(fixes, Params(stop_after="tracks", **FAST)).tracks.selectExpr("0 AS tile", "track_id", "seq", "x", "y")
    both = []
    for most in (50, 1 << 30):
        monkeypatch.setattr(extract, "TASK_POINTS", most)
        both.append({(r["track_id"], r["seq"]): (r["x"], r["y"]) for r in extract.refine(tracks, 50.0, 2.0, 1.5, rounds=(10, 60)).collect()})
    assert both[0].keys() == both[1].keys() and len(both[0]) == tracks.count() > 400
    assert all(np.allclose(both[0][k], both[1][k], atol=1e-6) for k in both[0])
