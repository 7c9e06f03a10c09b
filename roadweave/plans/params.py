"""Parameters of road inference, presets, and both from settings."""

import json
from dataclasses import asdict, dataclass, fields


@dataclass(frozen=True)
class Params:
    """All knobs with their defaults. Lengths in metres, times in seconds, sigmas in cells."""

    v_max_kmh: float = 70.0
    a_max: float | None = 4.0
    reb_enabled: bool = False
    aoi_polygon: tuple | None = None
    min_point_dist: float = 10.0
    thin_mode: str = "greedy"
    gap_dt_s: float = 300.0
    gap_ds_m: float = 500.0
    resample_k: float = 5.0
    method: str = "slide"
    cell_tau: float = 5.0
    sigma1: float = 5.0
    sigma2: float = 3.0
    sharpness: float = 1.5
    weights: tuple = (0.5, 0.2, 0.1, 0.7)
    slide_min_loops: int = 100
    slide_max_loops: int = 4000
    slide_close_gaps_m: float = 0.0
    kde_radius: float = 50.0
    gap_buffer_m: float = 30.0
    eps_mode: str = "otsu"
    eps_value: float = 0.0
    eps_percentile: float = 80.0
    fill_holes_m: float = 0.0
    dp_tolerance: float = 2.0
    edge_f_min: int = 2
    edge_l_min: float = 30.0
    protect_long_m: float | None = 200.0
    node_merge_dist: float | None = None
    compute_devices: bool = True
    spur_min_m: float = 0.0
    loop_min_m: float = 0.0
    connect_gap_m: float = 0.0
    bridge_facing_m: float = 0.0
    stitch_max_m: float = 0.0
    break_crossings: bool = False
    junction_m: float = 0.0
    keep_largest: bool = False
    min_component_m: float = 0.0
    smooth_iters: int = 0
    split_mode: str = "auto"
    tile_grid: tuple | None = None
    max_points_per_tile: int = 400_000
    overlap_cells: int = 15
    cache_dir: str = ""
    start_stage: str = ""
    stop_after: str = ""

    def __post_init__(self):
        allowed = {"method": ("slide", "kde"), "eps_mode": ("otsu", "percentile", "manual"), "thin_mode": ("greedy", "consecutive"), "split_mode": ("auto", "off", "forced"), "start_stage": ("", "points", "tracks"), "stop_after": ("", "points", "tracks")}
        for name, values in allowed.items():
            if getattr(self, name) not in values:
                raise ValueError(f"{name} is {getattr(self, name)!r}, not one of {', '.join(map(repr, values))}")
        for name in ("cell_tau", "resample_k"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")

    @staticmethod
    def from_settings(settings: dict) -> "Params":
        """From settings as an interface keeps them: gaps in minutes, protect_long_edges as a switch, adaptive for otsu. Null is the default."""
        s = {k: v for k, v in settings.items() if v is not None}
        names = {f.name for f in fields(Params)}
        given = {k: v for k, v in s.items() if k in names}
        if "gap_dt_min" in s:
            given["gap_dt_s"] = float(s["gap_dt_min"]) * 60.0
        if given.get("eps_mode") == "adaptive":
            given["eps_mode"] = "otsu"
        short = float(given.get("edge_l_min", 30.0))
        if "protect_long_m" not in given:
            given["protect_long_m"] = max(200.0, 5.0 * short) if s.get("protect_long_edges", True) else None
        return Params(**given)

    def as_dict(self) -> dict:
        return asdict(self)


#: Settings by scenario; what isn't named has its default.
PRESETS = {
    "mixed": {"min_point_dist": 10.0, "cell_tau": 5.0, "sigma1": 5.0, "sigma2": 3.0, "sharpness": 1.5, "eps_mode": "otsu", "edge_f_min": 2, "edge_l_min": 30.0, "protect_long_edges": True},
    "highway": {"min_point_dist": 10.0, "cell_tau": 8.0, "sigma1": 5.0, "sigma2": 3.0, "sharpness": 1.0, "eps_mode": "otsu", "edge_f_min": 3, "edge_l_min": 50.0, "protect_long_edges": False},
    "spurs": {"min_point_dist": 5.0, "cell_tau": 4.0, "sigma1": 6.0, "sigma2": 4.0, "sharpness": 2.0, "eps_mode": "adaptive", "edge_f_min": 1, "edge_l_min": 20.0, "protect_long_edges": True},
    "dense_tracks": {"method": "slide", "min_point_dist": 5.0, "gap_dt_min": 5.0, "gap_ds_m": 300.0, "resample_k": 5.0, "cell_tau": 4.0, "sigma1": 4.0, "sigma2": 2.0, "sharpness": 1.5, "eps_mode": "otsu", "edge_f_min": 2, "edge_l_min": 20.0, "protect_long_edges": True, "smooth_iters": 1},
    "urban_logistics": {"method": "slide", "min_point_dist": 10.0, "gap_dt_min": 10.0, "gap_ds_m": 500.0, "resample_k": 15.0, "cell_tau": 6.0, "sigma1": 5.0, "sigma2": 3.0, "sharpness": 1.5, "eps_mode": "percentile", "eps_percentile": 50.0, "edge_f_min": 4, "edge_l_min": 30.0, "protect_long_edges": False, "spur_min_m": 30.0, "smooth_iters": 1},
    "osm_traces": {"method": "slide", "min_point_dist": 8.0, "gap_dt_min": 10.0, "gap_ds_m": 700.0, "resample_k": 20.0, "cell_tau": 6.0, "sigma1": 5.0, "sigma2": 3.0, "sharpness": 1.5, "eps_mode": "percentile", "eps_percentile": 45.0, "edge_f_min": 2, "edge_l_min": 30.0, "protect_long_edges": True, "smooth_iters": 1},
    "sparse_slide": {"method": "slide", "min_point_dist": 15.0, "gap_dt_min": 20.0, "gap_ds_m": 700.0, "resample_k": 50.0, "cell_tau": 10.0, "sigma1": 6.0, "sigma2": 3.0, "sharpness": 1.5, "eps_mode": "percentile", "eps_percentile": 40.0, "edge_f_min": 1, "edge_l_min": 50.0, "protect_long_edges": True, "spur_min_m": 30.0, "smooth_iters": 2},
    "sparse_slide_accurate": {"method": "slide", "min_point_dist": 15.0, "gap_dt_min": 20.0, "gap_ds_m": 700.0, "resample_k": 20.0, "cell_tau": 6.0, "sigma1": 6.0, "sigma2": 3.0, "sharpness": 1.5, "eps_mode": "percentile", "eps_percentile": 40.0, "loop_min_m": 40.0, "edge_f_min": 1, "edge_l_min": 50.0, "protect_long_edges": True, "spur_min_m": 30.0, "smooth_iters": 1},
    "sparse_ais": {"method": "slide", "min_point_dist": 20.0, "gap_dt_min": 30.0, "gap_ds_m": 2000.0, "resample_k": 100.0, "cell_tau": 20.0, "sigma1": 6.0, "sigma2": 3.0, "sharpness": 1.5, "eps_mode": "percentile", "eps_percentile": 50.0, "edge_f_min": 1, "edge_l_min": 100.0, "protect_long_edges": True, "spur_min_m": 50.0, "smooth_iters": 2},
    "fgis_kde": {"method": "kde", "min_point_dist": 10.0, "cell_tau": 10.0, "kde_radius": 50.0, "gap_buffer_m": 40.0, "eps_mode": "percentile", "eps_percentile": 75.0, "fill_holes_m": 30.0, "loop_min_m": 40.0, "edge_f_min": 1, "edge_l_min": 50.0, "protect_long_edges": True, "smooth_iters": 2},
}


def preset(name: str) -> Params:
    """The parameters of a preset; an unknown name is 'mixed'."""
    return Params.from_settings(PRESETS.get(name, PRESETS["mixed"]))


def save_preset(path: str, settings: dict) -> None:
    with open(path, "w", encoding="utf-8") as out:
        json.dump(settings, out, ensure_ascii=False, indent=1, sort_keys=True)


def load_preset(path: str) -> dict:
    with open(path, encoding="utf-8") as file:
        return json.load(file)
