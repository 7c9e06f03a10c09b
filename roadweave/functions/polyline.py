"""Polylines as arrays of (x, y) structs, in column expressions; what needs recursion in Arrow batches."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

POINTS = "array<struct<x: double, y: double>>"


def point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def length(coords: Column) -> Column:
    """Sum of the distances between neighbours; 0 for fewer than two points."""
    steps = F.zip_with(F.slice(coords, 1, F.greatest(F.size(coords) - 1, F.lit(0))), F.slice(coords, 2, F.greatest(F.size(coords) - 1, F.lit(0))), lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))
    return F.aggregate(steps, F.lit(0.0), lambda total, x: total + x)


def chaikin(coords: Column, iterations: int = 2) -> Column:
    """Corner cutting, ends kept; fewer than three points stay."""
    for _ in range(iterations):
        cut = F.flatten(F.zip_with(F.slice(coords, 1, F.greatest(F.size(coords) - 1, F.lit(0))), F.slice(coords, 2, F.greatest(F.size(coords) - 1, F.lit(0))), lambda p, q: F.array(point(0.75 * p["x"] + 0.25 * q["x"], 0.75 * p["y"] + 0.25 * q["y"]), point(0.25 * p["x"] + 0.75 * q["x"], 0.25 * p["y"] + 0.75 * q["y"]))))
        coords = F.when(F.size(coords) < 3, coords).otherwise(F.concat(F.slice(coords, 1, 1), cut, F.slice(coords, -1, 1)))
    return coords


def oriented(coords: Column, x: Column, y: Column) -> Column:
    """The same line, starting at the end nearer to (x, y)."""
    a, b = F.element_at(coords, 1), F.element_at(coords, -1)
    return F.when(F.hypot(a["x"] - x, a["y"] - y) <= F.hypot(b["x"] - x, b["y"] - y), coords).otherwise(F.reverse(coords))


def joined(first: Column, second: Column) -> Column:
    """Two lines that share a point, which then stands once."""
    return F.concat(first, F.slice(second, 2, F.greatest(F.size(second) - 1, F.lit(0))))


def end_direction(coords: Column) -> tuple[Column, Column]:
    """Unit vector from the last point but one to the last."""
    a, b = F.element_at(coords, -2), F.element_at(coords, -1)
    n = F.hypot(b["x"] - a["x"], b["y"] - a["y"])
    return F.try_divide(b["x"] - a["x"], n), F.try_divide(b["y"] - a["y"], n)


def equidistant(coords: Column, tolerance: float = 1e-6) -> Column:
    """Whether all steps are as long as each other."""
    steps = F.zip_with(F.slice(coords, 1, F.greatest(F.size(coords) - 1, F.lit(0))), F.slice(coords, 2, F.greatest(F.size(coords) - 1, F.lit(0))), lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))
    return F.coalesce(F.array_max(steps) - F.array_min(steps) <= tolerance, F.lit(True))


def simplify_points(xy: np.ndarray, epsilon: float) -> np.ndarray:
    """Which points Douglas-Peucker keeps: those farther than epsilon from the chord (from its start if it has no length).

    Level by level: the inner points of all chords of a level are measured at once, and each chord is parted at its first farthest point.
    """
    keep = np.zeros(len(xy), bool)
    keep[[0, -1]] = True
    lo, hi = np.array([0]), np.array([len(xy) - 1])
    while len(lo := lo[(wide := hi - lo >= 2)]):
        hi = hi[wide]
        inside = hi - lo - 1
        begin = np.cumsum(inside) - inside
        chord_of = np.repeat(np.arange(len(lo)), inside)
        point_of = np.arange(len(chord_of)) + (lo + 1 - begin)[chord_of]
        chord = xy[hi] - xy[lo]
        size = np.hypot(*chord.T)
        turn, off = chord[chord_of], xy[point_of] - xy[lo[chord_of]]
        flat = (size < 1e-12)[chord_of]
        away = np.where(flat, np.hypot(*off.T), np.abs(turn[:, 0] * off[:, 1] - turn[:, 1] * off[:, 0]) / np.where(size < 1e-12, 1.0, size)[chord_of])
        away = np.where(np.isnan(away), 0.0, away)
        most = np.maximum.reduceat(away, begin)
        at_most = np.flatnonzero(away == most[chord_of])
        split = point_of[at_most[np.searchsorted(chord_of[at_most], np.arange(len(lo)))]]
        far = most > epsilon
        keep[split[far]] = True
        lo, hi = np.concatenate([lo[far], split[far]]), np.concatenate([split[far], hi[far]])
    return keep


def simplify(epsilon: float):
    """Douglas-Peucker as a function of a column of lines. Null stays null."""

    @F.pandas_udf(POINTS)
    def run(lines):
        out = []
        for line in lines:
            if line is None or len(line) < 3 or epsilon <= 0:
                out.append(line)
                continue
            xy = np.array([(p["x"], p["y"]) for p in line], float)
            out.append([p for p, k in zip(line, simplify_points(xy, epsilon)) if k])
        import pandas as pd

        return pd.Series(out)

    return run


def as_arrays(column: pa.Array) -> list[np.ndarray]:
    """Each line of an Arrow column as an array of points."""
    return [np.array([(p["x"], p["y"]) for p in line or []], float).reshape(-1, 2) for line in column.to_pylist()]
