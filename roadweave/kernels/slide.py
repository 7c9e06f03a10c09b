"""Moving tracks onto the ridges of a density, many tracks at once.

Each inner point feels the slope of the density, its distance from the line between its neighbours, the angle there, and its last move; end points
follow the line of the two next to them. All tracks of a tile move together in one padded array; a track that has settled leaves it.
"""

import numpy as np

#: Weights of slope, distance, angle and momentum; rounds at least and at most; the change of the mean density that counts as none.
WEIGHTS = (0.5, 0.2, 0.1, 0.7)
ROUNDS = (100, 4000)
SETTLED = 5e-4


def field(values: np.ndarray, px: np.ndarray, py: np.ndarray) -> np.ndarray:
    """Bilinear between the four cells around, 0 outside."""
    h, w = values.shape
    c, r = np.floor(px).astype(np.int64), np.floor(py).astype(np.int64)
    inside = (c >= 0) & (r >= 0) & (c < w - 1) & (r < h - 1)
    c, r = np.where(inside, c, 0), np.where(inside, r, 0)
    a, b = px - c, py - r
    top = values[r, c] * (1 - a) + values[r, c + 1] * a
    low = values[r + 1, c] * (1 - a) + values[r + 1, c + 1] * a
    return np.where(inside, top * (1 - b) + low * b, 0.0)


def slopes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half the difference of the neighbours along columns and rows, the whole to the one at a border."""
    gy, gx = (np.gradient(values, axis=k) if values.shape[k] > 1 else np.zeros_like(values) for k in (0, 1))
    return gx, gy


def unit(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.sqrt((v * v).sum(axis=-1))
    return v / np.where(size > 1e-12, size, 1.0)[..., None] * (size > 1e-12)[..., None], size


#: Points of tracks, padded to the longest of them, that move together.
TOGETHER = 20_000


def slide(tracks: list[np.ndarray], values: np.ndarray, ox: float, oy: float, cell: float, weights=WEIGHTS, rounds=ROUNDS) -> list[np.ndarray]:
    """The tracks after moving; those with fewer than three points stay. Tracks of about one length move together."""
    out = [t.copy() for t in tracks]
    slope = slopes(values)
    some: list[int] = []
    for k in [*sorted((k for k, t in enumerate(tracks) if len(t) >= 3), key=lambda k: len(tracks[k])), None]:
        if some and (k is None or (len(some) + 1) * len(tracks[k]) > TOGETHER):
            _move(some, tracks, out, values, slope, ox, oy, cell, weights, rounds)
            some = []
        if k is not None:
            some.append(k)
    return out


def _move(who, tracks, out, values, slope_fields, ox, oy, cell, weights, rounds) -> None:
    gx, gy = slope_fields
    size = np.array([len(tracks[k]) for k in who])
    pts = np.zeros((len(who), int(size.max()), 2))
    for row, k in enumerate(who):
        pts[row, : size[row]] = tracks[k]
    who, move, mean = np.array(who), np.zeros_like(pts), np.zeros(len(who))
    for turn in range(rounds[1]):
        place = np.arange(pts.shape[1])[None, :]
        inner = (place >= 1) & (place < size[:, None] - 1)
        valid = place < size[:, None]
        p = pts[:, 1:-1]
        back, ahead = pts[:, :-2] - p, pts[:, 2:] - p
        along = pts[:, 2:] - pts[:, :-2]
        square = (along * along).sum(axis=-1)
        foot = pts[:, :-2] + along * (-(along * back).sum(axis=-1) / np.where(square > 1e-12, square, 1.0))[..., None]
        bow = np.where((square > 1e-12)[..., None], (pts[:, :-2] + pts[:, 2:]) / 2 - foot, 0.0)
        b, nb = unit(back)
        a, na = unit(ahead)
        bend, _ = unit(a + b)
        angle = bend * (np.minimum(na, nb) * (np.cbrt((a * b).sum(axis=-1)) + 1.0))[..., None]
        px, py = (p[..., 0] - ox) / cell, (p[..., 1] - oy) / cell
        slope = np.stack([field(gx, px, py), field(gy, px, py)], axis=-1)
        change = weights[0] * slope + weights[1] * bow + weights[2] * angle + weights[3] * move[:, 1:-1]
        move[:, 1:-1] = np.where(inner[:, 1:-1, None], change, 0.0)
        pts = pts + move
        for end, one, two in ((np.zeros_like(size), 1, 2), (size - 1, -1, -2)):
            rows = np.arange(len(size))
            first, second = (np.full_like(size, k) if k > 0 else size - 1 + k for k in (one, two))
            two_off = (first >= 0) & (second >= 0) & (first < size) & (second < size)
            d = pts[rows, first] - pts[rows, second]
            square = (d * d).sum(axis=-1)
            t = ((pts[rows, end] - pts[rows, second]) * d).sum(axis=-1) / np.where(square > 1e-12, square, 1.0)
            moved = pts[rows, second] + d * t[:, None]
            pts[rows, end] = np.where((two_off & (square > 1e-12))[:, None], moved, pts[rows, end])
        depth = np.where(valid, field(values, (pts[..., 0] - ox) / cell, (pts[..., 1] - oy) / cell), 0.0).sum(axis=1) / size
        now = 0.2 * mean + 0.8 * depth
        done = (np.abs(now - mean) < SETTLED) & (turn >= rounds[0])
        mean = now
        if done.any() or turn == rounds[1] - 1:
            done = done | (turn == rounds[1] - 1)
            for row in np.flatnonzero(done).tolist():
                out[who[row]] = pts[row, : size[row]].copy()
            pts, move, mean, size, who = pts[~done], move[~done], mean[~done], size[~done], who[~done]
            if not len(who):
                break
            pts, move = pts[:, : int(size.max())], move[:, : int(size.max())]
