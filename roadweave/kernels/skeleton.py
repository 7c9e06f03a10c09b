"""Thinning of a mask to lines one pixel wide, and the lines as a pixel graph."""

import numpy as np

#: The eight neighbours in a ring, from above clockwise.
RING = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))


def around(mask: np.ndarray) -> np.ndarray:
    """The ring of each pixel, as a stack of eight shifted masks."""
    wide = np.pad(mask, 1)
    h, w = mask.shape
    return np.stack([wide[1 + r : 1 + r + h, 1 + c : 1 + c + w] for r, c in RING])


def zhang_suen(mask: np.ndarray) -> np.ndarray:
    """Thins by turns from the south-east and the north-west until nothing changes (Zhang, Suen 1984)."""
    mask = mask.astype(bool).copy()
    while True:
        before = int(mask.sum())
        for faces in (((0, 2, 4), (2, 4, 6)), ((0, 2, 6), (0, 4, 6))):
            ring = around(mask)
            count = ring.sum(axis=0)
            rises = (~ring & np.roll(ring, -1, axis=0)).sum(axis=0)
            open_faces = ~ring[list(faces[0])].all(axis=0) & ~ring[list(faces[1])].all(axis=0)
            mask &= ~((count >= 2) & (count <= 6) & (rises == 1) & open_faces)
        if int(mask.sum()) == before:
            return mask


def neighbour_count(mask: np.ndarray) -> np.ndarray:
    return around(mask.astype(bool)).sum(axis=0)


def _followed(node: np.ndarray, p: np.ndarray, previous: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each link: the first link of its path, how many links lie between, and the least pixel that was passed. Each round doubles the reach."""
    start, steps, least = np.where(node[p], np.arange(len(p)), previous), (~node[p]).astype(np.int64), p.copy()
    for _ in range(len(p).bit_length()):
        least = np.minimum(least, least[start])
        steps, start = steps + steps[start], start[start]
    return start, steps, least


def pixel_graph(skeleton: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple[int, int, list[tuple[int, int]]]]]:
    """Nodes (row, col) where lines end or meet, and edges (node, node, pixels from one to the other). A closed line has one node, its least pixel.

    Pixels without neighbours are left out. Links between neighbouring pixels are contracted by pointer doubling, all paths at once; of the two
    directions of a path the one that starts with the lesser link is the edge.
    """
    rows, cols = np.nonzero(skeleton)
    n = len(rows)
    name = np.full(tuple(x + 2 for x in np.shape(skeleton)), -1)
    name[rows + 1, cols + 1] = np.arange(n)
    ring = np.array([name[rows + 1 + r, cols + 1 + c] for r, c in RING]).reshape(8, n)
    k, p = np.nonzero(ring >= 0)
    q = ring[k, p]
    order = np.lexsort((q, p))
    p, q = p[order], q[order]
    if not len(p):
        return [], []
    back = np.lexsort((p, q))  # the same link the other way round
    degree, first = np.bincount(p, minlength=n), np.searchsorted(p, np.arange(n))
    node = (degree > 0) & (degree != 2)
    beside = np.where(node[p], 0, 2 * first[p] + 1 - np.arange(len(p)))  # the other link out of a pixel that has two
    start, steps, least = _followed(node, p, back[beside])
    closed = ~node[p[start]]
    nodes = np.concatenate([np.flatnonzero(node), np.unique(least[closed])])
    if closed.any():
        node[nodes] = True
        start, steps, _ = _followed(node, p, back[beside])
    number = np.full(n, -1)
    number[nodes] = np.arange(len(nodes))
    last = np.flatnonzero(node[q])
    last = last[start[last] < back[last]]
    last = last[np.lexsort((q[start[last]], number[p[start[last]]]))]
    edge = np.full(len(p), -1)
    edge[start[last]] = np.arange(len(last))
    own = np.flatnonzero(edge[start] >= 0)
    own = own[np.lexsort((steps[own], edge[start[own]]))]
    place = list(zip(rows.tolist(), cols.tolist()))
    along, ends = q[own].tolist(), np.cumsum(steps[last] + 1).tolist()
    edges = []
    for k, (a, b, u) in enumerate(zip([0, *ends], ends, p[start[last]].tolist())):
        path = [place[u], *(place[x] for x in along[a:b])]
        edges.append((int(number[u]), int(number[q[last[k]]]), path))
    return [place[x] for x in nodes.tolist()], edges
