"""Time warping of many pairs at once, after bounds that tell which pairs can't be the best.

All pairs are warped in single precision first, with costs that are lowered by
more than rounding can raise them: some additions a cell for tiles of pairs,
which fit the processor's cache. Pairs whose bound loses to what is known are
never warped in double precision, and a warping stops when every path so far
costs more than its pair may.
"""

from __future__ import annotations

import numpy as np

#: Cells of cost tables that are worked on at once.
CELLS = 1 << 21
#: Pairs of a tile: rows of either side.
TILE = (32, 512)


def allowed(n: int, m: int, band: int | None) -> np.ndarray:
    """n x m, which frames may be paired: within `band` of the diagonal from end to end; all without a band."""
    if band is None or n == 1 or m == 1:
        return np.ones((n, m), bool)
    slope = (m - 1) / (n - 1)
    return np.abs(np.arange(n)[:, None] * slope - np.arange(m)) <= max(band, slope, 1)


def warped(a: np.ndarray, b: np.ndarray, limit: np.ndarray | float = np.inf, band: int | None = None) -> np.ndarray:
    """Warping distances of pairs a[i] (n frames), b[i] (m frames), before they are divided by length; inf where it is more than the pair's limit."""
    n, m = a.shape[1], b.shape[1]
    out, limit = np.full(len(a), np.inf), np.broadcast_to(np.asarray(limit, float), len(a))
    open_ = allowed(n, m, band)
    step = max(1, CELLS // (n * m))
    for start in range(0, len(a), step):
        who = np.arange(start, min(start + step, len(a)))
        cost = np.where(open_, np.linalg.norm(a[who, :, None] - b[who, None], axis=3), np.inf)
        most = limit[who]
        older, old = np.full((len(who), n + 1), np.inf), np.full((len(who), n + 1), np.inf)
        older[:, 0] = 0
        for k in range(2, n + m + 1):  # cells (i, k - i), all of them known from two diagonals before
            i = np.arange(max(1, k - m), min(n, k - 1) + 1)
            new = np.full_like(old, np.inf)
            new[:, i] = cost[:, i - 1, k - i - 1] + np.minimum(np.minimum(old[:, i], old[:, i - 1]), older[:, i - 1])
            older, old = old, new
            alive = np.minimum(old.min(axis=1), older.min(axis=1)) <= most
            if 2 * alive.sum() < len(who):
                who, cost, most, older, old = who[alive], cost[alive], most[alive], older[alive], old[alive]
                if not len(who):
                    break
        done = old[:, n]
        out[who] = np.where(done <= most, done, np.inf)
    return out


def bounds(a: np.ndarray, b: np.ndarray, band: int | None = None) -> np.ndarray:
    """Least possible warping distances of each of a (n frames) with each of b (m frames), a little below the true ones."""
    (n, dim), m = a.shape[1:], b.shape[1]
    open_, out = allowed(n, m, band), np.empty((len(a), len(b)), np.float32)
    size = max((np.abs(x[np.isfinite(x)]).max(initial=0) for x in (a, b)), default=0) or 1.0
    # a squared distance x.x - 2 x.y + y.y as one product; its rounding is below (dim + 6) * 2**-23 * (x.x + y.y)
    lower = 1 - (dim + 8) * 2.0**-22
    sides = []
    for x, first, ones in ((a / size, -2, 1), (b / size, 1, 0)):
        square, one = lower * (x * x).sum(axis=2, keepdims=True), np.ones((*x.shape[:2], 1))
        sides.append(np.concatenate([first * x, square, one] if ones else [x, one, square], axis=2).astype(np.float32))
    x, y = (side.transpose(1, 0, 2) for side in sides)  # frame, row, number
    for t in range(0, len(b), TILE[1]):
        right = y[:, t : t + TILE[1]].transpose(0, 2, 1).copy()
        wide = right.shape[2]
        for s in range(0, len(a), TILE[0]):
            tall = min(TILE[0], len(a) - s)
            cost, low, old, new = (np.empty((m, tall, wide), np.float32) for _ in range(4))
            none = np.zeros((tall, wide), np.float32)
            for i in range(n):
                np.matmul(np.ascontiguousarray(x[i, s : s + tall]), right, out=cost)
                np.sqrt(np.maximum(cost, none, out=cost), out=cost)
                if i:
                    low[0] = old[0]
                    np.minimum(old[1:], old[:-1], out=low[1:])
                else:
                    low.fill(np.inf)
                    low[0] = 0
                for j in range(m):
                    if not open_[i, j]:
                        new[j] = np.inf
                    elif j:
                        np.add(cost[j], np.minimum(low[j], new[j - 1], out=low[j]), out=new[j])
                    else:
                        np.add(cost[0], low[0], out=new[0])
                old, new = new, old
            out[s : s + tall, t : t + wide] = old[-1]
    return out * (size * (1 - (n + m + 4) * 2.0**-22))


def best_scores(left: list[np.ndarray], right: list[np.ndarray], near: np.ndarray, rest: np.ndarray, weight: float, whole: float, band: int | None = None, slack: float = 2e-6) -> tuple[np.ndarray, int]:
    """((rest + weight * closeness) / whole for pairs that may be the best of their left row, -inf for the others; how many pairs were warped in double precision).

    closeness is 1 / (1 + d), d the warping distance divided by both lengths.
    near: pairs that count at all; rest: what the other parts add to a score.
    Pairs within `slack` of the best are kept, so that ties can be told.
    """
    score, bound = np.full(near.shape, -np.inf), np.empty(near.shape)
    ln, rn = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    for n in np.unique(ln):
        for m in np.unique(rn):
            l, r = np.flatnonzero(ln == n), np.flatnonzero(rn == m)
            least = bounds(np.stack([left[i] for i in l]), np.stack([right[j] for j in r]), band).astype(float)
            bound[np.ix_(l, r) if least.size < bound.size else ...] = weight / (1 + least / (n + m))
    bound += rest
    bound /= whole
    bound[~(near & (bound > -np.inf))] = -np.inf
    best, count, take = np.full(len(left), -np.inf), 0, 1
    i = np.arange(len(left))
    j = bound.argmax(axis=1) if len(right) else i
    i, j = (x[bound[i, j] > -np.inf] if len(right) else x[:0] for x in (i, j))
    more = None  # pairs that wait, the most hopeful of each left row first
    while len(i):
        for n, m in {(ln[p], rn[q]) for p, q in zip(i, j, strict=True)}:
            of = np.flatnonzero((ln[i] == n) & (rn[j] == m))
            for s in range(0, len(of), 1 << 14):
                p, q = i[of[s : s + (1 << 14)]], j[of[s : s + (1 << 14)]]
                need = (best[p] - slack) * whole - rest[p, q]  # weight * closeness must reach this
                limit = np.where(need > 0, (weight / np.maximum(need, 1e-300) - 1) * (n + m), np.inf) * (1 + 1e-9)
                d = warped(np.stack([left[x] for x in p]), np.stack([right[x] for x in q]), limit, band) / (n + m)
                score[p, q] = np.where(np.isfinite(d), (rest[p, q] + weight / (1 + d)) / whole, -np.inf)
                np.maximum.at(best, p, score[p, q])
                count += len(p)
        bound[i, j] = -np.inf
        if more is None:
            more = np.nonzero((bound >= (best - slack)[:, None]) & (bound > -np.inf))
            more = tuple(x[np.lexsort((-bound[more], more[0]))] for x in more)
        else:
            more = tuple(x[(bound[more] >= best[more[0]] - slack) & (bound[more] > -np.inf)] for x in more)
        take *= 4
        first = np.arange(len(more[0])) - np.searchsorted(more[0], more[0]) < take
        i, j = more[0][first], more[1][first]
    return score, count
