"""Lines of several parts joined to one, by list ranking.

The ends of parts that lie at one place are partners. A line is one path or one ring of parts, so every end has at
most one partner; following partners from part to part gives a linked list, whose ranks pointer jumping finds in
as many rounds as the logarithm of its length. All lines of a batch are joined at once in NumPy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .records import spread


def _close(values: np.ndarray, size: float) -> np.ndarray:
    """Cell numbers that keep neighbours up to two cells apart and shorten all wider gaps."""
    cell = np.floor(values / size)
    distinct, at = np.unique(cell, return_inverse=True)
    steps = np.minimum(np.diff(distinct), 3.0).astype(np.int64)
    return np.append(0, np.cumsum(steps))[at]


def _near(rec: np.ndarray, x: np.ndarray, y: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j: ends of one record within the tolerance; records with three ends or more in a cell, whose pairs are left out).

    The diagonal of a cell is the tolerance, so ends in one cell are always near.
    """
    none = np.zeros(0, dtype=np.int64)
    if not len(rec):
        return none, none, none
    if tolerance > 0:
        cx, cy = _close(x, tolerance / 2**0.5), _close(y, tolerance / 2**0.5)
    else:
        cx, cy = (np.unique(v, return_inverse=True)[1] * 3 for v in (x, y))
    wide = int(max(cx.max(), cy.max())) + 5
    key = (rec * wide + cx + 2) * wide + cy + 2
    order = np.argsort(key, kind="stable")
    cells, first, count = np.unique(key[order], return_index=True, return_counts=True)
    crowded = np.unique(rec[order[first[count > 2]]])
    a = order[first]
    b = np.where(count > 1, order[np.minimum(first + 1, len(order) - 1)], -1)
    two = count == 2
    left, right = [a[two]], [b[two]]
    if tolerance > 0:
        for dx in range(3):
            for dy in range(-2 if dx else 1, 3):
                to = np.minimum(np.searchsorted(cells, cells + dx * wide + dy), len(cells) - 1)
                met = np.flatnonzero(cells[to] == cells + dx * wide + dy)
                for u in (a[met], b[met]):
                    for v in (a[to[met]], b[to[met]]):
                        both = (u >= 0) & (v >= 0)
                        near = both & ((x[u] - x[v]) ** 2 + (y[u] - y[v]) ** 2 <= tolerance**2)
                        left.append(u[near])
                        right.append(v[near])
    return np.concatenate(left), np.concatenate(right), crowded


def _chained(rec: np.ndarray, n_records: int, ex: np.ndarray, ey: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(record, end by which a part is entered, place of the part in its line) of all records that are one line.

    rec is the record of each part, ascending; part p has the ends 2 p and 2 p + 1.
    """
    n = 2 * len(rec)
    of = np.repeat(rec, 2)
    i, j, bad = _near(of, ex, ey, tolerance)
    degree = np.bincount(np.concatenate([i, j]), minlength=n)
    good = np.ones(n_records, dtype=bool)
    good[bad] = False
    good[of[degree > 1]] = False
    partner = np.full(n, -1, dtype=np.int64)
    partner[i], partner[j] = j, i
    parts = np.bincount(rec, minlength=n_records)
    tips = np.bincount(of[partner < 0], minlength=n_records)
    good &= (parts > 0) & ((tips == 2) | (tips == 0))
    # a ring is cut before its first part
    first = 2 * (np.cumsum(parts) - parts)
    ring = first[good & (tips == 0)]
    partner[partner[ring]] = -1
    partner[ring] = -1
    start = np.full(n_records, n, dtype=np.int64)
    np.minimum.at(start, of[partner < 0], np.flatnonzero(partner < 0))
    # from the end by which a part is entered to that of the next part
    follow = partner[np.arange(n) ^ 1]
    ahead = (follow >= 0).astype(np.int64)
    to = np.where(follow >= 0, follow, np.arange(n))
    for _ in range(int(parts.max(initial=1)).bit_length()):
        ahead, to = ahead + ahead[to], to[to]
    s = np.minimum(start, max(n - 1, 0))
    if n:
        good &= (start < n) & (follow[to[s]] < 0) & (ahead[s] + 1 == parts)
    on = np.flatnonzero(good[of] & (to == to[s[of]]))
    return of[on], on, ahead[s[of[on]]] - ahead[on]


def joined(column: pa.Array, tolerance: float) -> pa.Array:
    """The line of each list of parts, or null where the parts are no single line.

    Ends must be equal, or, where that gives no line, within the tolerance. A line starts at its free end that comes
    first among the parts, a ring with its first part; of the points at which two parts meet the first part's is kept.
    """
    counts = np.asarray(pc.fill_null(pc.list_value_length(column), 0), dtype=np.int64)
    inner = column.flatten()
    size = np.asarray(pc.fill_null(pc.list_value_length(inner), 0), dtype=np.int64)
    points = inner.flatten()
    x, y = (np.asarray(points.field(c), dtype=np.float64) for c in ("x", "y"))
    rec, begin = np.repeat(np.arange(len(counts)), counts), np.cumsum(size) - size
    rec, begin, size = rec[size > 0], begin[size > 0], size[size > 0]
    parts = np.bincount(rec, minlength=len(counts))
    alone = parts[rec] == 1
    found = [(rec[alone], np.flatnonzero(alone) * 2, np.zeros(int(alone.sum()), dtype=np.int64))]
    left = parts > 1
    for t in (0.0, tolerance) if tolerance > 0 else (0.0,):
        part = np.flatnonzero(left[rec])
        ends = np.stack([begin[part], begin[part] + size[part] - 1], axis=1).reshape(-1)
        r, e, place = _chained(rec[part], len(counts), x[ends], y[ends], t)
        found.append((r, 2 * part[e >> 1] + (e & 1), place))
        left[r] = False
    r, e, place = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((place, r))
    r, e, place = r[order], e[order], place[order]
    part, back, skip = e >> 1, (e & 1).astype(np.int64), (place > 0).astype(np.int64)
    n = size[part] - skip
    from_first = np.where(back == 1, begin[part] + size[part] - 1 - skip, begin[part] + skip)
    steps = spread(np.zeros(len(n), dtype=np.int64), n)
    at = np.repeat(from_first, n) + np.repeat(1 - 2 * back, n) * steps
    lengths = np.bincount(r, weights=n, minlength=len(counts)).astype(np.int64)
    whole = np.bincount(r, minlength=len(counts)) > 0
    offsets = np.append(0, np.cumsum(lengths)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(~whole, False)), points.take(pa.array(at)))
