"""Exact k-nearest-neighbour join (J8) and SMOTE oversampling (M3).

Reference rows are cut into tiles. With few dimensions, a tree over a sample halves them along their widest sides, and a tile
is the box of a leaf's rows (in parts by hash where a leaf is still large: equal rows). With many, kNN prunes by distances to
pivots: every reference row goes to the cell of its nearest pivot, and a cell is cut into rings of the distance to the
pivot, and parts by hash where a ring is still large. A
tile knows its smallest and largest distance to the pivot, so by the triangle
inequality no row of it is nearer to a query than |d(query, pivot) - ring|, nor than
half of what the query is nearer to its own pivot. Every query is first scored
against its home, the tile of its leaf or of its smallest bound; its k-th distance there is what any other tile's
bound must not exceed, and only those tiles get the query. Tiles and blocks of queries meet as co-grouped NumPy tasks that keep
the k best (neighbouring small tiles in one task, with one copy of the query, which names no tiles where it needs most of them),
so rows are replicated, pairs are never emitted, and the per-query merge
keeps k of a list of k a task. The result is exact for any data; ``probes`` bounds the
tiles of a query instead, for an approximate join.

Inside a task the dot-product form finds candidates only, in single precision and in blocks that stay in a core's cache: both
sides are centred first, and every reference within the rounding error of the k-th
smallest value known so far is scored again by plain differences and ordered by (distance,
rid), so ties and far-off origins change nothing. With few dimensions, queries that lie together meet the small boxes of a tile
that are near them.

SMOTE draws every random choice from a hash of (synthetic id, seed), so a
retried task produces the same rows.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quorum.operators.folds import hash_rank
from quorum.session import spread, written

KNN_SCHEMA = "qid string, rid string, distance double"
BROADCAST_ROWS = 20_000  # largest minority class that SMOTE broadcasts
LEAF_ROWS = 64  # rows of a box within a tile
GROUP_ROWS = 128  # queries that are scored against the same boxes
NEAR_BOXES = 4  # boxes that give a group of queries its first k-th distances
BOX_DIMENSIONS = 16  # with more, one product over a whole tile is faster
TASK_ROWS = 60_000  # rows of each side that a task of small tiles holds at a time
BLOCK_ROWS = 1000  # queries that a part's rows are copied for at least
_PAIRS = 250_000  # pairs of a tile scored exactly at a time
_BLOCK = 1_000_000  # pairs of a tile that the dot products are held of at a time
_SCAN_QUERIES, _SCAN_ROWS = 512, 2048  # queries and references of a product that stays in a core's cache
_GROUP = 32  # references of which the nearest bounds a query's k-th distance
MAX_PIVOTS = 512
MAX_LEAVES = 8192  # of the tree of a reference set of few dimensions
SAMPLE_ROWS = 64  # sampled rows a leaf
MAX_TILES = 100_000  # a larger reference set gets larger tiles


def _direct(qv: np.ndarray, rv: np.ndarray, qids: np.ndarray, rids: np.ndarray, k: int, exclude_self: bool) -> tuple:
    """(query, reference, distance) of the k nearest of every query, by positions; references are in the order of their ids."""
    centre = rv.mean(axis=0)
    qc, rc = qv - centre, rv - centre
    qn, rn = (qc * qc).sum(axis=1), (rc * rc).sum(axis=1)
    slack = 4 * (qv.shape[1] + 4) * np.finfo(np.float64).eps
    # centring itself rounds by the size of the raw coordinates
    raw = np.sqrt(max((rv * rv).sum(axis=1).max(), (qv * qv).sum(axis=1).max())) * np.finfo(np.float64).eps
    step = max(1, int(_BLOCK // max(1, len(rids))))
    twice = -2.0 * rc.T
    # the references with a query's own id stand side by side
    first, end = (np.searchsorted(rids, qids, side=x) if exclude_self else np.zeros(len(qids), dtype=np.int64) for x in ("left", "right"))
    parts = []
    for s in range(0, len(qids), step):
        a = slice(s, s + step)
        d2 = qc[a] @ twice
        d2 += rn
        d2 += qn[a, None]
        own = end[a] - first[a]
        if own.any():
            owner = np.repeat(np.arange(len(own)), own)
            d2[owner, np.repeat(first[a] - (own.cumsum() - own), own) + np.arange(len(owner))] = np.inf
        kth = _kth_bound(d2, min(k, len(rids)))
        reach = np.sqrt(qn[a]) + np.sqrt(rn.max())
        error = slack * reach ** 2 + 8 * raw * reach
        near_q, near_r = np.nonzero(d2 <= np.where(np.isfinite(kth), kth + 2 * error, np.inf)[:, None])
        exact = np.empty(len(near_q))
        for t in range(0, len(near_q), _PAIRS):
            b = slice(t, t + _PAIRS)
            exact[b] = np.sqrt(((rv[near_r[b]] - qv[s + near_q[b]]) ** 2).sum(axis=1))
        if exclude_self:
            ok = qids[s + near_q] != rids[near_r]
            near_q, near_r, exact = near_q[ok], near_r[ok], exact[ok]
        parts.append(_nearest([(s + near_q, near_r, exact)], k))
    return tuple(np.concatenate([p[i] for p in parts]) for i in range(3))


def _kth_bound(d2: np.ndarray, k: int) -> np.ndarray:
    """At least the k-th smallest value of each row: that of the least values of groups of columns, which is one pass, where
    there are enough groups for few others to lie below it; NaN where there are fewer than k numbers."""
    groups = d2.shape[1] // _GROUP
    if groups >= 8 * k:
        d2 = d2[:, :groups * _GROUP].reshape(len(d2), _GROUP, groups).min(axis=1)
    return np.partition(d2, k - 1, axis=1)[:, k - 1]


def _nearest(found: list[tuple], k: int) -> tuple:
    """The k nearest of every query among (query, reference, distance) arrays; ties by the references' positions."""
    q, r, d = (np.concatenate([f[i] for f in found]) for i in range(3))
    order = np.lexsort((r, d, q))
    q, r, d = q[order], r[order], d[order]
    top = np.arange(len(q)) - np.searchsorted(q, q, side="left") < k
    return q[top], r[top], d[top]


def _own(qids: np.ndarray, rids: np.ndarray, exclude_self: bool) -> tuple[np.ndarray, np.ndarray]:
    """The references with each query's own id, from the first up to the second position; they stand side by side."""
    return tuple(np.searchsorted(rids, qids, side=x) if exclude_self else np.zeros(len(qids), dtype=np.int64) for x in ("left", "right"))


def _scan(qv: np.ndarray, rv: np.ndarray, first: np.ndarray, end: np.ndarray, place: np.ndarray, bound: np.ndarray, k: int,
          home: np.ndarray | None = None, tile: np.ndarray | None = None) -> tuple:
    """(query, place, distance) of the k nearest of every query within ``bound`` (others may be left out), ties by place.

    References whose place is in [first, end) of a query, or whose ``tile`` is its ``home``, aren't its neighbours. Blocks
    that fit a core's cache are multiplied in single precision; every value within its rounding error of the k-th distance
    known so far is scored again by plain differences. Vectors must be finite.
    """
    centre = rv.mean(axis=0)
    qc, rc = qv - centre, rv - centre
    qn, rn = (qc * qc).sum(axis=1), (rc * rc).sum(axis=1)
    reach = np.sqrt(qn) + np.sqrt(rn.max())
    # centring itself rounds by the size of the raw coordinates
    raw = np.sqrt(max((rv * rv).sum(axis=1).max(), (qv * qv).sum(axis=1).max())) * np.finfo(np.float64).eps
    error = 4 * (qv.shape[1] + 4) * float(np.finfo(np.float32).eps) * reach ** 2 + 8 * raw * reach
    size = reach.max() if reach.max() > 0 else 1.0  # products of numbers up to 1 neither overflow nor vanish
    left = np.concatenate([qc / size, np.ones((len(qv), 1))], axis=1).astype(np.float32)
    right = np.concatenate([rc.T * (-2.0 / size), rn[None] / size ** 2]).astype(np.float32)
    own = int((end - first).max(initial=0))
    cols = max(_SCAN_ROWS, 2 * k)
    out = []

    def reaches(to: np.ndarray) -> np.ndarray:
        """The products of the references within squared distances ``to`` are at most this."""
        return np.nextafter(((to - qn[a] + error[a]) / size ** 2).astype(np.float32), np.float32(np.inf))

    for s in range(0, len(qv), _SCAN_QUERIES):
        a = slice(s, s + _SCAN_QUERIES)
        with np.errstate(over="ignore"):
            limit = reaches(bound[a] ** 2 * (1 + 1e-12))
        found, refresh = [], 1
        for n, c in enumerate(range(0, len(rv), cols)):
            d2 = left[a] @ right[:, c:c + cols]
            if n == 0 and k + own <= d2.shape[1]:
                # of k and as many as are left out, the k-th neighbour is one at most
                kth = _kth_bound(d2, k + own).astype(np.float64) * size ** 2 + qn[a]
                limit = np.minimum(limit, reaches(kth + error[a]))
            near = np.flatnonzero(d2 <= limit[:, None])
            q, r = near // d2.shape[1], near % d2.shape[1] + c
            ok = (place[r] < first[s + q]) | (place[r] >= end[s + q])
            if tile is not None:
                ok &= tile[r] != home[s + q]
            q, r = q[ok], r[ok]
            exact = np.empty(len(q))
            for t in range(0, len(q), _PAIRS):
                b = slice(t, t + _PAIRS)
                exact[b] = np.sqrt(((rv[r[b]] - qv[s + q[b]]) ** 2).sum(axis=1))
            found.append((q, place[r], exact))
            if n + 1 >= refresh and c + cols < len(rv) or sum(len(f[0]) for f in found) > 2_000_000:
                refresh *= 2
                found = [_nearest(found, k)]
                q, _, d = found[0]
                full = np.flatnonzero(np.append(q[1:] != q[:-1], True) & (np.arange(len(q)) - np.searchsorted(q, q, side="left") == k - 1)) if len(q) else q
                kth = np.full(len(limit), np.inf)
                kth[q[full]] = d[full] ** 2 * (1 + 1e-12)
                limit = np.minimum(limit, reaches(kth))
        q, r, d = _nearest(found, k)
        out.append((s + q, r, d))
    return tuple(np.concatenate([p[i] for p in out]) for i in range(3))


def _leaves(rv: np.ndarray, rows: int = LEAF_ROWS) -> list[np.ndarray]:
    """Positions in boxes of at most ``rows``, by halving along the widest side; equal rows stay together."""
    out, open_ = [], [np.arange(len(rv))]
    while open_:
        part = open_.pop()
        if len(part) <= rows:
            out.append(part)
            continue
        v = rv[part]
        width = v.max(axis=0) - v.min(axis=0)
        side = int(width.argmax())
        if width[side] == 0:
            out.append(part)
            continue
        x = v[:, side]
        low = x < np.partition(x, len(x) // 2)[len(x) // 2]
        low = low if low.any() else x <= x.min()
        open_ += [part[low], part[~low]]
    return out


def _sides(v: np.ndarray, boxes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """[box, place]: smallest and largest coordinates of the rows of each box."""
    rows, starts = np.concatenate(boxes), np.cumsum([0, *(len(b) for b in boxes[:-1])])
    return np.minimum.reduceat(v[rows], starts, axis=0), np.maximum.reduceat(v[rows], starts, axis=0)


def _boxed(qv: np.ndarray, rv: np.ndarray, first: np.ndarray, end: np.ndarray, place: np.ndarray, bound: np.ndarray, k: int) -> tuple:
    """``_scan`` for few dimensions: queries that lie together are scored against the boxes of references near them.

    The nearest boxes of a group of queries give first k-th distances; only boxes within the largest of these are scored then.
    """
    if len(rv) <= 4 * LEAF_ROWS or qv.shape[1] > BOX_DIMENSIONS:
        return _scan(qv, rv, first, end, place, bound, k)
    boxes = _leaves(rv)
    for i, b in enumerate(boxes):
        if len(b) > LEAF_ROWS:  # equal rows: the first ones by id will do, beside those that a query leaves out
            b = b[np.argsort(place[b], kind="stable")]
            boxes[i] = b[:k + int((end - first).max(initial=0))]
    groups = _leaves(qv, GROUP_ROWS)
    low, high = _sides(rv, boxes)
    glow, ghigh = _sides(qv, groups)
    n_rows = np.array([len(b) for b in boxes])
    need = max(NEAR_BOXES * LEAF_ROWS // 2, k + int((end - first).max(initial=0)))
    slack = 64 * np.finfo(np.float64).eps * np.sqrt(qv.shape[1] + 1) * max(np.abs(qv).max(), np.abs(rv).max(), 1e-300)
    step = max(1, 1_000_000 // len(boxes))
    out = []
    for s in range(0, len(groups), step):
        gap, middle = np.zeros((2, min(step, len(groups) - s), len(boxes)))
        for j in range(qv.shape[1]):
            a, b = glow[s:s + step, j][:, None], ghigh[s:s + step, j][:, None]
            gap += np.maximum(np.maximum(low[None, :, j] - b, a - high[None, :, j]), 0.0) ** 2
            middle += (low[None, :, j] + high[None, :, j] - (a + b)) ** 2
        gap = np.sqrt(gap)
        for g in range(len(gap)):
            rows = groups[s + g]
            v, f, e, reach = qv[rows], first[rows], end[rows], bound[rows]
            done, found = np.zeros(len(boxes), dtype=bool), []

            def scored(which: np.ndarray) -> None:
                r = np.concatenate([boxes[b] for b in which])
                q, p, d = _scan(v, rv[r], f, e, place[r], reach, k)
                found.append((q, p, d))

            wanted = gap[g] <= reach.max() * (1 + 1e-12) + slack
            if n_rows[wanted].sum() > 2 * need:
                n = min(NEAR_BOXES, len(boxes) - 1)
                near = np.argpartition(middle[g], n)[:n]
                if n_rows[near].sum() < need:
                    order = middle[g].argsort()
                    near = order[:np.searchsorted(n_rows[order].cumsum(), need) + 1]
                scored(near)
                done[near] = True
                q, _, d = found[0]
                if len(q):
                    full = np.flatnonzero(np.append(q[1:] != q[:-1], True) & (np.arange(len(q)) - np.searchsorted(q, q, side="left") == k - 1))
                    reach = reach.copy()
                    reach[q[full]] = np.minimum(reach[q[full]], d[full])
                wanted = (gap[g] <= reach.max() * (1 + 1e-12) + slack) & ~done
            which = np.flatnonzero(wanted)
            if len(which):
                scored(which)
            if found:
                q, p, d = _nearest(found, k) if len(found) > 1 else found[0]
                out.append((rows[q], p, d))
    return _nearest(out, k) if out else _NONE


def _block_topk(qv: np.ndarray, rv: np.ndarray, qids: np.ndarray, rids: np.ndarray, bound: np.ndarray, k: int,
                exclude_self: bool) -> tuple:
    """``_direct`` for the references within ``bound`` of each query (others may be left out)."""
    if not (np.isfinite(qv).all() and np.isfinite(rv).all()):
        return _direct(qv, rv, qids, rids, k, exclude_self)
    return _boxed(qv, rv, *_own(qids, rids, exclude_self), np.arange(len(rv)), bound, k)


_NONE = (np.array([], dtype=np.int64), np.array([], dtype=np.int64), np.array([], dtype=float))


def _meet(qids: np.ndarray, qv: np.ndarray, bound: np.ndarray, owner: np.ndarray, asked: np.ndarray, rids: np.ndarray, rv: np.ndarray,
          tile: np.ndarray, k: int, exclude_self: bool) -> tuple:
    """(query, reference, distance) of the k nearest, by positions; references are in the order of their ids.

    Query ``owner[i]`` asks for tile ``asked[i]`` of the references; below 0 that is every tile but ``-1 - asked[i]``.
    """
    first, end = _own(qids, rids, exclude_self)
    finite_q, finite_r = np.isfinite(qv).all(axis=1), np.isfinite(rv).all(axis=1)
    found = []
    every = (asked < 0) & finite_q[owner] & finite_r.all()
    if every.any():
        mine = owner[every]
        q, r, d = _scan(qv[mine], rv, first[mine], end[mine], np.arange(len(rv)), bound[mine], k, -1 - asked[every], tile)
        found.append((mine[q], r, d))
        owner, asked = owner[~every], asked[~every]
    if (every := asked < 0).any():
        here = np.unique(tile)
        one = np.repeat(np.flatnonzero(every), len(here)), np.tile(here, every.sum())
        other = one[1] != -1 - asked[one[0]]
        owner, asked = np.concatenate([owner[~every], owner[one[0][other]]]), np.concatenate([asked[~every], one[1][other]])
    by_tile, by_asked = np.argsort(tile, kind="stable"), np.argsort(asked, kind="stable")
    tile, owner, asked = tile[by_tile], owner[by_asked], asked[by_asked]
    for t in np.unique(asked):
        rows = by_tile[np.searchsorted(tile, t):np.searchsorted(tile, t, side="right")]
        mine = owner[np.searchsorted(asked, t):np.searchsorted(asked, t, side="right")]
        fast = finite_q[mine] & finite_r[rows].all()
        if len(rows) and fast.any():
            at = mine[fast]
            q, r, d = _boxed(qv[at], rv[rows], first[at], end[at], rows, bound[at], k)
            found.append((at[q], r, d))
        if len(rows) and not fast.all():
            at = mine[~fast]
            q, r, d = _direct(qv[at], rv[rows], qids[at], rids[rows], k, exclude_self)
            found.append((at[q], rows[r], d))
        if sum(len(f[0]) for f in found) > 2_000_000:
            found = [_nearest(found, k)]
    return _nearest(found, k) if found else _NONE


def _tile_topk(k: int, exclude_self: bool):
    """Nearest of the queries (qid, qvec) among the references (rid, rvec) of a task. With ``tiles``, a query is scored
    against the references of these tiles only, and needs none beyond its distance ``kth``."""
    def run(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if q.empty or r.empty:
            return pd.DataFrame({"qid": np.array([], dtype=object), "rid": np.array([], dtype=object), "distance": np.array([], dtype=float)})
        qv = np.stack(q["qvec"].to_numpy()).astype(np.float64)
        rv = np.stack(r["rvec"].to_numpy()).astype(np.float64)
        qids = q["qid"].astype(str).to_numpy()
        by_id = np.argsort(r["rid"].astype(str).to_numpy(), kind="stable")  # positions follow the order of rids
        rids, rv = r["rid"].astype(str).to_numpy()[by_id], rv[by_id]
        bound = np.full(len(q), np.inf)
        if "tiles" in q:
            bound = np.where(np.isnan(kth := q["kth"].to_numpy(dtype=np.float64)), np.inf, kth)
            tile = r["tile"].to_numpy(dtype=np.int64)[by_id]
            owner, asked = np.repeat(np.arange(len(q)), q["tiles"].str.len()), np.concatenate(q["tiles"].to_numpy())
        else:
            tile, owner, asked = np.zeros(len(r), dtype=np.int64), np.arange(len(q)), np.zeros(len(q), dtype=np.int64)
        a, b, d = _meet(qids, qv, bound, owner, asked, rids, rv, tile, k, exclude_self)
        return pd.DataFrame({"qid": qids[a], "rid": rids[b], "distance": d})
    return run


def _column(data: pa.Table | pa.RecordBatch, name: str) -> pa.Array:
    c = data[name]
    return c if isinstance(c, pa.Array) else pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type)


def _matrix(column: pa.Array) -> np.ndarray:
    """[row, place]: a column of vectors as numbers of double precision; NULL numbers are NaN."""
    if not len(column):
        return np.empty((0, 0))
    lengths = pc.list_value_length(column)
    if column.null_count or pc.min(lengths) != pc.max(lengths):
        raise ValueError("all vectors must have the same shape")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), lengths[0].as_py())


def _packed_topk(k: int, exclude_self: bool, schema: pa.Schema, kept: list[str]):
    """As ``_tile_topk``, over Arrow tables, and a row for every query: its columns, the k-th distance and the list of the k nearest
    (distance, rid and the columns ``kept`` of the references), nearest first."""
    def run(q: pa.Table, r: pa.Table) -> pa.Table:
        a, b, d = _NONE
        names = pc.fill_null(_column(r, "rid"), "None")
        if len(q) and len(r):
            by_id = pc.sort_indices(names).to_numpy()
            kth = _column(q, "kth").to_numpy(zero_copy_only=False).astype(np.float64)
            tiles = _column(q, "tiles")
            a, b, d = _meet(pc.fill_null(_column(q, "qid"), "None").to_numpy(zero_copy_only=False), _matrix(_column(q, "qvec")),
                            np.where(np.isnan(kth), np.inf, kth), np.repeat(np.arange(len(q)), pc.list_value_length(tiles).to_numpy()),
                            tiles.flatten().to_numpy(), names.to_numpy(zero_copy_only=False)[by_id], _matrix(_column(r, "rvec"))[by_id],
                            _column(r, "tile").to_numpy()[by_id], k, exclude_self)
            b = by_id[b]
        ends = np.bincount(a, minlength=len(q)).cumsum()
        starts = np.concatenate([[0], ends[:-1]]) if len(q) else ends
        full = ends - starts >= k
        last = np.full(len(q), np.nan)
        last[full] = d[ends[full] - 1]
        take = pa.array(b)
        best = schema.field("best").type
        found = pa.StructArray.from_arrays([pa.array(d), names.take(take), *(_column(r, c).take(take) for c in kept)],
                                           fields=list(best.value_type))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([starts[:1] if len(q) else [0], ends]).astype(np.int32)), found, type=best)
        columns = {"qid": pc.fill_null(_column(q, "qid"), "None"), "kth": pa.array(last, mask=~full), "best": lists}
        return pa.table([columns[f.name] if f.name in columns else _column(q, f.name) for f in schema], schema=schema)
    return run


def pivot_distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """[row, pivot]: Euclidean distances as a matrix product of centred blocks; ``pivot_error`` bounds their rounding."""
    centre = pivots.mean(axis=0)
    x, p = vectors - centre, pivots - centre
    out = x @ p.T
    out *= -2.0
    out += (x * x).sum(axis=1)[:, None]
    out += (p * p).sum(axis=1)
    np.sqrt(np.maximum(out, 0.0, out=out), out=out)
    for i in np.flatnonzero(~np.isfinite(vectors).all(axis=1)):
        out[i] = np.sqrt(((vectors[i] - pivots) ** 2).sum(axis=1))
    return out


def pivot_error(reach: np.ndarray, raw: np.ndarray, dimensions: int) -> np.ndarray:
    """What ``pivot_distances`` may be wrong by, for a row and a pivot of at most the norms' sum ``reach`` (centred) and
    coordinates of at most ``raw``: the root of the product's error, and that of centring."""
    eps = np.finfo(np.float64).eps
    return np.sqrt(4 * (dimensions + 4) * eps) * reach + 8 * eps * np.sqrt(dimensions) * raw


class Tiles:
    """The tiles of a reference set: ``cell`` (pivot), smallest and largest distance to it (``low``, ``high``) and ``rows`` of each.

    At most ``MAX_PIVOTS`` pivots and about 2 x ``MAX_TILES`` tiles, so it may be sent to every task.
    """

    def __init__(self, pivots: np.ndarray, cell: np.ndarray, low: np.ndarray, high: np.ndarray, rows: np.ndarray):
        self.pivots, self.cell, self.low, self.high, self.rows = pivots, cell, low, high, rows
        size = max(np.abs(pivots).max(initial=0.0), high.max(initial=0.0), 1e-300)
        self.centre = pivots.mean(axis=0)
        self.norm = np.sqrt(((pivots - self.centre) ** 2).sum(axis=1)).max(initial=0.0)
        self.size = len(cell)
        # a row is wrong by this much at most; twice, for the choice of its cell
        self.slack = 64 * np.finfo(np.float64).eps * size * np.sqrt(pivots.shape[1] + 1) \
            + 2 * pivot_error(high.max(initial=0.0) + 2 * self.norm, size, pivots.shape[1])

    def bounds(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[query, tile]: no row of the tile is nearer than the first, none is farther than the second; rounding is allowed for."""
        to_pivot = pivot_distances(vectors, self.pivots)
        own = to_pivot.min(axis=1, keepdims=True)
        d = to_pivot[:, self.cell]
        raw = np.abs(vectors).max(axis=1, initial=0.0, keepdims=True)
        reach = np.sqrt(((vectors - self.centre) ** 2).sum(axis=1, keepdims=True)) + self.norm
        slack = self.slack + 64 * np.finfo(np.float64).eps * raw + 2 * pivot_error(reach, raw, vectors.shape[1])
        nearest = d - own
        nearest /= 2
        np.maximum(nearest, d - self.high, out=nearest)
        np.maximum(nearest, self.low - d, out=nearest)
        nearest -= slack
        d += self.high
        d += slack
        return np.maximum(nearest, 0.0, out=nearest), d

    def home(self, vectors: np.ndarray) -> np.ndarray:
        """The tile of each query's smallest bound; of equal ones, that of the nearest pivot."""
        low, high = self.bounds(vectors)
        best = low.min(axis=1, keepdims=True)
        return np.where(low <= best, high, np.inf).argmin(axis=1)

    def within(self, vectors: np.ndarray, kth: np.ndarray, k: int, home: np.ndarray, probes: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(query, tile) of every tile but the home that may hold one of the k nearest, given the k-th distance found at home."""
        low, high = self.bounds(vectors)
        if len(open_ := np.flatnonzero(np.isinf(kth))) and self.rows.sum() >= k:
            high = high[open_]
            # every tile holds a row, so k tiles do
            order = np.argpartition(high, k - 1, axis=1)[:, :k] if k < high.shape[1] else np.broadcast_to(np.arange(high.shape[1]), high.shape)
            order = np.take_along_axis(order, np.take_along_axis(high, order, axis=1).argsort(axis=1), axis=1)
            enough = (self.rows[order].cumsum(axis=1) >= k).argmax(axis=1)  # the tiles that hold k rows for sure
            kth = kth.copy()
            kth[open_] = high[np.arange(len(high)), order[np.arange(len(high)), enough]]
        wanted = low <= (kth + self.slack)[:, None]
        wanted[np.arange(len(home)), home] = False
        if probes is not None:
            rank = np.where(wanted, low, np.inf).argsort(axis=1).argsort(axis=1)
            wanted &= rank < probes - 1
        return np.nonzero(wanted)


class Boxes:
    """The tiles of a reference set of few dimensions: a tree that halves a sample along its widest side, and the box of the rows of each leaf.

    ``side`` and ``at`` are a node's split, ``below`` and ``above`` what follows, where leaf i is ~i. A leaf's rows are ``parts``
    tiles from ``first`` on. There are ``MAX_LEAVES`` leaves about, so it may be sent to every task.
    """

    def __init__(self, tree: list[tuple], low: np.ndarray, high: np.ndarray, parts: np.ndarray):
        self.side, self.at, self.below, self.above = (np.array([n[i] for n in tree]) for i in range(4))
        self.parts, self.first, self.size = parts, parts.cumsum() - parts, int(parts.sum())
        self.low, self.high = low, high
        self.node_low, self.node_high = np.empty((2, len(tree), low.shape[1]))
        for n in range(len(tree) - 1, -1, -1):  # children come after their node
            sides = [(low[~c], high[~c]) if c < 0 else (self.node_low[c], self.node_high[c]) for c in (self.below[n], self.above[n])]
            self.node_low[n], self.node_high[n] = np.minimum(sides[0][0], sides[1][0]), np.maximum(sides[0][1], sides[1][1])
        self.raw = max(np.abs(low).max(initial=0.0), np.abs(high).max(initial=0.0), 1e-300)

    @staticmethod
    def split(sample: np.ndarray, rows: int) -> tuple[list[tuple], int]:
        """The nodes of a tree whose leaves hold ``rows`` of the sample at most, or equal ones, and the number of leaves."""
        tree, n_leaves = [], 0
        open_ = [(np.arange(len(sample)), -1, 0)]
        while open_:
            part, parent, branch = open_.pop()
            v = sample[part]
            width = v.max(axis=0) - v.min(axis=0)
            side = int(width.argmax())
            if len(part) <= rows or width[side] == 0:
                node, n_leaves = ~n_leaves, n_leaves + 1
            else:
                x = v[:, side]
                at = np.partition(x, len(x) // 2)[len(x) // 2]
                at = at if (x < at).any() else x[x > at].min()
                node = len(tree)
                tree.append([side, at, 0, 0])
                open_ += [(part[x < at], node, 2), (part[x >= at], node, 3)]
            if parent >= 0:
                tree[parent][branch] = node
        return tree, n_leaves

    @staticmethod
    def leaves(tree: list[tuple], vectors: np.ndarray) -> np.ndarray:
        if not tree:
            return np.zeros(len(vectors), dtype=np.int64)
        side, at, below, above = (np.array([n[i] for n in tree]) for i in range(4))
        node, open_ = np.zeros(len(vectors), dtype=np.int64), np.arange(len(vectors))
        while len(open_):
            n = node[open_]
            node[open_] = np.where(vectors[open_, side[n]] < at[n], below[n], above[n])
            open_ = open_[node[open_] >= 0]
        return ~node

    def home(self, vectors: np.ndarray) -> np.ndarray:
        return self.first[Boxes.leaves(list(zip(self.side, self.at, self.below, self.above)), vectors)]

    def within(self, vectors: np.ndarray, kth: np.ndarray, k: int, home: np.ndarray, probes: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query, tile) of every tile but the home that may hold one of the k nearest, given the k-th distance found at home."""
        slack = 64 * np.finfo(np.float64).eps * np.sqrt(vectors.shape[1] + 1) * np.maximum(np.abs(vectors).max(axis=1, initial=0.0), self.raw)
        far = kth * (1 + 1e-12) + slack
        far = far * far * (1 + 1e-12)

        def reached(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            v = vectors[q]
            gap = np.maximum(np.maximum(low - v, v - high), 0.0)
            return (gap * gap).sum(axis=1) <= far[q]  # never for a vector with NaN

        q, node = np.arange(len(vectors)), np.full(len(vectors), 0 if len(self.side) else ~0, dtype=np.int64)
        found = []
        while len(q):
            leaf = node < 0
            i = ~node[leaf]
            ok = reached(q[leaf], self.low[i], self.high[i])
            found.append((q[leaf][ok], i[ok]))
            q, node = q[~leaf], node[~leaf]
            ok = reached(q, self.node_low[node], self.node_high[node])
            q, node = np.repeat(q[ok], 2), np.stack([self.below[node[ok]], self.above[node[ok]]], axis=1).ravel()
        q, leaf = (np.concatenate([f[i] for f in found]) if found else np.array([], dtype=np.int64) for i in range(2))
        times = self.parts[leaf]
        tile = np.repeat(self.first[leaf] - (times.cumsum() - times), times) + np.arange(times.sum())
        q = np.repeat(q, times)
        other = tile != home[q]
        order = np.lexsort((tile[other], q[other]))
        return q[other][order], tile[other][order]


def _with(df: DataFrame, more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), more])


def _counted(reference: DataFrame) -> tuple[int, bool]:
    """The number of rows, and whether all vectors have the same few dimensions and no infinite numbers."""
    size = F.size("rvec")
    infinite = F.when(size <= BOX_DIMENSIONS, F.exists("rvec", lambda x: F.abs(x) == float("inf")))
    r = reference.agg(F.count(F.lit(1)), F.min(size), F.max(size), F.count_if(F.col("rvec").isNull()), F.count_if(infinite)).first()
    return r[0], r[1] == r[2] and 0 < (r[1] or 0) <= BOX_DIMENSIONS and r[3] == r[4] == 0


def _boxes(reference: DataFrame, n_rows: int, tile_rows: int) -> tuple[DataFrame, Boxes]:
    """``_tiled`` for few dimensions. Rows with NaN or NULL numbers are near nothing and left out."""
    n_leaves = min(MAX_LEAVES, math.ceil(n_rows / tile_rows))
    usable = reference.filter(~F.exists("rvec", lambda x: x.isNull() | F.isnan(x)))
    want = SAMPLE_ROWS * n_leaves
    picked = usable.filter(F.pmod(F.xxhash64("rid", "rvec"), F.lit(n_rows)) < want).limit(2 * want).select("rvec").toArrow()
    sample = _matrix(_column(picked if len(picked) else usable.limit(want).select("rvec").toArrow(), "rvec"))
    if not len(sample):
        return usable.withColumn("tile", F.lit(0).cast("long")), Boxes([], np.full((1, 1), np.inf), np.full((1, 1), -np.inf), np.ones(1, dtype=np.int64))
    # the rows per leaf of the sample that stand for tile_rows of all rows
    tree, n_leaves = Boxes.split(sample, max(1, min(SAMPLE_ROWS, tile_rows * len(sample) // n_rows)))

    def assign(batches):
        for batch in batches:
            if len(batch):
                yield batch.append_column("leaf", pa.array(Boxes.leaves(tree, _matrix(_column(batch, "rvec")))))

    rows = written(spread(usable, "rid").mapInArrow(assign, _with(reference, "leaf long")), "knn-leaves")
    sides = [F.get("rvec", F.lit(j)).cast("double") for j in range(sample.shape[1])]
    held = rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.min(x) for x in sides]).alias("low"),
                                    F.array(*[F.max(x) for x in sides]).alias("high")).toArrow()  # one row a leaf
    leaf = _column(held, "leaf").to_numpy()
    low, high = np.full((2, n_leaves, sample.shape[1]), np.inf) * np.array([1, -1])[:, None, None]
    low[leaf], high[leaf] = _matrix(_column(held, "low")), _matrix(_column(held, "high"))
    parts = np.ones(n_leaves, dtype=np.int64)
    parts[leaf] = np.maximum(1, _column(held, "n").to_numpy() // (2 * max(tile_rows, math.ceil(n_rows / MAX_LEAVES))))  # a leaf of many equal rows, or one that the sample missed
    boxes = Boxes(tree, low, high, parts)
    if boxes.size == n_leaves:
        return rows.withColumnRenamed("leaf", "tile"), boxes
    small = reference.sparkSession.createDataFrame([(i, int(boxes.first[i]), int(parts[i])) for i in range(n_leaves)], "leaf long, first_tile long, parts long")
    return rows.join(F.broadcast(small), "leaf").withColumn("tile", F.expr("first_tile + pmod(xxhash64(rid, rvec), parts)")) \
        .drop("leaf", "first_tile", "parts"), boxes


def _tiled(reference: DataFrame, n_rows: int, tile_rows: int) -> tuple[DataFrame, Tiles]:
    """The reference rows (rid, rvec, and what else they hold) with their ``tile``, and the tiles."""
    tile_rows = max(tile_rows, math.ceil(n_rows / MAX_TILES))
    n_pivots = min(MAX_PIVOTS, max(8, 2 * math.ceil(n_rows / tile_rows)))
    picked = reference.orderBy(F.xxhash64("rid"), "rid").limit(n_pivots).collect()
    pivots = np.unique(np.array([r["rvec"] for r in picked], dtype=np.float64), axis=0)

    def assign(batches):
        for batch in batches:
            if len(batch):
                d = pivot_distances(_matrix(_column(batch, "rvec")), pivots)
                cell = d.argmin(axis=1)
                yield batch.append_column("cell", pa.array(cell.astype(np.int32))).append_column("d", pa.array(d[np.arange(len(d)), cell]))

    near = written(spread(reference, "rid").mapInArrow(assign, _with(reference, "cell int, d double")), "knn-cells")
    cells = near.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi")) \
        .withColumn("rings", F.ceil(F.col("n") / tile_rows))  # one row a pivot
    ring = F.expr("if(hi > lo, least(cast(floor((d - lo) / (hi - lo) * rings) as long), rings - 1), 0L)")
    ringed = near.join(F.broadcast(cells.select("cell", "lo", "hi", "rings")), "cell").select(*reference.columns, "cell", "d", ring.alias("ring"))
    rings = ringed.groupBy("cell", "ring").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("low"), F.max("d").alias("high")) \
        .withColumn("parts", F.ceil(F.col("n") / tile_rows)).orderBy("cell", "ring").toPandas()  # at most n_rows / tile_rows + n_pivots rows
    first = rings["parts"].cumsum() - rings["parts"]
    small = reference.sparkSession.createDataFrame(
        [(int(c), int(r), int(p), int(t)) for c, r, p, t in zip(rings["cell"], rings["ring"], rings["parts"], first)],
        "cell int, ring long, parts long, first_tile long")
    rows = ringed.join(F.broadcast(small), ["cell", "ring"]).select(
        *reference.columns, F.expr("first_tile + pmod(xxhash64(rid), parts)").alias("tile"))
    times = rings["parts"].to_numpy(dtype=np.int64)
    # the rows of a part are not counted: no bound relies on more than one row in each
    held = np.where(np.repeat(times, times) > 1, 1, np.repeat(rings["n"].to_numpy(dtype=np.int64), times))
    return rows, Tiles(pivots, np.repeat(rings["cell"].to_numpy(), times), np.repeat(rings["low"].to_numpy(), times),
                       np.repeat(rings["high"].to_numpy(), times), held)


def _per_part(tile_rows: int) -> int:
    """Neighbouring tiles that go to a task together, so that a query isn't copied for each of many small tiles."""
    return max(1, TASK_ROWS // tile_rows)


def _dealt(asked: DataFrame, rows: DataFrame, tile_rows: int):
    """Queries (qid, qvec, kth, part, tiles, and what else they hold) and the references of their parts, for tasks that
    hold a block of the queries of a part."""
    # queries of one part are dealt into blocks, for each of which the part's rows are copied; where there are fewer
    # parts than cores, into smaller ones, so that every core has some
    tasks = 4 * asked.sparkSession.sparkContext.defaultParallelism
    size = F.greatest(F.least(F.ceil(F.sum("n").over(Window.partitionBy()) / tasks), F.lit(max(tile_rows, TASK_ROWS))), F.lit(BLOCK_ROWS))
    blocks = asked.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.ceil(F.col("n") / size).alias("blocks"))
    blocks = blocks.filter("blocks > 1")
    q = asked.join(blocks, "part", "left").withColumn("block", F.expr("pmod(xxhash64(qid), coalesce(blocks, 1L))")).drop("blocks")
    r = rows.withColumn("part", F.expr(f"tile div {_per_part(tile_rows)}")).join(blocks, "part", "left") \
        .withColumn("block", F.explode(F.expr("sequence(0L, coalesce(blocks, 1L) - 1)"))).drop("blocks")
    return q.groupBy("part", "block").cogroup(r.groupBy("part", "block"))


def _score(asked: DataFrame, rows: DataFrame, k: int, exclude_self: bool, tile_rows: int) -> DataFrame:
    """The k best of every query (qid, qvec, kth, part, tiles) in the tiles of the part, as (qid, rid, distance)."""
    return _dealt(asked.select("qid", "qvec", "kth", "tiles", "part"), rows.select("rid", "rvec", "tile"), tile_rows) \
        .applyInPandas(_tile_topk(k, exclude_self), KNN_SCHEMA)


def _packed(asked: DataFrame, rows: DataFrame, k: int, exclude_self: bool, tile_rows: int, kept: list[str], columns: list[str]) -> DataFrame:
    """``columns`` of every query and its k ``best`` in the tiles of the part, as a list of (distance, rid, and ``kept``)."""
    types = {f.name: f.dataType.simpleString() for f in rows.schema} | {f.name: f.dataType.simpleString() for f in asked.schema}
    types["best"] = "array<struct<" + ",".join(["distance:double", "rid:string", *(f"`{c}`:{types[c]}" for c in kept)]) + ">>"
    schema = StructType.fromDDL(", ".join(f"{c} {types[c]}" for c in columns))
    return _dealt(asked, rows, tile_rows).applyInArrow(_packed_topk(k, exclude_self, to_arrow_schema(schema), kept), schema)


def _ask(queries: DataFrame, tiles: Tiles | Boxes, k: int, tile_rows: int, probes: int | None = None, others: bool = False,
         whole: bool = False) -> DataFrame:
    """(qid, qvec, kth, part, tiles): the home tile of every query, or, for queries with ``kth``, the others that may matter,
    a row for each part of neighbouring tiles. With ``whole``, ``tiles`` is -1 - home where a query asks for most tiles of a part,
    which stands for all of them but its home."""
    step = max(1, 250_000 // max(1, tiles.size)) if isinstance(tiles, Tiles) else sys.maxsize
    per_part = _per_part(tile_rows)
    known_home = "home" in queries.columns

    def run(batches):
        for batch in batches:
            vectors = _matrix(_column(batch, "qvec"))
            known = _column(batch, "kth").to_numpy(zero_copy_only=False).astype(np.float64)
            for at in range(0, len(batch), step):
                v = vectors[at:at + step]
                q, home = np.arange(len(v)), _column(batch, "home").to_numpy()[at:at + step] if known_home else tiles.home(v)
                tile = home
                if others:
                    kth = known[at:at + step]
                    q, tile = tiles.within(v, np.where(np.isnan(kth), np.inf, kth), k, home, probes)
                part = tile // per_part
                first = np.flatnonzero(np.append(True, (q[1:] != q[:-1]) | (part[1:] != part[:-1]))) if len(q) else q
                ends = np.append(first[1:], len(q)) if len(first) else first
                if whole and len(first):
                    held = np.minimum(per_part, tiles.size - part[first] * per_part)
                    most = (ends - first) * 4 > held
                    rows = np.repeat(most, ends - first)
                    drop = rows.copy()
                    drop[first] = False
                    tile = np.where(rows, -1 - home[q], tile)[~drop]
                    sizes = np.where(most, 1, ends - first)
                else:
                    sizes = ends - first
                ends = sizes.cumsum()
                for n in range(0, len(first), 20000):  # few rows at a time: each holds a copy of its query
                    f, e = first[n:n + 20000], ends[n:n + 20000]
                    start = e[0] - sizes[n]
                    rows = pa.array(at + q[f])
                    yield pa.RecordBatch.from_arrays([
                        _column(batch, "qid").take(rows), _column(batch, "qvec").take(rows), _column(batch, "kth").take(rows), pa.array(part[f].astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], e - start]).astype(np.int32)), pa.array(tile[start:e[-1]].astype(np.int64)))],
                        names=["qid", "qvec", "kth", "part", "tiles"])

    return queries.mapInArrow(run, f"qid string, qvec {queries.schema['qvec'].dataType.simpleString()}, kth double, part long, tiles array<long>")


def knn_join(queries: DataFrame, reference: DataFrame, k: int, id_col: str = "id", vec_col: str = "embedding",
             exclude_self: bool = False, tile_rows: int = 20000, probes: int | None = None,
             tile_pairs: list | None = None) -> DataFrame:
    """(qid, rid, distance, rank) for the k nearest reference rows of every query (Euclidean; ties by rid).

    Exact, unless ``probes`` says how many tiles a query may try; the tiles of smallest bounds come
    first, and the recall is the caller's to measure. A list given as
    ``tile_pairs`` gets (pairs of a query and a tile that were scored, pairs there are).
    """
    lists = knn_lists(queries, reference, k, id_col, vec_col, exclude_self, tile_rows, probes, tile_pairs)
    return lists.select("qid", F.posexplode("best").alias("rank", "b")).select(
        "qid", "b.rid", "b.distance", (F.col("rank") + 1).cast("long").alias("rank"))


def knn_lists(queries: DataFrame, reference: DataFrame, k: int, id_col: str = "id", vec_col: str = "embedding",
              exclude_self: bool = False, tile_rows: int = 20000, probes: int | None = None, tile_pairs: list | None = None,
              kept: Sequence[str] = ()) -> DataFrame:
    """``knn_join`` as one row for each qid that has neighbours: (qid, best), a list of (distance, rid, and the columns ``kept`` of the
    reference), nearest first."""
    q = queries.select(F.col(id_col).cast("string").alias("qid"), F.col(vec_col).alias("qvec"))
    r = reference.select(F.col(id_col).cast("string").alias("rid"), F.col(vec_col).alias("rvec"), *kept)
    n_rows, few = _counted(r)
    unknown = F.lit(None).cast("double").alias("kth")
    if n_rows <= tile_rows:
        alone = q.select("qid", "qvec", unknown, F.lit(0).cast("long").alias("part"), F.array(F.lit(0).cast("long")).alias("tiles"))
        return _merged(_packed(alone, r.withColumn("tile", F.lit(0).cast("long")), k, exclude_self, tile_rows, [*kept], ["qid", "best"]), k)
    rows, tiles = _tiled(r, n_rows, tile_rows) if probes is not None or not few else _boxes(r, n_rows, tile_rows)
    home = written(_ask(spread(q, "qid").select("*", unknown), tiles, k, tile_rows).withColumn("home", F.col("tiles")[0]), "knn-home")
    near = written(_packed(home, rows, k, exclude_self, tile_rows, [*kept], ["qid", "qvec", "kth", "home", "best"]), "knn-near")
    asked = written(_ask(near.select("qid", "qvec", "kth", "home"), tiles, k + exclude_self, tile_rows, probes, others=True,
                         whole=probes is None), "knn-asked")
    if tile_pairs is not None:
        n_queries, part = q.count(), _per_part(tile_rows)
        all_but_home = F.expr(f"least({part}, {tiles.size} - part * {part}) - if((-1 - tiles[0]) div {part} = part, 1, 0)")
        n_asked = F.when(F.col("tiles")[0] < 0, all_but_home).otherwise(F.size("tiles"))
        tile_pairs.append((n_queries + asked.agg(F.coalesce(F.sum(n_asked), F.lit(0))).first()[0], n_queries * tiles.size))
    more = _packed(asked, rows, k, exclude_self, tile_rows, [*kept], ["qid", "best"])
    return _merged(near.select("qid", "best").unionByName(more), k)


def _merged(lists: DataFrame, k: int) -> DataFrame:
    """(qid, best): the k nearest of each qid, by (distance, rid), out of its lists."""
    return lists.filter(F.size("best") > 0).groupBy("qid").agg(
        F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))


def smote(df: DataFrame, id_col: str, label_col: str, vec_col: str, ratio: float = 0.5, k: int = 5,
          seed: int = 42, minority: int = 1) -> DataFrame:
    """M3: synthetic minority rows x + lambda (neighbour - x), up to ``ratio`` x majority count.

    Returns only the synthetic rows (id, label, vector); union with the input
    to get the balanced training frame. Row n takes its base row, its neighbour and
    lambda from the first 52 bits of ``md5(n:seed:i)`` for i = 0, 1 and 2.
    """
    def draw(i: int) -> Column:
        key = F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(f"{seed}:{i}")))
        return F.conv(F.substring(key, 1, 13), 16, 10).cast("long")

    sizes = {r[0]: r[1] for r in df.groupBy(label_col).count().collect()}
    n_min, n_maj = sizes.get(minority, 0), sum(v for c, v in sizes.items() if c != minority)
    n_needed = int(ratio * n_maj) - n_min
    spark = df.sparkSession
    schema = f"{id_col} string, {label_col} int, {vec_col} array<double>"
    if n_needed <= 0 or n_min == 0:
        return spark.createDataFrame([], schema)
    mino = df.filter(F.col(label_col) == minority).select(
        F.col(id_col).cast("string").alias("mid"), F.col(vec_col).cast("array<double>").alias("x"))
    k_eff = min(k, n_min - 1) if n_min > 1 else 0
    indexed = hash_rank(mino, [], "mid", seed, rank_col="idx")
    # every minority row is drawn about n_needed / n_min times; a small minority is broadcast (its size is
    # counted above), so that those draws stay spread, and with a large one each key has few draws
    small = F.broadcast if n_min <= BROADCAST_ROWS else (lambda frame: frame)
    synth = spark.range(n_needed).select(
        F.col("id").alias("sid"),
        (draw(0) % n_min + 1).alias("idx"), (draw(1) % max(k_eff, 1) + 1).alias("nn_rank"),
        (draw(2) / F.lit(float(1 << 52))).alias("lam"))
    base = synth.join(small(indexed), "idx")
    if k_eff == 0:
        out = base.select("sid", F.col("x").alias("new"))
    else:
        nn = knn_join(mino, mino, k_eff, "mid", "x", exclude_self=True) \
            .select(F.col("qid").alias("mid"), F.col("rank").alias("nn_rank"), F.col("rid"))
        with_nn = base.join(small(nn), ["mid", "nn_rank"]).join(
            small(mino.select(F.col("mid").alias("rid"), F.col("x").alias("nx"))), "rid")
        out = with_nn.select("sid", F.zip_with("x", "nx", lambda a, b: a + F.col("lam") * (b - a)).alias("new"))
    return out.select(F.concat(F.lit("smote-"), F.col("sid").cast("string")).alias(id_col),
                      F.lit(minority).alias(label_col), F.col("new").alias(vec_col))


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the task functions above reach executors by value
