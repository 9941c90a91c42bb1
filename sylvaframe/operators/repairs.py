"""Rounds of repairs of small boxes inside tasks: the flags of anomalies and their gains over arrays of one box."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvaframe.operators.graph import _followed
from sylvaframe.operators.groups import halves_up
from sylvaframe.operators.regions import EPS

#: The cost of an active link that no edge stands for.
DEAR = 100.0


def _medians(value: np.ndarray, group: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Median, and medians of the values at most and at least as large, of each of n groups."""
    order = np.lexsort((value, group))
    v, g = value[order], group[order]
    first, size = np.searchsorted(g, np.arange(n)), np.bincount(g, minlength=n)
    middle = lambda a, k: 0.5 * v[np.minimum(a + np.maximum(k - 1, 0) // 2, len(v) - 1)] + 0.5 * v[np.minimum(a + k // 2, len(v) - 1)]
    median = middle(first, size)
    low, high = np.bincount(g[v <= median[g]], minlength=n), np.bincount(g[v >= median[g]], minlength=n)
    return median, middle(first, low), middle(first + size - high, high)


def _deviations(value: np.ndarray, median: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return np.abs(value - median) / (1.4826 * np.where(value < median, median - low, high - median) + EPS)


def _cosine(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Cosine of two vectors; NaN if one has no length."""
    norm = np.sqrt(ax * ax + ay * ay) * np.sqrt(bx * bx + by * by)
    return np.clip((ax * bx + ay * by) / np.where(norm == 0, np.nan, norm), -1.0, 1.0)


def _spread(values: list[np.ndarray]) -> np.ndarray:
    """Sample deviation of columns of values in their order; NaN is none (see anomalies._running_deviation)."""
    n, mean, squares = (np.zeros(len(values[0])) for _ in range(3))
    for x in values:
        there = ~np.isnan(x)
        new = mean + (x - mean) / (n + 1)
        squares, mean, n = np.where(there, squares + (x - new) * (x - mean), squares), np.where(there, new, mean), n + there
    return np.where(n > 1, np.sqrt(squares / np.maximum(n - 1, 1)), np.nan)


class BoxForest:
    """A box's forest: nodes in the order of their ids, edges by nodes' places. Flags are arrays of kinds (0 node, 1 edge), a, b (-1 for nodes)."""

    def __init__(self, node: dict[str, np.ndarray], edge: dict[str, np.ndarray], typical: float):
        self.n, self.node, self.edge, self.typical = len(node["cc_id"]), node, edge, typical
        self.n_in = np.bincount(edge["dst"], minlength=self.n)
        self.cost = {(s, t): c for s, t, c in zip(edge["src"].tolist(), edge["dst"].tolist(), edge["cost"].tolist())}
        sides, self.beside = {}, {}
        for s, t, x, y in zip(*(edge[c].tolist() for c in ("src", "dst", "fx", "fy"))):
            sides[s, t] = sides[t, s] = (x, y)
            self.beside.setdefault(s, set()).add(t)
            self.beside.setdefault(t, set()).add(s)
        self.sides = sides
        span = node["h_tip"] - node["h_start"]
        self.rate = np.log(node["n_px"] / np.where(span == 0, typical, span + EPS) + EPS)
        self.rank = halves_up(self.rate)

    def flags(self, up: np.ndarray, fx: np.ndarray, fy: np.ndarray, listed: bool = False):
        """The number of flags of a forest (parents' places, connections), or with `listed` (a, b) of all and the place in them from which edges to laterals stand, and the pixels below."""
        n, cx, cy, n_px = self.n, self.node["cx"], self.node["cy"], self.node["n_px"]
        every = np.arange(n)
        px, paths = self.node["n_px"].copy(), [(some, to.copy()) for some, to in _followed(up.copy())]
        for some, to in paths:
            sent = px[some]
            np.add.at(px, to, sent)
        # Organs: the child of most pixels below goes on.
        child = np.flatnonzero(up >= 0)
        order = child[np.lexsort((child, -px[child], up[child]))]
        light = np.zeros(n, bool)
        light[order[np.flatnonzero(np.diff(up[order], prepend=-1) == 0)]] = True
        begins = light | (up < 0)
        start, idx, far = np.where(begins, every, -1), np.zeros(n, np.int64), (up >= 0).astype(np.int64)
        for some, to in paths:
            news = (start[some] < 0) & (start[to] >= 0)
            at, offer, more = some[news], (start[to[news]], far[some[news]] + idx[to[news]]), far[some] + far[to]
            start[at], idx[at] = offer
            far[some] = more
        row = np.lexsort((idx, start))
        same = start[row][1:] == start[row][:-1]
        nxt, prv = np.full(n, -1), np.full(n, -1)
        nxt[row[:-1][same]], prv[row[1:][same]] = row[1:][same], row[:-1][same]
        size = np.bincount(start, minlength=n)[start]
        pick = lambda v, at: np.where(at >= 0, v[at], np.nan)
        dist = lambda ax, ay, bx, by: np.sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay))
        nfx, nfy, into = pick(fx, nxt), pick(fy, nxt), idx > 0
        out = ~np.isnan(nfx)
        line = np.select([into & out, out, into], [dist(fx, fy, nfx, nfy), 2 * dist(cx, cy, nfx, nfy), 2 * dist(cx, cy, fx, fy)], np.sqrt(n_px))
        radius = np.where(line > 0, n_px / np.where(line > 0, line, 1.0), np.sqrt(n_px / np.pi))
        # The cheapest active link out of each node.
        links = np.array([self.cost.get(e, DEAR) for e in zip(up[child].tolist(), child.tolist())])
        links = np.where(np.isnan(links), DEAR, links)
        cheap = np.lexsort((child, links, up[child]))
        cheap = child[cheap[np.flatnonzero(np.diff(up[child][cheap], prepend=-1))]]
        best = np.full(n, -1)
        best[up[cheap]] = cheap

        found, none = [], lambda k: np.full(len(k), -1)
        node = lambda k: found.append((k, none(k)))
        edge = lambda a, b: found.append((a[(a >= 0) & (b >= 0)], b[(a >= 0) & (b >= 0)]))
        median, low, high = (m[start] for m in _medians(radius, start, n))
        odd = np.flatnonzero((size >= 3) & (_deviations(radius, median, low, high) > np.where(size > 7, 6.0, np.where(size > 5, 8.0, 100.0))))
        k = np.flatnonzero((size > 5) & (idx >= 2) & (idx < size - 1) & (self.n_in >= 2) & (best >= 0))
        a, b, c, d, e = radius[prv[prv[k]]], radius[prv[k]], radius[k], radius[nxt[k]], pick(radius, np.where(nxt[k] >= 0, nxt[nxt[k]], -1))
        after = np.where(np.isnan(e), (c + d) / 2, (c + d + np.nan_to_num(e)) / 3)
        sudden = k[np.abs(after - (a + b) / 2) > (_spread([a, b]) + _spread([c, d, e])) / 0.6745]
        for some in (odd, sudden):
            node(some)
            edge(up[some], some)
            edge(some, best[some])
        pcx, pcy, last = pick(cx, prv), pick(cy, prv), nxt < 0
        on = prv >= 0
        sharp = np.flatnonzero(on & ~last & (_cosine(cx - fx, cy - fy, nfx - cx, nfy - cy) < 0.5))
        edge(prv[sharp], sharp)
        edge(sharp, nxt[sharp])
        ends = np.flatnonzero(on & last & (_cosine(cx - pcx, cy - pcy, cx - fx, cy - fy) < 0.5))
        node(ends)
        edge(prv[ends], ends)
        turned = np.flatnonzero(on & (_cosine(fx - pcx, fy - pcy, cx - fx, cy - fy) < 0.5))
        edge(prv[turned], turned)
        tips = np.flatnonzero(last)
        if len(tips) > 3:
            end = self.node["h_tip"][tips]
            stats = _medians(end, np.zeros(len(tips), np.int64), 1)
            node(tips[_deviations(end, *stats) > 3])
        at = sum(len(f[0]) for f in found)
        first = np.flatnonzero((idx == 0) & (up >= 0))
        if len(first) >= 10:
            first = first[np.lexsort((first, self.rank[up[first]]))]
            m, rate = len(first), self.rate[first]
            near = np.maximum(0, np.minimum(np.arange(m) - 12, m - 25))[:, None] + np.arange(25)
            mine = (near < m) & (near != np.arange(m)[:, None])
            i, j = np.nonzero(mine)
            odd = _deviations(rate, *_medians(rate[near[i, j]], i, m)) > 2
            edge(up[first[odd]], first[odd])
        if not listed:
            return sum(len(f[0]) for f in found)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), at, px

    def rounds(self, most: int, reach: float = 3.0):
        """Followed proposals: round, src, dst, other (places), gain and the new connection."""
        up, fx, fy = (self.node[c].copy() for c in ("up", "fx", "fy"))
        cx, cy, tip = (self.node[c] for c in ("cx", "cy", "h_tip"))
        for k in range(1, most + 1):
            a, b, at, px = self.flags(up, fx, fy, listed=True)
            flagged, choices = set(a.tolist()) | set(b[b >= 0].tolist()), []
            for src, dst in zip(a[at:].tolist(), b[at:].tolist()):
                tx, ty = cx[dst] - fx[dst], cy[dst] - fy[dst]
                way = 2 * np.sqrt(tx * tx + ty * ty)
                for other in self.beside.get(src, ()):
                    if other == dst or other not in flagged or not tip[other] <= tip[dst]:
                        continue
                    ox, oy = cx[dst] - cx[other], cy[dst] - cy[other]
                    to = np.sqrt(ox * ox + oy * oy)
                    if not (to <= reach * way and tx * (cx[other] - fx[dst]) + ty * (cy[other] - fy[dst]) <= 0 and (tx * ox + ty * oy) / (way / 2 * to + EPS) >= np.sqrt(0.5)):
                        continue
                    above = other
                    while above >= 0 and above != dst:
                        above = up[above]
                    if above == dst:  # it would close a circle
                        continue
                    now, nx, ny = up.copy(), fx.copy(), fy.copy()
                    now[dst] = other
                    x, y = self.sides[src, other]
                    nx[dst], ny[dst] = (fx[dst] if np.isnan(x) else x), (fy[dst] if np.isnan(y) else y)
                    gain = len(a) - self.flags(now, nx, ny)
                    if gain > 0:
                        choices.append((-gain, -px[dst], dst, other, src, nx[dst], ny[dst]))
            if not choices:
                return
            gain, _, dst, other, src, x, y = min(choices)
            up[dst], fx[dst], fy[dst] = other, x, y
            yield k, src, dst, other, -gain, x, y


def repairs_inside(forest: DataFrame, times: DataFrame, edges: DataFrame, typical: float, most_rounds: int) -> DataFrame:
    """What greedy_repair follows in boxes whose parents and times are all there: box, round, src, dst, other, gain and the connection fx, fy."""
    ids, real = {"cc_id", "up", "src", "dst"}, ("n_px", "cx", "cy", "fx", "fy", "h_start", "h_tip", "cost")
    whole = lambda df, names: df.select("box", *((F.col(c).cast("long") if c in ids else F.col(c).cast("double")).alias(c) for c in names))
    nodes = whole(forest.withColumn("up", F.col("parent")).join(times.select("box", "cc_id", "h_start", "h_tip"), ["box", "cc_id"]), ("cc_id", "up", "n_px", "cx", "cy", "fx", "fy", "h_start", "h_tip"))
    rows = nodes.unionByName(whole(edges.join(forest.select("box").distinct(), "box", "left_semi"), ("src", "dst", "cost", "fx", "fy")), allowMissingColumns=True)
    box = forest.schema["box"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        isnode = table.column("cc_id").combine_chunks().is_valid()
        nodes, edges = table.filter(isnode), table.filter(pa.array(~isnode.to_numpy(zero_copy_only=False)))
        of = lambda some, c: some.column(c).fill_null(-1 if c in ids else np.nan).to_numpy()
        order = np.argsort(of(nodes, "cc_id"))
        name = of(nodes, "cc_id")[order]
        place = lambda v: np.where(v >= 0, np.minimum(np.searchsorted(name, v), len(name) - 1), -1)
        node = {c: of(nodes, c)[order].astype(float) for c in real[:7]} | {"cc_id": name, "up": place(of(nodes, "up")[order])}
        known = np.isin(of(edges, "src"), name) & np.isin(of(edges, "dst"), name)
        edge = {c: of(edges, c)[known].astype(float) for c in ("cost", "fx", "fy")} | {c: place(of(edges, c)[known]) for c in ("src", "dst")}
        with np.errstate(all="ignore"):
            done = list(BoxForest(node, edge, typical).rounds(most_rounds)) if len(name) else []
        columns = list(zip(*done)) or [()] * 7
        same = pa.array(np.zeros(len(done), np.int32))
        values = {"box": pa.DictionaryArray.from_arrays(same, table.column("box").slice(0, 1).combine_chunks()).dictionary_decode(), "round": pa.array(columns[0], pa.int32())}
        values |= {c: pa.array(name[np.array(v, np.int64)], pa.int64()) for c, v in zip(("src", "dst", "other"), columns[1:4])} | {"gain": pa.array(columns[4], pa.int64())}
        return pa.table(values | {c: pa.array([None if np.isnan(x) else float(x) for x in v], pa.float64()) for c, v in zip(("fx", "fy"), columns[5:])})

    return rows.groupBy("box").applyInArrow(run, f"box {box}, round int, src long, dst long, other long, gain long, fx double, fy double")
