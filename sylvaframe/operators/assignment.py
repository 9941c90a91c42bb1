"""Links over gaps by repeated assignment of chains' ends to chains' starts, a box in a task."""

from __future__ import annotations

import heapq
import math
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvaframe.operators.groups import halves_up

#: Fixed values of the hidden link's score: a link that can't be, and the criteria's even value.
PENALTY, EVEN = 2.0, 0.5
#: What is known of a chain's component, and how many components at each end count.
COMPONENT, DEEP = ("x", "y", "day", "hour"), 3


def most_gained(gains: dict[int, dict[int, int]]) -> dict[int, int]:
    """Columns with their rows, each row once, that together gain most (gains: column, row, gain over 0); a column may stay without a row.

    Columns come in one after the other, each along the alternating path that gains most, which leaves the best assignment of those that are in.
    """
    row_of, column_of = {}, {}
    for new in sorted(gains):
        before, best, via, asked = {new: 0}, {}, {}, deque([new])
        while asked:
            column = asked.popleft()
            for row, gain in gains[column].items():
                total = before[column] + gain
                if total > best.get(row, total - 1):
                    best[row], via[row] = total, column
                    owner = column_of.get(row)
                    if owner is not None and (owner not in before or total - gains[owner][row] > before[owner]):
                        before[owner] = total - gains[owner][row]
                        asked.append(owner)
        ends = [(total, row, None) for row, total in best.items() if row not in column_of]
        ends += [(total, row_of[column], column) for column, total in before.items() if column != new]
        if not ends or (last := max(ends, key=lambda e: (e[0], -e[1])))[0] <= 0:
            continue
        _, row, left = last
        if left is not None:
            del row_of[left]
        while True:
            column = via[row]
            old, row_of[column], column_of[row] = row_of.get(column), row, column
            if column == new:
                break
            row = old
    return row_of


def link_cost(before: list[tuple], after: list[tuple], steps: float | None, off: float | None, max_speed: float, typical_hours: float) -> float:
    """hidden_link_score of one pair: the last components of the way to the gap, nearest first, and the first ones after it."""
    a, a2, n_a, b, b2, n_b = before[0], before[-1], len(before), after[0], after[-1], len(after)
    if a[2] > b[2]:
        return PENALTY
    span = lambda p, q: math.sqrt((q[0] - p[0]) * (q[0] - p[0]) + (q[1] - p[1]) * (q[1] - p[1]))
    alike = lambda u, v: abs(u - v) / (u + v) if u + v else 1.0
    own = lambda p, q: q[3] - p[3] if q[3] > p[3] else typical_hours

    def turn(p: tuple, q: tuple, r: tuple, s: tuple) -> float | None:
        ax, ay, bx, by = q[0] - p[0], q[1] - p[1], s[0] - r[0], s[1] - r[1]
        n = math.sqrt(ax * ax + ay * ay) * math.sqrt(bx * bx + by * by)
        return (ax * bx + ay * by) / n if n else None

    far, wait, sides = span(a, b), b[3] - a[3], (n_a > 1) + (n_b > 1)
    beside = (a[3] - before[1][3] if n_a > 1 else 0.0) + (after[1][3] - b[3] if n_b > 1 else 0.0)
    gap = wait if wait else typical_hours if not sides or beside <= 0 else beside / sides
    speed, v_a, v_b = far / gap, span(a, a2) / own(a2, a), span(b, b2) / own(b, b2)
    days = 0.7 if b[2] == a[2] else b[2] - a[2]
    w_a, w_b, alone = 0.5 if n_a == 2 else 1.0, 0.5 if n_b == 2 else 1.0, n_a == 1 or n_b == 1
    across = 0.5 if alone else 1.0 if n_a == DEEP and n_b == DEEP else 0.75
    bent = lambda there, cosine: EVEN if not there or cosine is None else 2 * (1 - cosine)
    over = turn(a2, a, b, b2)
    criteria = (
        (bent(n_a > 1, turn(a2, a, a, b)), w_a),
        (bent(n_b > 1, turn(a, b, b, b2)), w_b),
        (alike(v_a, speed) if n_a > 1 else EVEN, w_a),
        (alike(v_b, speed) if n_b > 1 else EVEN, w_b),
        (1 - 0.5 * (b[1] - a[1]) / far if far else 1.0, 1.0),
        (1.0 if steps is None else abs(steps - days - 2.5) / 3 + (0.0 if days < 2 else 0.15 * (days - 1)), 1.0),
        (EVEN if alone else 1.0 if over is None else 1 - over, across),
        (EVEN if alone else alike(v_b, v_a), across),
        (1.0 if off is None else off, 1.0),
        (EVEN + (5 * (speed - max_speed) / max_speed if speed > max_speed else 0.0), 1.0),
    )
    return sum(value * w for value, w in criteria) / sum(w for _, w in criteria)


class _Box:
    """A box's chains and pairs (of, to); scores are whole numbers of their ninth place."""

    def __init__(self, pairs: dict[tuple, tuple], ends: dict[int, tuple[list, list]], none: int, max_speed: float, typical_hours: float):
        self.pairs, self.ends, self.none, self.limits = pairs, ends, none, (max_speed, typical_hours)
        self.rows, self.columns, self.row_of, self.queue = {}, {}, {}, []
        self.next, self.prev = {}, {}
        self.of, self.to = {}, {}
        for pair, (score, _, _) in pairs.items():
            self.of.setdefault(pair[0], []).append(pair[1])
            self.to.setdefault(pair[1], []).append(pair[0])
            self._put(*pair, score)
        self._assign(set(self.columns))

    def _put(self, of: int, to: int, score: int) -> None:
        if score < self.none:
            self.rows.setdefault(of, {})[to] = score
            self.columns.setdefault(to, {})[of] = score

    def _drop(self, of: int, to: int) -> None:
        self.rows.get(of, {}).pop(to, None)
        self.columns.get(to, {}).pop(of, None)

    def _assign(self, columns: set[int]) -> None:
        """The best assignment of the columns and of all that hang together with them."""
        found, todo = set(), [c for c in columns if self.columns.get(c)]
        while todo:
            column = todo.pop()
            if column not in found:
                found.add(column)
                todo += [c for row in self.columns[column] for c in self.rows[row] if c not in found]
        for column in columns | found:
            self.row_of.pop(column, None)
        got = most_gained({c: {row: self.none - score for row, score in sorted(self.columns[c].items())} for c in found})
        self.row_of |= got
        for column, row in got.items():
            heapq.heappush(self.queue, (self.columns[column][row], row, column))

    def _way(self, chain: int, side: int, onward: dict[int, int]) -> list[tuple]:
        way = list(self.ends[chain][side])
        while len(way) < DEEP and chain in onward:
            chain = onward[chain]
            way += self.ends[chain][side]
        return way[:DEEP]

    def _end(self, chain: int, onward: dict[int, int]) -> tuple[int, int]:
        """The last chain of a run, and the components up to it."""
        n = len(self.ends[chain][0])
        while chain in onward:
            chain = onward[chain]
            n += len(self.ends[chain][0])
        return chain, n

    def link(self, of: int, to: int) -> None:
        for column in self.rows.pop(of):
            self.columns[column].pop(of)
        for row in self.columns.pop(to):
            self.rows[row].pop(to)
        del self.row_of[to]
        self.next[of], self.prev[to] = to, of
        (tail, ahead), (head, behind) = self._end(to, self.next), self._end(of, self.prev)
        # A run's end can't be linked to its own start; who has a new component among the next three is scored again.
        changed = {head} if self.row_of.get(head) == tail else set()
        self.pairs.pop((tail, head), None)
        self._drop(tail, head)
        again = [(tail, c) for c in self.of.get(tail, ()) if ahead < DEEP] + [(r, head) for r in self.to.get(head, ()) if behind < DEEP]
        for row, column in again:
            if (row, column) in self.pairs and row not in self.next and column not in self.prev:
                changed |= {column} | set(self.rows.get(row, ()))
                _, steps, off = self.pairs[row, column]
                cost = link_cost(self._way(row, 1, self.prev), self._way(column, 0, self.next), steps, off, *self.limits)
                self._drop(row, column)
                self._put(row, column, int(round(float(halves_up(np.array([cost]))[0]) * 1e9)))
        if changed:
            self._assign(changed)

    def links(self, most: int):
        """Accepted links with their score, cheapest of the assigned pairs first."""
        while self.queue:
            score, of, to = heapq.heappop(self.queue)
            if self.row_of.get(to) != of or self.columns[to][of] != score:
                continue
            if score >= most:
                return
            yield of, to, score
            self.link(of, to)


def assigned_links(scored: DataFrame, most: float, ends: DataFrame, max_speed: float, typical_hours: float) -> DataFrame:
    """reconnect_broken_branches by repeated assignment: box, of, to, score and round (the link's number in its box)."""
    pairs = scored.select("box", F.col("of").cast("long").alias("of"), F.col("to").cast("long").alias("to"), F.round("score", 9).alias("score"), F.col("steps").cast("double").alias("steps"), F.col("off").cast("double").alias("off"))
    place = lambda names: F.array(*(F.col(f"{p}.{c}").cast("double") for p in names for c in COMPONENT))
    chains = ends.select("box", F.col("start").cast("long").alias("of"), "n", place(("first", "second", "third")).alias("heads"), place(("last", "before", "before2")).alias("tails"))
    rows = pairs.unionByName(chains.join(pairs.select("box").distinct(), "box", "left_semi"), allowMissingColumns=True)
    box = scored.schema["box"].dataType.simpleString()
    nines = lambda x: int(round(x * 1e9))

    def run(table: pa.Table) -> pa.Table:
        known, given = {}, {}
        for r in table.drop(["box"]).to_pylist():
            if r["to"] is None:
                known[r["of"]] = tuple([tuple(r[c][k : k + len(COMPONENT)]) for k in range(0, r["n"] * len(COMPONENT), len(COMPONENT))] for c in ("heads", "tails"))
            else:
                given[r["of"], r["to"]] = (nines(r["score"]), r["steps"], r["off"])
        given = dict(sorted(given.items()))
        found = list(_Box(given, known, nines(max(PENALTY, most)), max_speed, typical_hours).links(nines(most)))
        of, to, score = (np.array(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        same = pa.array(np.zeros(len(of), np.int32))
        name = pa.DictionaryArray.from_arrays(same, table.column("box").slice(0, 1).combine_chunks()).dictionary_decode()
        return pa.table({"box": name, "of": pa.array(of, pa.int64()), "to": pa.array(to, pa.int64()), "score": pa.array(score / 1e9, pa.float64()), "round": pa.array(np.arange(1, len(of) + 1, dtype=np.int32))})

    return rows.groupBy("box").applyInArrow(run, f"box {box}, of long, to long, score double, round int")
