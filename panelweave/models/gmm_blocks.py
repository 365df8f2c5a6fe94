"""GMM moments with one instrument per period and lag, kept as what they are: mostly zeros.

At a period only its own instruments are other than zero, so a row carries the few lags it has and its period
says which instruments they are. Products are dense blocks per period: the first-step weight has a block for each
period and its successor, ``Z'X`` one block row per period. Scores of entities, whose rows have different
periods, are laid side by side from one list per entity, which the unique key bounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.panel import Panel
from ..session import ship_package

#: Bytes of a matrix of entity scores that a task fills before it multiplies it.
SCORES = 64 << 20
#: Rows of a large square matrix that are added up together.
BAND = 64


@dataclass
class Layout:
    """Which instruments and regressors each period has.

    Instruments in order: (period, lag) of the outcome, one per period for levels, ordinary ones,
    period dummies. Regressors: ``base`` columns, then period dummies.
    """

    times: list[int]
    lags: tuple[int, int]
    system: bool
    ordinary: int
    base: int
    dummies: list[int]

    def __post_init__(self) -> None:
        first = self.times[0]
        a, b = self.lags
        self.count = {p: max(0, min(b, p - first) - a + 1) for p in self.times}
        self.start, at = {}, 0
        for p in self.times:
            self.start[p] = at
            at += self.count[p]
        self.level = {}
        if self.system:
            for p in self.times:
                if p >= first + a:
                    self.level[p] = at
                    at += 1
        self.ordinary_at = at
        self.dummy = {p: i for i, p in enumerate(self.dummies)}
        self.size = at + self.ordinary + len(self.dummies)
        self.terms = self.base + len(self.dummies)

    def _dummies(self, p: int, differenced: bool) -> list[tuple[int, float]]:
        """Dummies other than zero at a period, with their values; differences of levels also have the period before."""
        out = [(self.dummy[p], 1.0)] if p in self.dummy else []
        if differenced and self.system and p - 1 in self.dummy:
            out.append((self.dummy[p - 1], -1.0))
        return out

    def instruments(self, p: int, lags: np.ndarray, ordinary: np.ndarray, differenced: bool) -> tuple[np.ndarray, np.ndarray]:
        """Places and values (row by place) of the instruments of rows of one period; ``lags`` holds the level instrument for levels."""
        n = len(ordinary)
        if differenced:
            at, values = np.arange(self.start[p], self.start[p] + self.count[p]), lags[:, : self.count[p]]
        else:
            at = np.array([self.level[p]] if p in self.level else [], int)
            values = lags[:, : len(at)]
        extra = self._dummies(p, differenced)
        rest = self.ordinary_at + self.ordinary
        at = np.concatenate([at, self.ordinary_at + np.arange(self.ordinary), np.array([rest + i for i, _ in extra], int)]).astype(int)
        return at, np.hstack([values, ordinary, np.tile([v for _, v in extra], (n, 1)).reshape(n, len(extra))])

    def places(self, p: int, differenced: bool) -> np.ndarray:
        """Instruments of an equation at a period."""
        width = self.lags[1] - self.lags[0] + 1 if differenced else 1
        return self.instruments(p, np.zeros((0, width)), np.zeros((0, self.ordinary)), differenced)[0]

    def places_with_next(self, p: int, full: bool) -> np.ndarray:
        """Instruments that a row of a period, less those of the next one, can have."""
        own = [self.places(q, True) for q in (p, p + 1) if q in self.start]
        if self.system and full and p in self.start:
            own.append(self.places(p, False))
        return np.unique(np.concatenate(own))

    def regressors(self, p: int, columns: np.ndarray, differenced: bool) -> np.ndarray:
        """Outcome and all regressors of rows of one period."""
        out = np.zeros((len(columns), 1 + self.terms))
        out[:, : 1 + self.base] = columns
        for i, v in self._dummies(p, differenced):
            out[:, 1 + self.base + i] = v
        return out


def _values(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have a list, and the lists of those rows as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    return np.flatnonzero(valid), column.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(int(valid.sum()), width)


class Pieces:
    """Rows of a batch by equation and period: instruments and regressors as dense matrices."""

    def __init__(self, layout: Layout, columns: dict[str, pa.Array], t: np.ndarray):
        self.layout, self.t = layout, t
        width = {"d": layout.lags[1] - layout.lags[0] + 1, "l": 1}
        self.own: dict[str, tuple[np.ndarray, ...]] = {}
        for e in ("d", "l") if layout.system else ("d",):
            rows, z = _values(columns[f"z{e}"], width[e])
            self.own[e] = rows, z, _values(columns[f"o{e}"], layout.ordinary)[1], _values(columns[f"x{e}"], 1 + layout.base)[1]

    def by_period(self, e: str) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Period, rows, places of the instruments, their values, outcome and regressors."""
        rows, z, o, x = self.own[e]
        t = self.t[rows]
        for p in np.unique(t).tolist():
            at = np.flatnonzero(t == p)
            places, values = self.layout.instruments(p, z[at], o[at], e == "d")
            yield p, rows[at], places, values, self.layout.regressors(p, x[at], e == "d")


def summed(df: DataFrame, run: Callable, key: str = "kind int, at int") -> dict[tuple[int, int], np.ndarray]:
    """Arrays that tasks emit under (kind, at), added up per key in tasks and read back."""
    made = df.mapInArrow(run, f"{key}, data binary")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for kind, at, data in zip(b.column("kind").to_pylist(), b.column("at").to_pylist(), b.column("data")):
                own = np.frombuffer(data.as_buffer())
                total[kind, at] = total[kind, at] + own if (kind, at) in total else own
        yield emitted(total)

    out: dict[tuple[int, int], np.ndarray] = {}
    for r in made.repartition("kind", "at").mapInArrow(add, f"{key}, data binary").collect():
        out[r["kind"], r["at"]] = np.frombuffer(r["data"])
    return out


def emitted(total: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([k for k, _ in total], pa.int32()), pa.array([a for _, a in total], pa.int32()), pa.array([np.ascontiguousarray(v, float).tobytes() for v in total.values()], pa.binary())],
        ["kind", "at", "data"],
    )


def _add(total: dict, kind: int, at: int, value: np.ndarray) -> None:
    total[kind, at] = total[kind, at] + value if (kind, at) in total else value


class BlockSystem:
    """Rows with columns t, zd, od, xd (and zl, ol, xl), next_zd, next_od; see ``Layout``."""

    def __init__(self, rows: DataFrame, panel: Panel, layout: Layout):
        self.rows, self.panel, self.layout = rows, panel, layout
        ship_package(rows.sparkSession)

    def first_stage(self, full: bool) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
        """Z'X, Z'y, rows of equations, and the first weight; one pass by period."""
        layout, time = self.layout, self.panel.time
        equations = ("d", "l") if layout.system else ("d",)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[tuple[int, int], np.ndarray] = {}
            for b in batches:
                if not b.num_rows:
                    continue
                t = b.column(time).to_numpy(zero_copy_only=False)
                pieces = Pieces(layout, {c: b.column(c) for e in equations for c in (f"z{e}", f"o{e}", f"x{e}")}, t)
                q: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
                for e in equations:
                    for p, rows, places, z, x in pieces.by_period(e):
                        _add(total, 0 if e == "d" else 1, p, z.T @ x)
                        _add(total, 2, 0, np.array([float(len(rows))]))
                        if e == "d" or full:
                            q.setdefault(p, []).append((rows, places, z))
                        else:
                            _add(total, 4, p, z.T @ z)
                # The row before a differenced equation takes its instruments off its own.
                rows, z = _values(b.column("next_zd"), layout.lags[1] - layout.lags[0] + 1)
                _, o = _values(b.column("next_od"), layout.ordinary)
                after = t[rows] + 1
                for p in np.unique(after).tolist():
                    at = np.flatnonzero(after == p)
                    places, values = layout.instruments(p, z[at], o[at], True)
                    q.setdefault(p - 1, []).append((rows[at], places, -values))
                for p, parts in q.items():
                    places = np.unique(np.concatenate([x[1] for x in parts]))
                    present = np.unique(np.concatenate([x[0] for x in parts]))
                    dense = np.zeros((len(present), len(places)))
                    for own, at, values in parts:
                        dense[np.ix_(np.searchsorted(present, own), np.searchsorted(places, at))] += values
                    # Which parts a period has can differ between batches, so the block spans all it may have.
                    whole = layout.places_with_next(p, full)
                    block = np.zeros((len(whole), len(whole)))
                    inside = np.searchsorted(whole, places)
                    block[np.ix_(inside, inside)] = dense.T @ dense
                    _add(total, 3, p, block)
            yield emitted(total)

        got = summed(self.rows, run)
        n = layout.size
        cross, weight = np.zeros((n, 1 + layout.terms)), np.zeros((n, n))
        for (kind, p), data in got.items():
            if kind < 2:
                at = layout.places(p, kind == 0)
                cross[at] += data.reshape(len(at), -1)
            elif kind == 3:
                at = layout.places_with_next(p, full)
                weight[np.ix_(at, at)] += data.reshape(len(at), -1)
            elif kind == 4:
                at = layout.places(p, False)
                weight[np.ix_(at, at)] += data.reshape(len(at), -1)
        return cross[:, 1:], cross[:, 0], int(got.get((2, 0), np.zeros(1))[0]), weight

    def _entities(self) -> DataFrame:
        fields = [self.panel.time, "zd", "od", "xd", *(("zl", "ol", "xl") if self.layout.system else ())]
        return self.rows.groupBy(*self.panel.entity).agg(F.collect_list(F.struct(*fields)).alias("rows")).select("rows")

    def _scored(self, beta: np.ndarray, use: Callable) -> dict[tuple[int, int], np.ndarray]:
        """``use(total, pieces, entity, n, scores)`` per block of entities; ``scores`` are their Z'u, one row each."""
        layout, time = self.layout, self.panel.time
        most = max(1, SCORES // (8 * layout.size))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[tuple[int, int], np.ndarray] = {}
            for whole in batches:
                for start in range(0, whole.num_rows, most):
                    lists = whole.column("rows").slice(start, most)
                    flat = lists.flatten()
                    columns = dict(zip([f.name for f in flat.type], flat.flatten()))
                    entity = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                    pieces = Pieces(layout, columns, columns[time].to_numpy(zero_copy_only=False))
                    scores, present = np.zeros((len(lists), layout.size)), np.zeros(len(lists), bool)
                    for e in pieces.own:
                        for _, rows, places, z, x in pieces.by_period(e):
                            u = x[:, 0] - x[:, 1:] @ beta
                            scores[np.ix_(entity[rows], places)] += z * u[:, None]
                            present[entity[rows]] = True
                            _add(total, 1, 0 if e == "d" else 1, np.array([float(u @ u)]))
                    _add(total, 2, 0, np.array([float(present.sum())]))
                    use(total, pieces, entity, len(lists), scores)
            yield emitted(total)

        return summed(self._entities(), run)

    def score_gram(self, beta: np.ndarray) -> tuple[np.ndarray, int, list[float]]:
        """Sum over entities of their scores' products, the number of entities, squared residuals by equation."""
        n = self.layout.size

        def use(total, pieces, entity, count, scores) -> None:
            for at in range(0, n, BAND):
                _add(total, 0, at, scores[:, at : at + BAND].T @ scores)

        got = self._scored(beta, use)
        omega = np.vstack([got[0, at].reshape(-1, n) for at in range(0, n, BAND)]) if (0, 0) in got else np.zeros((n, n))
        one = lambda *key: float(got.get(key, np.zeros(1))[0])
        return omega, int(one(2, 0)), [one(1, 0), one(1, 1)]

    def slopes_times(self, beta: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Per regressor, the derivative of the scores' products times ``v``, up to its sign."""
        layout = self.layout

        def use(total, pieces, entity, count, scores) -> None:
            sv = scores @ v
            for i in range(layout.terms):
                own = np.zeros((count, layout.size))
                for e in pieces.own:
                    for _, rows, places, z, x in pieces.by_period(e):
                        own[np.ix_(entity[rows], places)] += z * x[:, 1 + i][:, None]
                _add(total, 0, i, scores.T @ (own @ v) + own.T @ sv)

        got = self._scored(beta, use)
        return np.stack([got[0, i] for i in range(layout.terms)], axis=1)

    def serial(self, orders: Sequence[int], beta: np.ndarray) -> list[tuple[float, float, np.ndarray, np.ndarray]]:
        """Per order: sum and sum of squares of entities' residual products, lagged residuals times regressors, products with scores."""
        layout = self.layout

        def use(total, pieces, entity, count, scores) -> None:
            parts = list(pieces.by_period("d"))
            if not parts:
                return
            who = np.concatenate([entity[rows] for _, rows, *_ in parts])
            when = np.concatenate([np.full(len(rows), p) for p, rows, *_ in parts])
            x = np.vstack([part[4] for part in parts])
            e = x[:, 0] - x[:, 1:] @ beta
            key = who.astype(np.int64) << 32 | when.astype(np.int64) + (1 << 31)
            order = np.argsort(key)
            key, e, x, who = key[order], e[order], x[order], who[order]
            for o in orders:
                at = np.searchsorted(key, key - o)
                met = (at < len(key)) & (key[np.minimum(at, len(key) - 1)] == key - o)
                w = np.where(met, e[np.minimum(at, len(key) - 1)], 0.0)
                c = np.bincount(who, w * e, count)
                _add(total, 0, o, np.concatenate([[c.sum(), c @ c], w @ x[:, 1:], c @ scores]))

        got = self._scored(beta, use)
        out = []
        for o in orders:
            row = got.get((0, o), np.zeros(2 + layout.terms + layout.size))
            out.append((float(row[0]), float(row[1]), row[2 : 2 + layout.terms], row[2 + layout.terms :]))
        return out
