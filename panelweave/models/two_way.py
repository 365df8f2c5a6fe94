"""Period effects of panels with many periods, by conjugate gradients on the graph of entities and periods.

Net of entity means, the normal equations of period dummies are a graph Laplacian: periods are linked where an
entity has both. It is never formed. A product with it is one pass over the rows: look the vector up by period, take
each entity's mean off, add up by period. Only vectors with one number per period and column are
held outside. Rows meet by entity once, before the search: they are kept as places of periods, entity after entity, so
that a product moves no rows, only one sum per task, period and column.

The preconditioner adds two solves that cost nothing: the diagonal, good where entities span many periods, and a
chain of consecutive periods whose links carry what entities observe on both sides, good where each entity sees a
few periods of a long calendar. A chain is solved by two running sums.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..operators.panel import Panel
from ..session import materialise, ship_package

#: Remaining share of the residual at which the search ends, and products after which it gives up.
TOLERANCE, LIMIT = 1e-11, 500


@dataclass
class Chain:
    """The preconditioner: rows per period, and conductance between neighbouring periods."""

    size: np.ndarray
    link: np.ndarray

    def solve(self, r: np.ndarray) -> np.ndarray:
        flow = np.cumsum(r, axis=0)[:-1]
        open_ = self.link > 1e-9
        drop = np.where(open_[:, None], flow / np.where(open_, self.link, 1.0)[:, None], 0.0)
        level = np.vstack([np.zeros((1, r.shape[1])), -np.cumsum(drop, axis=0)])
        # A level is free in each stretch of linked periods; taking it from the mean keeps it small.
        stretch = np.concatenate([[0], np.cumsum(~open_)])
        count = np.bincount(stretch)
        mean = np.stack([np.bincount(stretch, level[:, j]) for j in range(r.shape[1])], axis=1) / count[:, None]
        return r / self.size[:, None] + level - mean[stretch]


@dataclass
class Effects:
    """Period effects as a frame (period, e_0, e_1, ...), the number of periods, products taken, and the residual left."""

    frame: DataFrame
    periods: int
    products: int
    residual: float


def _by_entity(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Rows (place, position in the entity) as lists of places and of entity lengths, both of whole entities.

    An entity's rows must follow each other. Memory is a batch and an entity.
    """
    cell = lambda v: pa.array([np.asarray(v, np.int32)], pa.list_(pa.int32()))
    lists = lambda *values: pa.RecordBatch.from_arrays([cell(v) for v in values], ["place", "length"])
    place, at = np.zeros(0, np.int32), np.zeros(0, np.int32)
    for b in batches:
        place, at = (np.concatenate([rest, b.column(c).to_numpy(zero_copy_only=False)]) for rest, c in ((place, "__place"), (at, "__at")))
        start = np.flatnonzero(at == 1)
        # The last entity may go on in the next batch.
        if len(start) > 1:
            yield lists(place[: start[-1]], np.diff(start))
            place, at = place[start[-1] :], at[start[-1] :]
    if len(place):
        yield lists(place, [len(place)])


def _product(lists: DataFrame, v: np.ndarray) -> np.ndarray:
    """Sums by period of a vector looked up by period, less entity means. Memory is a batch and a vector per task."""
    k, q = v.shape
    names = [f"v_{j}" for j in range(q)]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        total, met = np.zeros((k, q)), np.zeros(k, bool)
        for b in batches:
            place, length = (b.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("place", "length"))
            if len(place):
                met[place] = True
                start = np.cumsum(length) - length
                for j in range(q):
                    seen = v[place, j]
                    net = seen - np.repeat(np.add.reduceat(seen, start) / length, length)
                    total[:, j] += np.bincount(place, net, k)
        at = np.flatnonzero(met)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *[pa.array(total[at, j]) for j in range(q)]], ["place", *names])

    sums = lists.mapInArrow(partial, ", ".join(["place int", *[f"{n} double" for n in names]])).groupBy("place")
    found = sums.agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    out = np.zeros((k, q))
    out[found.column("place").to_numpy()] = np.column_stack([found.column(n).to_numpy() for n in names])
    return out


def graph_effects(panel: Panel, columns: Sequence[str], tolerance: float = TOLERANCE, limit: int = LIMIT) -> Effects:
    """Effects of each column. Complete rows and a unique key are taken for granted.

    ``residual`` bounds the remaining residual over the first one, both in the norm of the preconditioner; the search
    ends when it is within ``tolerance`` for every column, and raises after ``limit`` products.
    """
    t, q, spark = panel.time, len(columns), panel.df.sparkSession
    ship_package(spark)
    times = panel.df.select(t).distinct().orderBy(t).toArrow().column(t)
    if times.null_count:
        raise ValueError(f"{t} is NULL in some rows")
    places = spark.createDataFrame(pa.table({t: times, "__place": np.arange(len(times), dtype=np.int32)}))
    whole = Window.partitionBy(*panel.entity)
    rows = panel.df.select(*panel.entity, t, *columns).join(places, t).repartition(*panel.entity)
    mean = lambda c: F.avg(c).over(whole)
    placed = rows.withColumns({"__n": F.count(F.lit(1)).over(whole), "__at": F.row_number().over(whole.orderBy("__place"))})
    placed = placed.sortWithinPartitions(*panel.entity, "__at")
    placed = placed.select("__place", "__n", "__at", *[(F.col(f"`{c}`") - mean(f"`{c}`")).alias(f"d_{j}") for j, c in enumerate(columns)])
    placed = materialise(placed)
    # An entity with m rows up to a period and n - m after it links the two sides with m (n - m) / 2.
    link = F.sum((F.col("__n") - 2 * F.col("__at") + 1) / 2)
    table = placed.groupBy("__place").agg(F.count(F.lit(1)).alias("n"), link.alias("w"), *[F.sum(f"d_{j}").alias(f"b_{j}") for j in range(q)])
    table = table.orderBy("__place").toArrow()
    b = np.column_stack([table.column(f"b_{j}").to_numpy() for j in range(q)])
    chain = Chain(table.column("n").to_numpy().astype(float), np.cumsum(table.column("w").to_numpy())[:-1])
    lists = materialise(placed.select("__place", "__at").mapInArrow(_by_entity, "place array<int>, length array<int>"))

    def frame(v: np.ndarray, name: str) -> DataFrame:
        return spark.createDataFrame(pa.table({t: times, **{f"{name}_{j}": v[:, j] for j in range(q)}}))

    x, r = np.zeros_like(b), b
    z = chain.solve(r)
    p, rz = z, (r * z).sum(axis=0)
    first, products = rz.copy(), 0
    left = lambda: float(np.sqrt(np.max(np.divide(np.maximum(rz, 0), first, out=np.zeros(q), where=first > 0), initial=0.0)))
    while left() > tolerance:
        if products == limit:
            raise RuntimeError(f"two-way effects: {left():.1e} of the residual is left after {limit} products")
        a = _product(lists, p)
        products += 1
        bend = (p * a).sum(axis=0)
        step = np.divide(rz, bend, out=np.zeros(q), where=bend > 0)
        x, r = x + step * p, r - step * a
        z = chain.solve(r)
        new = (r * z).sum(axis=0)
        p = z + np.divide(new, rz, out=np.zeros(q), where=rz > 0) * p
        rz = new
    return Effects(frame(x, "e"), len(times), products, left())


def net_of_effects(df: DataFrame, time: str, columns: Sequence[str], effects: Effects) -> DataFrame:
    """``df`` with each column less its period's effect."""
    met = df.join(effects.frame, time)
    return met.select(*[F.col(f"`{c}`") - F.col(f"e_{columns.index(c)}") if c in columns else F.col(f"`{c}`") for c in df.columns]).toDF(*df.columns)
