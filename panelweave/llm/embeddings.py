"""Vectors linked by cosine, by tiled comparison in the order of principal axes.

Vectors are turned into principal axes, largest variance first, and put into tiles in that order. Two
tiles meet only if the boxes around their leading coordinates come close enough. Inside a pair of tiles
products of the leading coordinates are summed first; what the rest can add is at most the product of
the two suffix norms, and a pair whose sum and bound stay below the threshold goes. Survivors gain
further coordinates in steps, and what is left is verified in double precision. Equal vectors are one
class with a count, and a pair of tiles reports counts and spanning links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import batch_of, map_arrow
from panelweave.llm.components import connected, local_components
from panelweave.session import materialise

THRESHOLD = 0.9
TILE = 4096
#: Coordinates in the first product, and in each further step.
LEAD = 16
#: Leading coordinates that bound a tile.
BOX = 8
#: Slack of the bounds for rounding in single precision; survivors are verified in double.
SLACK = 1e-4


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, width)


def _unit(x: np.ndarray) -> np.ndarray:
    # Scaled first, so that squares of very large or small components do not overflow or vanish.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _axes(classes: DataFrame, width: int) -> np.ndarray:
    """Principal axes of the unit vectors as columns, largest first; the driver gets width x width sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for b in batches:
            x = _unit(_matrix(b.column("vec"), width))
            total += x.T @ x
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "v"])

    total = np.zeros((width, width))
    for r in map_arrow(classes.select("vec"), run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        total[r["i"], r["j"]] = r["v"]
    return np.ascontiguousarray(np.linalg.eigh((total + total.T) / 2)[1][:, ::-1])


def _tiles(classes: DataFrame, axes: np.ndarray, width: int, tile: int, reach: float) -> DataFrame:
    """Rows of up to ``tile`` vectors in the order of the leading axes: ``tile``, ``ids``, ``counts``, ``data``, ``low``, ``high``."""

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = _unit(_matrix(b.column("vec"), width)) @ axes[:, :3]
            first = np.floor(y[:, 0] / reach)
            second = np.floor(y[:, min(1, y.shape[1] - 1)] / reach)
            last = y[:, min(2, y.shape[1] - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(first), pa.array(second), pa.array(last)], names=[*b.schema.names, "c1", "c2", "c3"])

    placed = map_arrow(classes.select("id", "n", "vec"), lead, "id long, n long, vec array<double>, c1 double, c2 double, c3 double")
    placed = placed.repartitionByRange("c1", "c2", "c3").sortWithinPartitions("c1", "c2", "c3", "id").withColumn("part", F.spark_partition_id())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("tile", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary()), ("data", pa.binary()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))]
        held, made = [], 0

        def done(ids: np.ndarray, n: np.ndarray, x: np.ndarray, part: int) -> pa.RecordBatch:
            y = _unit(x) @ axes[:, :BOX]
            single = x.astype(np.float32)
            # Components that came as single precision are moved as such.
            data = single if np.array_equal(single, x) else x
            return batch_of([(part << 32 | made, ids.tobytes(), n.tobytes(), data.tobytes(), y.min(axis=0).tolist(), y.max(axis=0).tolist())], fields)

        part = 0
        for b in batches:
            if not b.num_rows:
                continue
            part = b.column("part")[0].as_py()
            held.append((b.column("id").to_numpy(zero_copy_only=False), b.column("n").to_numpy(zero_copy_only=False), _matrix(b.column("vec"), width)))
            while sum(len(h[0]) for h in held) >= tile:
                ids, n, x = (np.concatenate([h[k] for h in held]) for k in range(3))
                yield done(ids[:tile], n[:tile], x[:tile], part)
                made += 1
                held = [(ids[tile:], n[tile:], x[tile:])]
        if sum(len(h[0]) for h in held):
            yield done(*(np.concatenate([h[k] for h in held]) for k in range(3)), part)

    return map_arrow(placed, cut, "tile long, ids binary, counts binary, data binary, low array<double>, high array<double>")


def compare(a: np.ndarray, b: np.ndarray, same: bool, axes: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) with cosine at least ``threshold``, both ways round but without i = i if ``same``."""
    x, y = _unit(a), _unit(b)
    p, q = (x @ axes).astype(np.float32), (y @ axes).astype(np.float32)
    width = p.shape[1]

    def rest(z: np.ndarray, at: int) -> np.ndarray:
        return np.sqrt((z[:, at:].astype(np.float64) ** 2).sum(axis=1)).astype(np.float32)

    lead = min(LEAD, width)
    # One more coordinate holds the suffix norm, so that one product gives sum and bound.
    left, right = np.column_stack([p[:, :lead], rest(p, lead)]), np.column_stack([q[:, :lead], rest(q, lead)]).T.copy()
    steps = [(at, min(at + LEAD, width)) for at in range(lead, width, LEAD)]
    tails = {to: (rest(p, to), rest(q, to)) for _, to in steps}
    for start in range(0, len(left), 512):
        i, j = np.nonzero(left[start : start + 512] @ right >= threshold - SLACK)
        i += start
        if same:
            i, j = i[i != j], j[i != j]
        for at in range(0, len(i), 1 << 18):
            k, m = i[at : at + (1 << 18)], j[at : at + (1 << 18)]
            total = np.einsum("ij,ij->i", p[k, :lead], q[m, :lead])
            for begin, to in steps:
                total = total + np.einsum("ij,ij->i", p[k, begin:to], q[m, begin:to])
                near = total + tails[to][0][k] * tails[to][1][m] >= threshold - SLACK
                k, m, total = k[near], m[near], total[near]
            near = np.einsum("ij,ij->i", x[k], y[m]) >= threshold
            yield k[near], m[near]


def _linked(classes: DataFrame, width: int, threshold: float, tile: int) -> DataFrame:
    """Rows (id, links, other): what a class gained from one pair of tiles, and a smaller class it is linked with there."""
    axes = _axes(classes, width)
    reach = float(np.sqrt(2 - 2 * threshold)) + SLACK
    tiles = materialise(_tiles(classes, axes, width, tile, reach))
    # One summary row for each tile of vectors goes to the driver and to the tasks.
    boxes = tiles.select("tile", "low", "high").orderBy("tile").collect()
    if not boxes:
        return classes.sparkSession.createDataFrame([], "id long, links long, other long")
    numbers = np.array([r["tile"] for r in boxes], np.int64)
    low, high = np.array([r["low"] for r in boxes]), np.array([r["high"] for r in boxes])
    shared = classes.sparkSession.sparkContext.broadcast((numbers, low, high, axes))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, low, high, _ = shared.value
        for b in batches:
            for t in b.column("tile").to_pylist():
                k = int(np.searchsorted(numbers, t))
                gap = np.maximum(0, np.maximum(low[k] - high[k:], low[k:] - high[k]))
                to = numbers[k:][(gap * gap).sum(axis=1) <= reach * reach]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(to), t)), pa.array(to)], names=["a", "b"])

    met = map_arrow(tiles.select("tile"), pairs, "a long, b long")
    left = tiles.select(F.col("tile").alias("a"), *(F.col(c).alias(f"{c}_a") for c in ("ids", "counts", "data")))
    right = tiles.select(F.col("tile").alias("b"), *(F.col(c).alias(f"{c}_b") for c in ("ids", "counts", "data")))
    met = met.join(left, "a").join(right, "b").repartition("a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes = shared.value[3]
        for b in batches:
            for r in range(b.num_rows):
                one, two = b.column("a")[r].as_py(), b.column("b")[r].as_py()
                ids, counts, data = [], [], []
                for side in "ab":
                    own = np.frombuffer(b.column(f"ids_{side}")[r].as_py(), np.int64)
                    raw = b.column(f"data_{side}")[r].as_py()
                    ids.append(own)
                    counts.append(np.frombuffer(b.column(f"counts_{side}")[r].as_py(), np.int64))
                    data.append(np.frombuffer(raw, np.float32 if len(raw) == 4 * width * len(own) else np.float64).reshape(-1, width).astype(np.float64))
                same, n, m = one == two, len(ids[0]), len(ids[1])
                gained, label = np.zeros(n + m, np.int64), np.arange(n + m)
                shift = 0 if same else n
                for i, j in compare(*data, same, axes, threshold):
                    gained[:n] += np.bincount(i, counts[1][j], n).astype(np.int64)
                    if not same:
                        gained[n:] += np.bincount(j, counts[0][i], m).astype(np.int64)
                    known = np.flatnonzero(label != np.arange(n + m))
                    label = local_components(n + m, np.concatenate([i, known]), np.concatenate([j + shift, label[known]]))
                both = np.concatenate(ids)
                at = np.flatnonzero(gained)
                yield pa.RecordBatch.from_arrays([pa.array(both[at]), pa.array(gained[at]), pa.array(both[label[at]])], names=["id", "links", "other"])

    return map_arrow(met, run, "id long, links long, other long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per row of ``vectors``: ``vec_id``, ``n_links``, ``component_id``, ``kept``.

    ``n_links`` counts the other rows at a cosine of at least ``threshold``; ``component_id`` is the smallest id reachable over
    such links; ``kept`` says whether that is the row's own id. Null vectors, zero vectors, vectors with null or
    non-finite components, and rows with a null id link with nothing. Vectors of different lengths don't link.
    Repeated rows are rows of their own, linked with each other; rows of one id are one node of a component. Other columns are not read.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    usable = F.coalesce(F.col("id").isNotNull() & (F.size("vec") > 0) & finite & F.exists("vec", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("vec", F.when(usable, F.col("vec")))
    classes = materialise(rows.filter("vec is not null").groupBy("vec").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")))
    found = None
    for r in classes.select(F.size("vec").alias("w")).distinct().orderBy("w").collect():
        part = _linked(classes.filter(F.size("vec") == r["w"]), r["w"], threshold, tile)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "id long, links long, other long")
    found = materialise(found)
    gained = found.groupBy("id").agg(F.sum("links").alias("links"))
    joined = connected(found.select("id", "other"))
    named = classes.join(gained, "id", "left").join(joined, F.col("id") == F.col("node"), "left").select(
        F.col("vec").alias("v"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")
    )
    out = rows.join(named, F.col("vec") == F.col("v"), "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        component.eqNullSafe(F.col("id")).alias("kept"),
    )
